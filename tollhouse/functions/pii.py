"""Row helpers of personal-data detection, redaction and restoration."""

from __future__ import annotations

import ipaddress
import json
import re
from collections import Counter

#: Entity types in scope and their tiers (fixed values); others count as REDACT.
POLICY = {
    "US_SSN": "SEAL", "US_ITIN": "SEAL", "US_PASSPORT": "SEAL", "DATE_OF_BIRTH": "SEAL", "US_STREET_ADDRESS": "SEAL",
    "CREDIT_CARD": "REDACT", "US_BANK_NUMBER": "REDACT", "IBAN_CODE": "REDACT",
    "US_DRIVER_LICENSE": "MASK", "PERSON": "MASK", "EMAIL_ADDRESS": "MASK", "PHONE_NUMBER": "MASK", "LOCATION": "MASK", "IP_ADDRESS": "MASK",
}
TIERS = ("MASK", "SEAL", "REDACT")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Patterns and scores of the entity types (fixed values).
PATTERNS: tuple[tuple[str, str, float], ...] = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", 1.0),
    ("IP_ADDRESS", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", 0.95),
    ("US_SSN", r"\b(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", 0.85),
    ("US_ITIN", r"\b9\d{2}-(?:[78]\d|5\d|6[0-5]|9[0-24-9])-\d{4}\b", 0.85),
    ("CREDIT_CARD", r"\b(?:\d[ -]?){12,18}\d\b", 1.0),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0),
    ("PHONE_NUMBER", r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", 0.75),
    ("DATE_OF_BIRTH", r"\b(0[1-9]|1[0-2])[\/\-](0[1-9]|[12]\d|3[01])[\/\-](19|20)\d{2}\b", 0.4),
    ("DATE_OF_BIRTH", r"\b(19|20)\d{2}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])\b", 0.4),
    ("US_STREET_ADDRESS", r"\b\d{1,5}\s+[A-Za-z0-9][A-Za-z0-9\s.\-]{0,80}?,\s*[A-Za-z][A-Za-z\s.\-]{1,60}?,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?\b", 0.6),
    ("US_PASSPORT", r"\b(?:[A-Z]\d{8}|\d{9})\b", 0.1),
    ("US_DRIVER_LICENSE", r"\b[A-Z]\d{7,12}\b", 0.3),
    ("US_BANK_NUMBER", r"\b\d{8,17}\b", 0.05),
)
#: Words that raise a score when they stand before a match (fixed values).
CONTEXT: dict[str, tuple[str, ...]] = {
    "DATE_OF_BIRTH": ("born", "dob", "birth", "birthday", "birthdate", "date", "of"),
    "US_PASSPORT": ("passport", "travel document"),
    "US_DRIVER_LICENSE": ("driver", "license", "licence", "dl"),
    "US_BANK_NUMBER": ("account", "bank", "acct", "routing"),
    "US_SSN": ("ssn", "social security"),
    "PHONE_NUMBER": ("phone", "call", "tel", "mobile"),
}
_COMPILED = [(k, re.compile(p), s) for k, p, s in PATTERNS]
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, w)) + r")\b", re.I) for k, w in CONTEXT.items()}
#: What a text must hold for any match of the patterns of a type; cheaper to look for than the pattern.
_NEEDS = {
    "EMAIL_ADDRESS": re.compile("@"), "IP_ADDRESS": re.compile(r"\d\.\d"), "US_SSN": re.compile(r"\d-\d"), "US_ITIN": re.compile(r"\d-\d"), "CREDIT_CARD": re.compile(r"(?:\d[ -]?){12}\d"),
    "IBAN_CODE": re.compile(r"[A-Z]{2}\d{2}"), "PHONE_NUMBER": re.compile(r"\d{3}[ .-]\d{4}"), "DATE_OF_BIRTH": re.compile(r"\d[/-]\d"), "US_STREET_ADDRESS": re.compile(","),
    "US_PASSPORT": re.compile(r"\d{8}"), "US_DRIVER_LICENSE": re.compile(r"\d{7}"), "US_BANK_NUMBER": re.compile(r"\d{8}"),
}
_STREET = (" street", " st", " avenue", " ave", " road", " rd", " boulevard", " blvd", " lane", " ln", " drive", " dr", " court", " ct", " place", " pl", " way")
_TEST_DOMAINS = ("@example.com", "@example.org", "@example.net", "@test.com", "@localhost")
MIN_SCORE = 0.5


def policy(entity: str) -> str:
    """Tier of an entity type; unknown ones are redacted."""
    return POLICY.get(entity, "REDACT")


def luhn(digits: str) -> bool:
    """Whether a card number's check digit holds."""
    values = [int(c) for c in reversed(digits) if c.isdigit()]
    return len(values) >= 13 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(values)) % 10 == 0


def iban(code: str) -> bool:
    """Whether an IBAN's check digits hold."""
    c = code.replace(" ", "")
    return 15 <= len(c) <= 34 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


_CHECKS = {"CREDIT_CARD": luhn, "IBAN_CODE": iban}


def detect(text: str, entities: list[str] | None = None) -> list[dict]:
    """Spans of the pattern entities: start, end (characters), entity_type, score."""
    out = []
    if not any(c in text for c in "0123456789@"):
        return out
    there: dict[str, bool] = {}
    for kind, pattern, score in _COMPILED:
        if entities is not None and kind not in entities:
            continue
        if kind not in there:
            there[kind] = _NEEDS[kind].search(text) is not None
        if not there[kind]:
            continue
        for m in pattern.finditer(text):
            if kind in _CHECKS and not _CHECKS[kind](m[0]):
                continue
            raised = min(1.0, score + 0.45) if kind in _CONTEXT and _CONTEXT[kind].search(text, max(0, m.start() - 60), m.start()) else score
            out.append({"start": m.start(), "end": m.end(), "entity_type": kind, "score": raised})
    return out


def threshold(spans: list[dict], length: int, least: float = MIN_SCORE) -> list[dict]:
    """Spans of sufficient score and valid offsets."""
    return [s for s in spans if s["score"] >= least and 0 <= s["start"] < s["end"] <= length]


def private_ip(value: str) -> bool:
    """Whether an address is private or loopback, with or without a port."""
    host = value.strip().lower()
    if host == "localhost" or host.startswith("localhost:"):
        return True
    bare = host.strip("[]") if host.startswith("[") and host.endswith("]") else host
    for candidate in (bare, re.sub(r"^\[(.*)\]:\d+$", r"\1", host), re.sub(r"^([^:]*):\d+$", r"\1", host)):
        try:
            ip = ipaddress.ip_address(candidate)
        except ValueError:
            continue
        if ip.is_loopback:
            return True
        nets = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16") if ip.version == 4 else ("fc00::/7",)
        return any(ip in ipaddress.ip_network(n) for n in nets)
    return False


def allow_reason(value: str, kind: str, allow_test_emails: bool = True) -> str:
    """Why a span may stay as it is, '' if it may not."""
    if kind == "PERSON" and len(value.split()) < 2:
        return "single_token_person"
    if kind == "LOCATION" and not (any("0" <= c <= "9" for c in value) and any(t in value.lower() for t in _STREET)):
        return "non_street_location"
    if kind == "IP_ADDRESS" and private_ip(value):
        return "private_ip"
    lower = value.strip().lower()
    if kind == "EMAIL_ADDRESS" and allow_test_emails and (lower.startswith(("test@", "dev@")) or lower.endswith(_TEST_DOMAINS)):
        return "test_email"
    return ""


def resolve(spans: list[dict]) -> list[dict]:
    """Spans that do not overlap, in text order: stricter tier, then score, length and earlier start win."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (-TIERS.index(policy(s["entity_type"])), -s["score"], s["start"] - s["end"], s["start"])):
        if all(s["end"] <= k["start"] or k["end"] <= s["start"] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


def final_spans(text: str, extra: list[dict] | None = None, entities: list[str] | None = None, least: float = MIN_SCORE) -> list[dict]:
    """Spans that are replaced in a text."""
    spans = threshold(detect(text, entities) + list(extra or ()), len(text), least)
    return resolve([s for s in spans if not allow_reason(text[s["start"] : s["end"]], s["entity_type"])])


class Registry:
    """Placeholders of one request or conversation: one for each original and tier."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.known: dict[tuple[str, str], str] = {}
        self.used: dict[tuple[str, str], str] = {}

    def placeholder(self, kind: str, original: str) -> str:
        """The token that stands for an original."""
        tier = policy(kind)
        if tier == "REDACT":
            return f"[REDACTED:{kind}]"
        if (original, tier) not in self.known:
            self.counts[kind] += 1
            self.known[original, tier] = f"<PII_{kind}_{self.counts[kind]}>"
        self.used[original, tier] = self.known[original, tier]
        return self.known[original, tier]

    def rows(self) -> list[dict]:
        """(placeholder, original, policy)."""
        return [{"placeholder": p, "original": o, "policy": t} for (o, t), p in self.known.items()]

    def taken(self) -> list[dict]:
        """(placeholder, original, policy) of those given out since the last call."""
        used, self.used = self.used, {}
        return [{"placeholder": p, "original": o, "policy": t} for (o, t), p in used.items()]


def redact(text: str, spans: list[dict]) -> str:
    """Each span as ``[REDACTED:TYPE]``."""
    for s in reversed(spans):
        text = f"{text[: s['start']]}[REDACTED:{s['entity_type']}]{text[s['end'] :]}"
    return text


def scrub(text: str, registry: Registry, extra: list[dict] | None = None) -> str:
    """Spans as placeholders, numbered from the right."""
    for s in reversed(final_spans(text, extra)):
        text = text[: s["start"]] + registry.placeholder(s["entity_type"], text[s["start"] : s["end"]]) + text[s["end"] :]
    return text


def _forms(character: str, entity: str) -> str:
    code = f"{ord(character):04x}"
    return rf"(?:{re.escape(character)}|\\u{code}|\\u{code.upper()}|{entity}|&#{ord(character)};)"


_NAME = r" ?(PII_[A-Z][A-Z0-9_]*_\d+) ?"
_WIRE = re.compile("|".join(_forms(a, x) + _NAME + _forms(b, y) for a, b, x, y in (("<", ">", "&lt;", "&gt;"), ("[", "]", "&lbrack;", "&rbrack;"), ("{", "}", "&lbrace;", "&rbrace;"), ("(", ")", "&lpar;", "&rpar;"))))


def restore(text: str, registry: list[dict] | None, escape: bool = False) -> tuple[str, int]:
    """MASK placeholders in any delimiters as their originals, and how many."""
    originals = {r["placeholder"][1:-1]: r["original"] for r in registry or () if r["policy"] == "MASK"}
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        name = next(g for g in m.groups() if g)
        if name not in originals:
            return m[0]
        n += 1
        return json.dumps(originals[name], ensure_ascii=False)[1:-1] if escape else originals[name]

    return (_WIRE.sub(put, text), n) if originals else (text, 0)


def leaked(text: str, registry: list[dict] | None) -> int:
    """MASK placeholders left in a restored text."""
    return restore(text, registry)[1]


_IMAGE = re.compile(r"^(?:data:image/[a-z0-9.+-]+;base64,)?[A-Za-z0-9+/\r\n]{1024,}={0,2}$")
_SYSTEM_KEYS = frozenset({"tools", "functions", "schema", "json_schema", "response_format", "tool_choice", "metadata", "model", "id", "role", "type", "name", "url"})


#: Fields of request bodies that hold text of users, by provider: the field and the fields that one of must enclose it; "*" is any place, "" the top alone (fixed values).
TEXT_FIELDS = {
    "openai": {"content": ("messages",), "text": ("content", "input"), "input": ("",), "prompt": ("",), "arguments": ("tool_calls", "function", "input"), "output": ("tool_calls", "function", "input")},
    "anthropic": {
        "system": ("*",), "content": ("messages", "tool_result", "output"), "text": ("parts", "content", "message", "system"), "input": ("tool_use", "tool_calls", "function_call"),
        "arguments": ("tool_calls", "function"), "output": ("tool_calls", "function"),
    },
    "gemini": {"text": ("parts", "content", "message")},
    "bedrock": {"text": ("content", "system", "toolResult"), "content": ("tool_result", "toolResult")},
}
#: Fields whose objects are text as a whole, their keys left out; all of a group must enclose them (fixed values).
OBJECT_FIELDS = {
    "anthropic": {"input": (("tool_use",),)},
    "gemini": {"args": (("functionCall",), ("function_call",)), "response": (("functionResponse",), ("function_response",))},
    "bedrock": {"input": (("toolUse",),), "json": (("toolResult", "content"),)},
}
#: Fields whose lists hold texts themselves (fixed values).
LIST_FIELDS = {"openai": ("input",)}


def _providers(name: str | None) -> list[str]:
    """The provider whose rules hold; all for one that is not known."""
    return [name] if name in TEXT_FIELDS else [*TEXT_FIELDS]


def json_leaves(body: str, provider: str | None = None) -> tuple[object, list[tuple[object, object, str, bool]]]:
    """The value of a body and its texts of users in order: (container, key, text, whether it is an object's JSON).

    A body that is no JSON object or list is one text by itself, without a container.
    """
    try:
        value = json.loads(body)
    except ValueError:
        value = None
    if not isinstance(value, (dict, list)):
        return None, [(None, None, body, False)]
    names, found = _providers(provider), []

    def is_text(path: tuple, key: str) -> bool:
        return any(o == "*" or (o == "" and not path) or o in path for n in names for o in TEXT_FIELDS[n].get(key, ()))

    def is_object(path: tuple, key: str) -> bool:
        return any(all(o in path for o in group) for n in names for group in OBJECT_FIELDS.get(n, {}).get(key, ()))

    todo: list[tuple] = [(value, ())]
    while todo:
        own, path = todo.pop()
        is_list = isinstance(own, list)
        listed = is_list and any(o in path for n in names for o in LIST_FIELDS.get(n, ()))
        below = []
        for key, child in enumerate(own) if is_list else own.items():
            if isinstance(child, str):
                if (listed if is_list else is_text(path, key)) and not _IMAGE.match(child):
                    found.append((own, key, child, False))
            elif isinstance(child, (dict, list)):
                if not is_list and is_object(path, key):
                    found.append((own, key, json.dumps(child, ensure_ascii=False, separators=(",", ":")), True))
                else:
                    below.append((child, path if is_list else (*path, key)))
        todo += reversed(below)
    return value, found


def leaf_spans(text: str, is_object: bool) -> list[dict]:
    """Final spans of a text of ``json_leaves``; keys and schemas of an object are not looked at."""
    return final_spans(mask_json_metadata(text) if is_object else text)


def put_leaves(body: str, provider: str | None, spans: list[list[dict]], registry: Registry) -> str:
    """A body with the spans of each of its texts (in their order) as placeholders."""
    value, found = json_leaves(body, provider)
    for (own, key, text, is_object), marks in zip(found, spans, strict=True):
        for s in reversed(marks):
            text = text[: s["start"]] + registry.placeholder(s["entity_type"], text[s["start"] : s["end"]]) + text[s["end"] :]
        if own is None:
            return text
        if is_object:
            try:
                own[key] = json.loads(text)
            except ValueError:
                continue
        else:
            own[key] = text
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def mask_json_metadata(body: str) -> str:
    """A JSON body with keys and the strings of schema fields blanked to spaces of equal length: offsets stay."""
    out, stack, key = list(body), [], None
    skip_below = None
    for m in re.finditer(r'"((?:[^"\\]|\\.)*)"(\s*:)?|[\[\]{}]', body):
        token = m[0]
        if token in "{[":
            if key in _SYSTEM_KEYS and skip_below is None:
                skip_below = len(stack)
            stack.append(key)
            key = None
        elif token in "}]":
            key = stack.pop() if stack else None
            if skip_below is not None and len(stack) <= skip_below:
                skip_below = None
        elif m[2]:
            key = m[1]
            out[m.start(1) : m.end(1)] = " " * len(m[1])
        elif skip_below is not None or key in _SYSTEM_KEYS:
            out[m.start(1) : m.end(1)] = " " * len(m[1])
    return "".join(out)


def images(body: str, most_bytes: int) -> list[str]:
    """Base64 payloads of images in a request body, of up to ``most_bytes`` when decoded."""
    try:
        value = json.loads(body)
    except ValueError:
        return []
    found: list[str] = []

    def walk(x):
        if isinstance(x, dict):
            data = x.get("data") if ("media_type" in x or "mimeType" in x or "mime_type" in x) and isinstance(x.get("data"), str) else None
            if data:
                found.append(data)
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)
        elif isinstance(x, str) and (m := re.match(r"data:image/[\w.+-]+;base64,(.*)$", x, re.S)):
            found.append(m[1])

    walk(value)
    return [d for d in found if len(d) * 3 // 4 <= most_bytes]

