"""Main text of web pages by wrapper induction.

Pages of a host share a template.  The element tree of each page, with runs of alike
siblings folded into one node, is aligned with those of other pages of its host by simple
tree matching; texts that stay the same on all pages are template, those that vary are
slots.  Every page takes part: a task merges its pages of a host into one tree, whose size
the template bounds, and those trees are merged by host.  The template of a host lists, by
paths of signatures, the constant texts and the elements that hold main text whatever their
names say.  A page's text is that of all its slots outside menus, notices and the like.
Trees are walked with stacks of their own: pages may be nested as deep as they like.
"""

from __future__ import annotations

import heapq
import html
import json
import re
import zlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollhouse.llm.common import split_count, stored

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<decl>[!?])[^>]*(?:>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not parsed.
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold main text; headers of an article or main element are none of these.
DROPPED = frozenset("head nav header footer aside script style noscript template iframe object svg canvas button select option input textarea dialog menu audio video map title xmp noframes datalist".split())
#: Elements that hold main text only where they hold a large part of the host's varying text: whole pages may lie in a form.
DOUBTED = frozenset("form fieldset".split())
MAIN = ("article", "main")
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that, with words of ``PLACES`` at most, make up a class or id of an element outside the main text, where it holds no large part of the host's varying text.
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations trending widget comment comments commentlist disqus respond reply replies pagination pager toolbar skip copyright disclaimer legal paywall toast".split())
PLACES = frozenset("area bar block bottom box button buttons container content div element float group holder icons inline inner item items left line links list module outer page panel primary right row secondary section site slot sticky strip text top unit widget wrap wrapper zone".split())
#: A start tag closes open elements of these kinds.
CLOSES = {t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("html body table td th ul ol dl div article section main aside nav header footer form".split())
#: Texts are constant if so many different pages have them, and this share of the host's pages: copies of a page make none.
LEAST_DIFFERENT, LEAST_SHARE = 3, 0.5
#: Elements marked by their names may hold this share of the varying text, together and each on the pages that have it.
NAMED_SHARE = 0.5
#: Different hosts that a task holds before it hands its trees on.
HOSTS_AT_ONCE = 2_000


class Node:
    """An element: tag, signature, whether it is left out, whether its names say so, whether its text belongs to its parent's, and its texts and elements in order."""

    __slots__ = ("items", "named", "out", "plain", "sign", "tag")

    def __init__(self, tag: str, sign: str, out: bool, named: bool = False):
        self.tag, self.sign, self.out, self.named, self.plain = tag, sign, out, named, False
        self.items: list[str | Node] = []

    def elements(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _made(tag: str, raw: str) -> Node:
    if not raw.strip(" /\n\t"):
        return Node(tag, tag, tag in DROPPED, tag in DOUBTED)
    attrs = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTR.finditer(raw)}
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    out = tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"
    out = out or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    named: set[str] = set()
    if not out and tag not in ("html", "body", *MAIN):
        # A name counts as a whole: "share-buttons" does, "share-price" does not.
        for name in names.split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words <= DROPPED_WORDS | PLACES:
                named |= words & DROPPED_WORDS
        named |= {tag} & DOUBTED
    kind = " ".join(sorted(x for x in attrs.get("class", "").split() if not any(c.isdigit() for c in x)))
    # Elements of other names are not alike, be it in their ids alone.
    return Node(tag, (f"{tag}.{kind}" if kind else tag) + "".join(f"!{w}" for w in sorted(named)), out, bool(named))


def parse(text: str) -> Node:
    """The element tree of a page; missing end tags are supplied, unknown ones ignored."""
    root = Node("#root", "#root", False)
    stack, at = [root], 0
    while at < len(text):
        m = _TAG.search(text, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].items.append(text[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        tag = m["name"].lower()
        if m["end"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if stack[depth].tag in _SCOPE and tag not in _SCOPE:
                    break
            continue
        closes = CLOSES.get(tag)
        if closes:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in closes:
                    del stack[depth:]
                    break
                if stack[depth].tag in _SCOPE:
                    break
        node = _made(tag, m["attrs"])
        stack[-1].items.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/"):
            stack.append(node)
    if at < len(text):
        # A tag that the page breaks off is no text.
        rest = text[at:]
        stack[-1].items.append(rest[: cut.start()] if (cut := re.search(r"<[/!a-zA-Z]", rest)) else rest)
    _settle(root)
    return root


def _below(root: Node) -> list[Node]:
    """A node and all elements below, each before those that it holds."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node))
    return found


def _settle(root: Node) -> None:
    """What an element's place says of it.

    One around an article or main element stays, whatever its names say, and so does a header
    inside.  What stands beside them, headings of the page aside, is outside the main text as if its name
    said so.  Inline elements of running text alone are plain.
    """
    held: set[int] = set()
    headed: set[int] = set()
    for node in reversed(_below(root)):
        inside = node.elements()
        if any(id(x) in held for x in inside):
            held.add(id(node))
            if node.tag not in DROPPED:
                node.out = node.named = False
        if node.tag in MAIN and not node.out:
            held.add(id(node))
        if node.tag == "h1" or any(id(x) in headed for x in inside):
            headed.add(id(node))
        node.plain = node.tag in VOID or (node.tag in INLINE and not node.named and all(x.plain or x.out for x in inside))
    stack = [(root, False)]
    while stack:
        node, within = stack.pop()
        within = within or node.tag in MAIN
        if within and node.tag == "header":
            node.out = False
        for x in node.elements():
            if within or id(x) in held:
                stack.append((x, within))
            elif id(node) in held and not x.plain and id(x) not in headed:
                x.named = True


def own_text(node: Node) -> str:
    """Text of a node itself: its strings and plain elements, without what is left out."""
    parts: list[str] = []
    stack: list[str | Node] = list(reversed(node.items))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.plain and not x.out:
            if x.tag in INLINE:
                stack.extend(reversed(x.items))
            else:
                parts.append(" ")
        else:
            parts.append(" ")
    return " ".join("".join(parts).split())


def _key(own: str) -> str:
    """Checksum and length of a text."""
    return f"{zlib.crc32(own.encode('utf-8', 'surrogatepass')):x}:{len(own)}"


# Trees of templates: [signature, pages, checksums of own texts that all of them have or -1 where there are none or 0 where there is no text, length of own texts, [named, pages of which it holds most], children, checksums of a few different pages]


def skeleton(root: Node) -> list:
    """A page's tree without what is left out, runs of alike siblings folded."""
    seen: list[int] = []
    lengths: dict[int, int] = {}
    done: dict[int, list] = {}
    kept, stack = [], [(root, False)]
    texts: tuple[list[str], list[str]] = ([], [])
    while stack:
        node, within = stack.pop()
        within = within or node.named
        kept.append((node, [x for x in node.elements() if not x.out and not x.plain]))
        stack.extend((x, within) for x in reversed(kept[-1][1]))
        own = own_text(node)
        texts[within].append(own)
        done[id(node)] = [node.sign, 1, [_key(own)] if own else 0, len(own), [int(node.named), 0], [], seen]
    # Copies of a page are alike in what lies outside elements that may be adverts.
    plain = " ".join(filter(None, texts[0])) or " ".join(filter(None, texts[1]))
    seen.append(zlib.crc32(plain.encode("utf-8", "surrogatepass")))
    total = sum(map(len, texts[0])) + sum(map(len, texts[1]))
    for node, inside in reversed(kept):
        tree = done[id(node)]
        lengths[id(node)] = tree[3] + sum(lengths[id(x)] for x in inside)
        tree[4][1] = int(node.named and 2 * lengths[id(node)] > total)
        for x in inside:
            child = done[id(x)]
            if tree[5] and tree[5][-1][0] == child[0]:
                tree[5][-1] = merged(tree[5][-1], child, fold=True)
            else:
                tree[5].append(child)
    return done[id(root)]


def matching(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most pairs of nodes that align in order, ancestors included."""
    if a[0] != b[0]:
        return 0
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (id(x), id(y)) in memo:
            stack.pop()
            continue
        if not x[5] or not y[5]:
            memo[id(x), id(y)] = 1
            stack.pop()
            continue
        missing = [(c, d) for c in x[5] for d in y[5] if c[0] == d[0] and (id(c), id(d)) not in memo]
        if missing:
            stack.extend(missing)
            continue
        row = [0] * (len(y[5]) + 1)
        for c in x[5]:
            before, row = row, [0] * (len(y[5]) + 1)
            for j, d in enumerate(y[5]):
                row[j + 1] = max(before[j + 1], row[j], before[j] + (memo[id(c), id(d)] if c[0] == d[0] else 0))
        memo[id(x), id(y)] = 1 + row[-1]
        stack.pop()
    return memo[id(a), id(b)]


def aligned(xs: list, ys: list, memo: dict) -> list[tuple[list | None, list | None]]:
    """The pairs of a best alignment of two rows of trees, unmatched ones in their places."""
    table = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + matching(x, y, memo))
    out: list[tuple] = []
    i, j = len(xs), len(ys)
    while i and j:
        score = matching(xs[i - 1], ys[j - 1], memo)
        if score and table[i][j] == table[i - 1][j - 1] + score:
            out.append((xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            out.append((xs[i - 1], None))
            i -= 1
        else:
            out.append((None, ys[j - 1]))
            j -= 1
    out += [(x, None) for x in reversed(xs[:i])] + [(None, y) for y in reversed(ys[:j])]
    return out[::-1]


def _joined(a: list, b: list, fold: bool) -> list:
    """The node of two aligned ones without children; of one page if ``fold``."""
    if a[2] == b[2]:
        keys = a[2]
    elif fold:
        keys = sorted({*(a[2] or ()), *(b[2] or ())})
    else:
        both = [k for k in a[2] if k in set(b[2])] if isinstance(a[2], list) and isinstance(b[2], list) else []
        keys = both or -1
    seen = a[6] if a[6] == b[6] or len(a[6]) >= LEAST_DIFFERENT else sorted({*a[6], *b[6]})[:LEAST_DIFFERENT]
    most = max(a[4][1], b[4][1]) if fold else a[4][1] + b[4][1]
    return [a[0], 1 if fold else a[1] + b[1], keys, a[3] + b[3], [a[4][0] | b[4][0], most], [], seen]


def merged(a: list, b: list, memo: dict | None = None, fold: bool = False) -> list:
    """The template of two templates with equal roots; what both have if ``fold`` is false, what either has in one page if true."""
    memo = {} if memo is None else memo
    out = _joined(a, b, fold)
    stack = [(a, b, out)]
    while stack:
        x, y, into = stack.pop()
        for c, d in aligned(x[5], y[5], memo):
            if c is None or d is None:
                into[5].append(d if c is None else c)
            else:
                into[5].append(_joined(c, d, fold))
                stack.append((c, d, into[5][-1]))
    return out


def flat(tree: list) -> list[list]:
    """Nodes of a tree in order, each with its depth for its children."""
    out, stack = [], [(0, tree)]
    while stack:
        depth, t = stack.pop()
        out.append([*t[:5], depth, t[6]])
        stack.extend((depth + 1, x) for x in reversed(t[5]))
    return out


def raised(nodes: list[list]) -> list:
    """The tree of ``flat``."""
    path: list[list] = []
    for n in nodes:
        t = [*n[:5], [], n[6]]
        del path[n[5] :]
        if path:
            path[-1][5].append(t)
        path.append(t)
    return path[0]


def template(tree: list) -> list[list]:
    """(depth, signature, constant texts, whether it stays in spite of its names) of a host's nodes, those that say nothing left out."""
    nodes = flat(tree)
    pages, n = tree[1], len(nodes)
    constant = [t[2] if isinstance(t[2], list) and len(t[6]) >= LEAST_DIFFERENT and t[1] >= LEAST_SHARE * pages else [] for t in nodes]
    mass = [max(0, t[3] - t[1] * sum(int(k.split(":")[1]) for k in keys)) for t, keys in zip(nodes, constant, strict=True)]
    up: list[int] = []
    parent = []
    for i, t in enumerate(nodes):
        del up[t[5] :]
        parent.append(up[-1] if up else -1)
        up.append(i)
    for i in range(n - 1, 0, -1):
        mass[parent[i]] += mass[i]
    # Named elements go from the smallest on, while enough of the text stays.
    below: dict[int, list[int]] = {}
    nearest = [-1] * n
    for i, t in enumerate(nodes):
        above = parent[i]
        nearest[i] = -1 if above < 0 else above if nodes[above][4][0] else nearest[above]
        if t[4][0]:
            below.setdefault(nearest[i], []).append(i)
    stays = [False] * n
    heap = [(mass[i], i) for i in below.get(-1, ())]
    heapq.heapify(heap)
    gone = 0
    while heap:
        own, i = heapq.heappop(heap)
        t = nodes[i]
        large = own * pages > NAMED_SHARE * mass[0] * t[1] or 2 * t[4][1] >= t[1]
        if own and (large or gone + own > NAMED_SHARE * mass[0]):
            stays[i] = True
            for j in below.get(i, ()):
                heapq.heappush(heap, (mass[j], j))
        else:
            gone += own
    said = [bool(keys) or stay for keys, stay in zip(constant, stays, strict=True)]
    for i in range(n - 1, 0, -1):
        said[parent[i]] |= said[i]
    return [[t[5], t[0], keys, int(stay)] for t, keys, stay, says in zip(nodes, constant, stays, said, strict=True) if says]


#: (constant texts, whether it stays, nodes below by signature)
Guide = tuple[set, list, dict]


def guide(nodes: list[list]) -> Guide:
    """A template as nodes by signature; alike siblings are one."""
    root: Guide = (set(), [], {})
    path: list[Guide] = []
    for depth, sign, keys, stays in nodes:
        del path[depth:]
        at = path[-1][2].setdefault(sign, (set(), [], {})) if path else root
        at[0].update(keys)
        if stays:
            at[1].append(True)
        path.append(at)
    return root


_NOTHING: Guide = (set(), [], {})


def extract(text: str, by: Guide = _NOTHING) -> str:
    """Main text of a page by the template of its host."""
    parts: list[str] = []
    stack: list[tuple] = [(parse(text), by, False)]
    while stack:
        x, at, constant = stack.pop()
        if isinstance(x, str):
            parts.append(" " if constant else x)
            continue
        if x.out:
            continue
        if x.plain:
            if x.tag in INLINE:
                stack.extend((y, at, constant) for y in reversed(x.items))
            else:
                parts.append(" ")
            continue
        if x.named and not at[1]:
            continue
        own = own_text(x) if at[0] else ""
        constant = bool(own) and _key(own) in at[0]
        if x.tag not in INLINE:
            parts.append(" ")
            stack.append((" ", at, False))
        stack.extend((y, at if isinstance(y, str) or y.plain else at[2].get(y.sign, _NOTHING), constant) for y in reversed(x.items))
    return " ".join(html.unescape("".join(parts)).split())


def _host(url_col: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _trees(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, tree) of each task's pages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trees: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(trees), pa.string()), pa.array([json.dumps(flat(t)) for t in trees.values()], pa.string())], ["host", "tree"])

        for batch in batches:
            for host, page in zip(batch["host"].to_pylist(), batch["page"], strict=True):
                tree = skeleton(parse(page.as_py() or ""))
                trees[host] = merged(trees[host], tree) if host in trees else tree
                if len(trees) >= HOSTS_AT_ONCE:
                    yield out()
                    trees.clear()
        yield out()

    return pages.select("host", F.col(f"`{html_col}`").alias("page")).mapInArrow(run, "host string, tree string")


def _templates(trees: DataFrame) -> DataFrame:
    """(host, template) from the trees of each host, merged as they come sorted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        host, tree = None, None
        for batch in batches:
            hosts, found = [], []
            for h, t in zip(batch["host"].to_pylist(), batch["tree"], strict=True):
                if tree is not None and h != host:
                    hosts.append(host)
                    found.append(json.dumps(template(tree)))
                    tree = None
                own = raised(json.loads(t.as_py()))
                host, tree = h, own if tree is None else merged(tree, own)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(found, pa.string())], ["host", "template"])
        if tree is not None:
            yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([json.dumps(template(tree))], pa.string())], ["host", "template"])

    return trees.repartition(split_count(trees), "host").sortWithinPartitions("host").mapInArrow(run, "host string, template string")


#: Templates of up to so many characters together are broadcast; beyond, they are joined by host.
BROADCAST_CHARS = 8_000_000


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each whole page; null and empty pages have an empty text.

    Character references are decoded, white space is one space, blocks are joined by a
    space in page order.  A null URL is a host of its own name, ''.  A column named ``out``
    is replaced; repeated rows give repeated results; an empty table gives an empty one.
    """
    own = pages.drop(out, "__host", "__template")
    templates = stored(_templates(_trees(own.withColumn("host", _host(url_col)), html_col)), "templates")
    few = (templates.agg(F.sum(F.length("template"))).first()[0] or 0) <= BROADCAST_CHARS
    own_of = templates.select(F.col("host").alias("__host"), F.col("template").alias("__template"))
    joined = own.withColumn("__host", _host(url_col)).join(F.broadcast(own_of) if few else own_of, "__host", "left").drop("__host")
    names = own.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        known: dict[str, Guide] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = part["__template"].dictionary_encode()
                if len(known) > 256:
                    known.clear()
                guides = []
                for t in coded.dictionary.to_pylist():
                    if t not in known:
                        known[t] = guide(json.loads(t))
                    guides.append(known[t])
                texts = [extract(h.as_py() or "", _NOTHING if i is None else guides[i]) for h, i in zip(part[html_col], coded.indices.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(texts, pa.string())], [*names, out])

    return joined.mapInArrow(run, own.schema.add(out, "string"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
