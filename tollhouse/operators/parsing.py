"""Usage rows from response bodies, whole JSON and event streams.

Only built-in JSON functions: bodies are parsed once with the schema of what is needed, and
of an event stream only the lines that carry usage or a type are parsed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

FIELDS = ("model", "input_tokens", "output_tokens", "total_tokens", "thought_tokens", "cache_read_tokens", "cache_creation_tokens", "id", "finish_reason")
_COUNTS = FIELDS[1:7]
_CHAT = "model string, id string, choices array<struct<finish_reason:string>>, usage struct<prompt_tokens:bigint, completion_tokens:bigint, total_tokens:bigint, prompt_tokens_details:struct<cached_tokens:bigint>, completion_tokens_details:struct<reasoning_tokens:bigint>>"
_RESPONSES = "model string, id string, status string, output array<struct<status:string>>, usage struct<input_tokens:bigint, output_tokens:bigint, total_tokens:bigint, output_tokens_details:struct<reasoning_tokens:bigint>>"
_MESSAGES = "model string, id string, stop_reason string, usage struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>"
_GENERATE = "modelVersion string, responseId string, candidates array<struct<finishReason:string>>, usageMetadata struct<promptTokenCount:bigint, candidatesTokenCount:bigint, totalTokenCount:bigint, thoughtsTokenCount:bigint, cachedContentTokenCount:bigint>"
_CONVERSE = "stopReason string, stop_reason string, usage struct<inputTokens:bigint, outputTokens:bigint, totalTokens:bigint, input_tokens:bigint, output_tokens:bigint, cacheReadInputTokens:bigint, cacheWriteInputTokens:bigint>"


def _usage(**given: Column) -> Column:
    parts = []
    for f in FIELDS:
        c = given.get(f, F.lit(None))
        parts.append((F.coalesce(c, F.lit(0)).cast("long") if f in _COUNTS else F.coalesce(c, F.lit("")).cast("string")).alias(f))
    return F.struct(*parts)


def _chat(j: Column) -> Column:
    u = j["usage"]
    return _usage(model=j["model"], id=j["id"], finish_reason=F.get(j["choices"], F.lit(0))["finish_reason"], input_tokens=u["prompt_tokens"], output_tokens=u["completion_tokens"], total_tokens=F.coalesce(u["total_tokens"], u["prompt_tokens"] + u["completion_tokens"]), thought_tokens=u["completion_tokens_details"]["reasoning_tokens"], cache_read_tokens=u["prompt_tokens_details"]["cached_tokens"])


def _responses(j: Column) -> Column:
    u = j["usage"]
    done = F.filter(j["output"], lambda x: (x["status"] != "in_progress") & x["status"].isNotNull())
    return _usage(model=j["model"], id=j["id"], finish_reason=F.coalesce(F.get(done, F.lit(0))["status"], j["status"]), input_tokens=u["input_tokens"], output_tokens=u["output_tokens"], total_tokens=F.coalesce(u["total_tokens"], u["input_tokens"] + u["output_tokens"]), thought_tokens=u["output_tokens_details"]["reasoning_tokens"])


def _messages(j: Column) -> Column:
    u = j["usage"]
    return _usage(model=j["model"], id=j["id"], finish_reason=j["stop_reason"], input_tokens=u["input_tokens"], output_tokens=u["output_tokens"], total_tokens=u["input_tokens"] + u["output_tokens"], cache_read_tokens=u["cache_read_input_tokens"], cache_creation_tokens=u["cache_creation_input_tokens"])


def _generate(j: Column) -> Column:
    u = j["usageMetadata"]
    return _usage(model=F.coalesce(F.regexp_replace(j["modelVersion"], "^models/", ""), F.lit("gemini")), id=j["responseId"], finish_reason=F.get(j["candidates"], F.lit(0))["finishReason"], input_tokens=u["promptTokenCount"], output_tokens=u["candidatesTokenCount"], total_tokens=u["totalTokenCount"], thought_tokens=u["thoughtsTokenCount"], cache_read_tokens=u["cachedContentTokenCount"])


def _converse(j: Column) -> Column:
    u = j["usage"]
    none = (F.coalesce(u["inputTokens"], F.lit(0)) == 0) & (F.coalesce(u["outputTokens"], F.lit(0)) == 0)
    i, o = F.when(none, u["input_tokens"]).otherwise(u["inputTokens"]), F.when(none, u["output_tokens"]).otherwise(u["outputTokens"])
    total = F.when(F.coalesce(u["totalTokens"], F.lit(0)) > 0, u["totalTokens"]).otherwise(F.coalesce(i, F.lit(0)) + F.coalesce(o, F.lit(0)))
    return _usage(finish_reason=F.coalesce(j["stopReason"], j["stop_reason"]), input_tokens=i, output_tokens=o, total_tokens=total, cache_read_tokens=u["cacheReadInputTokens"], cache_creation_tokens=u["cacheWriteInputTokens"])


def _whole(df: DataFrame, body_col: str, schema: str, f) -> DataFrame:
    parsed = F.from_json(F.col(body_col), schema)
    return df.withColumn("__j", parsed).withColumn("usage", f(F.col("__j"))).drop("__j")


def parse_chat_completion(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Usage of bodies with ``choices``."""
    return _whole(df, body_col, _CHAT, _chat)


def parse_responses_api(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Usage of bodies with ``output``."""
    return _whole(df, body_col, _RESPONSES, _responses)


def parse_messages_api(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Usage of message bodies; the total is input and output."""
    return _whole(df, body_col, _MESSAGES, _messages)


def parse_generate_content(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Usage of bodies with ``usageMetadata``."""
    return _whole(df, body_col, _GENERATE, _generate)


def parse_converse(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Usage in camel case, else in snake case; the model is the request's."""
    return _whole(df, body_col, _CONVERSE, _converse)


def detect_body_shape(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """``df`` with shape: chat, responses, generate, messages, or converse, '' for others; by the top-level names of a body, parsed once."""
    body, has = F.col(body_col), lambda k: F.array_contains("__keys", k)
    converse = has("usage") & body.contains('"inputTokens"')
    shape = F.when(has("choices"), "chat").when(converse, "converse").when(has("output"), "responses").when(has("usageMetadata"), "generate").when(has("usage"), "messages").otherwise("")
    return df.withColumn("__keys", F.json_object_keys(body)).withColumn("shape", shape).drop("__keys")


def detect_stream_shape(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """``df`` with shape of a stream's events, whoever sent it: chat, responses, messages, generate or converse, '' for others."""
    body = F.col(body_col)
    any_of = lambda *parts: reduce(or_, [body.contains(p) for p in parts])
    shape = (
        F.when(F.ltrim(body).startswith("["), "generate")
        .when(body.rlike(r'"type"\s*:\s*"response\.'), "responses")
        .when(any_of('"chat.completion', '"choices"'), "chat")
        .when(any_of('"message_start"', '"message_delta"'), "messages")
        .when(any_of('"usageMetadata"', '"candidates"'), "generate")
        .when(any_of('"inputTokens"', '"stopReason"'), "converse")
        .otherwise("")
    )
    return df.withColumn("shape", F.coalesce(shape, F.lit("")))


def _events(body: Column) -> Column:
    """Payloads of the data lines of a stream that carry usage, a type, a model or an end, up to [DONE]."""
    said = F.get(F.split(body, r"(?:^|\n)data: *\[DONE\] *(?:\r?\n|\r?\z)", 2), F.lit(0))
    return F.regexp_extract_all(said, F.lit(r'(?:^|\n)data:((?=[^\n]*"(?:usage|type"|model|finish|stopReason))[^\n]*)'), F.lit(1))


def _read(body: Column, schema: str) -> Column:
    return F.transform(_events(body), lambda x: F.from_json(x, schema))


def _first(values: Column) -> Column:
    return F.get(F.array_compact(values), F.lit(0))


def _last(values: Column) -> Column:
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def _with(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _chat_stream(e: Column) -> Column:
    finish = _last(F.transform(e, lambda j: F.get(j["choices"], F.lit(0))["finish_reason"]))
    return _with(_last(e["usage"]), lambda u: _usage(model=_first(e["model"]), id=_first(e["id"]), finish_reason=finish, input_tokens=u["prompt_tokens"], output_tokens=u["completion_tokens"], total_tokens=u["total_tokens"], thought_tokens=u["completion_tokens_details"]["reasoning_tokens"], cache_read_tokens=u["prompt_tokens_details"]["cached_tokens"]))


def _responses_stream(e: Column) -> Column:
    kinds = ("response.created", "response.completed", "response.incomplete", "response.failed", "response.done")
    zero = lambda c: F.coalesce(c, F.lit(0))
    counted = lambda j: zero(j["usage"]["input_tokens"]) + zero(j["usage"]["output_tokens"]) + zero(j["usage"]["total_tokens"]) > 0

    def read(said: Column) -> Column:
        # Without tokens anywhere, the last event with usage still says how the response ended.
        told = F.coalesce(_last(F.filter(said, counted)), _last(F.filter(said, lambda j: j["usage"].isNotNull())))
        usage = _with(told, _responses)
        return usage.withField("model", F.coalesce(_first(said["model"]), F.lit(""))).withField("id", F.coalesce(_first(said["id"]), F.lit("")))

    return _with(F.transform(F.filter(e, lambda j: j["type"].isin(*kinds)), lambda j: F.coalesce(j["response"], j["event"])), read)


def _converse_stream(e: Column) -> Column:
    names = [f.name for f in StructType.fromDDL(_CONVERSE)["usage"].dataType.fields]
    alike = lambda u: F.when(u.isNotNull(), F.struct(*[u[n].alias(n) for n in names]))
    used = _last(F.transform(e, lambda j: F.coalesce(alike(j["metadata"]["usage"]), alike(j["usage"]))))
    stop = _last(F.transform(e, lambda j: F.coalesce(j["messageStop"]["stopReason"], j["stopReason"])))
    return _with(F.struct(stop.alias("stopReason"), F.lit(None).cast("string").alias("stop_reason"), used.alias("usage")), _converse)


def _messages_stream(e: Column) -> Column:
    pick = lambda name: F.coalesce(_last(e["usage"][name]), _first(e["message"]["usage"][name]))
    thoughts = F.aggregate(e["delta"]["thinking"], F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    counts = F.struct(pick("input_tokens").alias("i"), pick("output_tokens").alias("o"))
    return _with(counts, lambda c: _usage(model=_first(e["message"]["model"]), id=_first(e["message"]["id"]), finish_reason=_last(e["delta"]["stop_reason"]), input_tokens=c["i"], output_tokens=c["o"], total_tokens=F.coalesce(c["i"], F.lit(0)) + F.coalesce(c["o"], F.lit(0)), thought_tokens=F.floor(thoughts / 4), cache_read_tokens=pick("cache_read_input_tokens"), cache_creation_tokens=pick("cache_creation_input_tokens")))


def _generate_stream(e: Column) -> Column:
    finish = _last(F.transform(e, lambda j: F.get(j["candidates"], F.lit(0))["finishReason"]))
    return _with(_last(F.filter(e, lambda j: j["usageMetadata"].isNotNull())), _generate).withField("finish_reason", F.coalesce(finish, F.lit("")))


def _colons(ddl: str) -> str:
    """The top-level fields of a schema in the form that structs take."""
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part.replace(" ", ":", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def _union(*schemas: str) -> str:
    """One schema of all fields of the given ones; structs of one name are united, equal fields kept once."""

    def united(types: list[StructType]) -> StructType:
        fields: dict[str, list] = {}
        for t in types:
            for f in t.fields:
                fields.setdefault(f.name, []).append(f.dataType)
        return StructType([StructField(name, united(found) if isinstance(found[0], StructType) else found[0]) for name, found in fields.items()])

    return united([StructType.fromDDL(s) for s in schemas]).toDDL()


_RESPONSE_EVENTS = f"type string, response struct<{_colons(_RESPONSES)}>, event struct<{_colons(_RESPONSES)}>"
_MESSAGE_EVENTS = f"type string, message struct<{_colons(_MESSAGES)}>, usage struct<input_tokens:bigint, output_tokens:bigint, cache_read_input_tokens:bigint, cache_creation_input_tokens:bigint>, delta struct<stop_reason:string, thinking:string>"
_CONVERSE_EVENTS = f"{_CONVERSE}, metadata struct<{_colons(_CONVERSE)}>, messageStop struct<{_colons(_CONVERSE)}>"


def _streamed(df: DataFrame, events: Column, f) -> DataFrame:
    return df.withColumn("__e", events).withColumn("usage", f(F.col("__e"))).drop("__e")


def parse_sse_chat(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Streamed chat: first model and id, last finish reason, the chunk with usage; zeros without one."""
    return _streamed(df, _read(F.col(body_col), _CHAT), _chat_stream)


def parse_sse_responses(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Streamed responses: the last event with tokens (in ``response``, else ``event``), else with usage, the first model and id; zeros without one."""
    return _streamed(df, _read(F.col(body_col), _RESPONSE_EVENTS), _responses_stream)


def parse_sse_converse(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Streamed converse events, framing taken off: usage of the metadata event, the stop reason of the message's end; zeros without them."""
    return _streamed(df, _read(F.col(body_col), _CONVERSE_EVENTS), _converse_stream)


def parse_sse_messages(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Streamed messages: input and cache from the start, the last (cumulative) output, thoughts as thinking characters / 4."""
    return _streamed(df, _read(F.col(body_col), _MESSAGE_EVENTS), _messages_stream)


def _read_or_listed(body: Column, schema: str) -> Column:
    """Events of a stream, or the items of a JSON array."""
    listed = F.from_json(body, f"array<{StructType.fromDDL(schema).simpleString()}>")
    return F.when(F.ltrim(body).startswith("["), listed).otherwise(_read(body, schema))


def parse_sse_generate(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """Streamed generation, as events or as a JSON array: the last chunk with usageMetadata."""
    return _streamed(df, _read_or_listed(F.col(body_col), _GENERATE), _generate_stream)


def parse_usage(df: DataFrame) -> DataFrame:
    """One usage row a request (is_streaming, response_body), by the shape of its body whoever sent it; others are nulls with parse_error.

    A JSON object that answers a streaming request is read as a whole body, for providers answer
    errors and some requests so; where it is not known whether a request streams, the body says
    so.  A body is parsed once: whole ones with the fields of all shapes, events of streams
    likewise, but those of responses apart, whose ``delta`` is a text.
    """
    columns, body = df.columns, F.col("response_body")
    whole = F.coalesce(~F.col("is_streaming"), F.lit(False)) | F.coalesce(body.rlike(r"^\s*\{"), F.lit(False))
    split = df.select("*", whole.alias("__w")).select("*", F.when(F.col("__w"), body).alias("__b"), F.when(~F.col("__w"), body).alias("__s"))
    shaped = detect_stream_shape(detect_body_shape(split, "__b").withColumnRenamed("shape", "__whole"), "__s")
    route = F.when(F.col("__w"), F.col("__whole")).otherwise(F.concat(F.lit("sse_"), "shape"))
    routed = shaped.select(*columns, "__b", "__s", route.alias("__route"))
    known, responses = F.col("__route") != "", F.col("__route") == "sse_responses"
    parsed = routed.select(
        *columns,
        "__route",
        F.from_json(F.when(known, F.col("__b")), _union(_CHAT, _RESPONSES, _MESSAGES, _GENERATE, _CONVERSE)).alias("__j"),
        _read_or_listed(F.when(~responses & (F.col("__route") != "sse_"), F.col("__s")), _union(_CHAT, _MESSAGE_EVENTS, _GENERATE, _CONVERSE_EVENTS)).alias("__e"),
        _read(F.when(responses, F.col("__s")), _RESPONSE_EVENTS).alias("__r"),
    )
    j, e, r = F.col("__j"), F.col("__e"), F.col("__r")
    shapes = {
        "chat": _chat(j), "responses": _responses(j), "generate": _generate(j), "messages": _messages(j), "converse": _converse(j),
        "sse_chat": _chat_stream(e), "sse_responses": _responses_stream(r), "sse_generate": _generate_stream(e), "sse_messages": _messages_stream(e), "sse_converse": _converse_stream(e),
    }
    usage = reduce(lambda found, shape: found.when(F.col("__route") == shape[0], shape[1]), shapes.items(), F)
    out = parsed.select(*columns, usage.alias("__u"))
    return out.select(*columns, *[F.col(f"__u.{f}").alias("response_id" if f == "id" else f"usage_{f}") for f in FIELDS], F.col("__u").isNull().alias("parse_error"))


def sse_event_histogram(df: DataFrame, body_col: str = "response_body") -> DataFrame:
    """(request_id, kind, name, n) of event names and type markers."""
    lines = df.select("request_id", F.explode(F.split(body_col, "\r?\n")).alias("line"))
    names = lines.filter(F.col("line").startswith("event:")).select("request_id", F.lit("event").alias("kind"), F.trim(F.substring("line", 7, 1 << 20)).alias("name"))
    types = lines.filter(F.col("line").startswith("data:")).select("request_id", F.lit("type").alias("kind"), F.regexp_extract("line", '"type" *: *"([^"]*)"', 1).alias("name")).filter("name <> ''")
    return names.unionByName(types).groupBy("request_id", "kind", "name").agg(F.count("*").alias("n"))


def extract_request_text(df: DataFrame, body_col: str = "request_body", path_col: str = "path") -> DataFrame:
    """``df`` with model and messages: the texts of messages, input, prompt or contents of a request."""
    part = "array<struct<text:string>>"
    texts = "array<struct<content:string>>"
    j = F.from_json(F.col(body_col), f"model string, prompt string, input string, messages {texts}, contents array<struct<parts:{part}>>")
    df = df.withColumn("__j", j)
    parts = lambda s: F.filter(F.transform(F.from_json(s, part), lambda p: p["text"]), lambda x: x.isNotNull())
    content = lambda s: F.when(F.ltrim(s).startswith("["), parts(s)).otherwise(F.array(s))
    messages = F.flatten(F.transform("__j.messages", lambda m: content(m["content"])))
    contents = F.flatten(F.transform("__j.contents", lambda c: F.transform(c["parts"], lambda p: p["text"])))
    listed = F.from_json(F.col("__j.input"), "array<string>")
    given = F.when(F.ltrim("__j.input").startswith("["), listed).when(F.col("__j.input").isNotNull(), F.array("__j.input"))
    found = F.coalesce(messages, contents, given, F.when(F.col("__j.prompt").isNotNull(), F.array("__j.prompt")), F.array().cast("array<string>"))
    model = F.coalesce(F.col("__j.model"), F.nullif(F.regexp_extract(path_col, r"/models/([^/:?]+)", 1), F.lit("")), F.lit(""))
    return df.withColumns({"model": model, "messages": F.filter(found, lambda x: x.isNotNull())}).drop("__j")


def extract_path_model(df: DataFrame, path_col: str = "path") -> DataFrame:
    """``df`` with the decoded model id of ``/model/{id}/...``."""
    return df.withColumn("model", F.url_decode(F.regexp_extract(path_col, r"/model/([^/]+)/", 1)))


def resolve_user_id(df: DataFrame) -> DataFrame:
    """``df`` (path, x_user_id, request_body, query, bearer, ip) with user_id, from the first source that is not empty."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    return df.withColumn(
        "user_id",
        F.coalesce(
            some(F.regexp_extract("path", r"^/meta/([^/]+)/", 1)),
            some(F.col("x_user_id")),
            some(F.get_json_object("request_body", "$.user")),
            some(F.get_json_object("request_body", "$.metadata.user_id")),
            some(F.regexp_extract("query", r"(?:^|&)llm_user_id=([^&]*)", 1)),
            F.when(some(F.col("bearer")).isNotNull(), F.concat(F.lit("token:"), F.substring("bearer", 1, 8))),
            F.when(some(F.col("ip")).isNotNull(), F.concat(F.lit("ip:"), "ip")),
            F.lit(""),
        ),
    )


def rewrite_meta_path(df: DataFrame, path_col: str = "path", providers: tuple[str, ...] = ("openai", "anthropic", "gemini", "bedrock")) -> DataFrame:
    """``df`` with ``/meta/{user}/{provider}/rest`` as ``/{provider}/rest``, for known providers."""
    return df.withColumn(path_col, F.regexp_replace(path_col, rf"^/meta/[^/]+/({'|'.join(providers)})(/|$)", "/$1$2"))
