"""Queries of parsing, masking and tokens: bodies are built from the log's columns and parsed back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollhouse.functions import ids as I
from tollhouse.operators import parsing as S
from tollhouse.operators import pricing as P
from tollhouse.plans.adapter import Tables
from tollhouse.plans.registry import query

_ROW = "SELECT request_id, model AS usage_model, input_tokens AS usage_in, output_tokens AS usage_out, input_tokens + output_tokens AS usage_total, 'id-' || request_id AS usage_id, {finish} AS finish FROM usage"


def _id() -> Column:
    return F.concat(F.lit("id-"), F.col("request_id").cast("string"))


def _in() -> Column:
    return F.col("input_tokens")


def _out() -> Column:
    return F.col("output_tokens")


def _s(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def chat_body() -> Column:
    """A chat completion."""
    return F.to_json(_s(id=_id(), model=F.col("model"), choices=F.array(_s(index=F.lit(0), finish_reason=F.lit("stop"))), usage=_s(prompt_tokens=_in(), completion_tokens=_out(), total_tokens=_in() + _out())))


def messages_body() -> Column:
    """A message."""
    return F.to_json(_s(id=_id(), type=F.lit("message"), model=F.col("model"), stop_reason=F.lit("end_turn"), usage=_s(input_tokens=_in(), output_tokens=_out(), cache_read_input_tokens=F.lit(5))))


def generate_body() -> Column:
    """A generated content."""
    return F.to_json(_s(modelVersion=F.concat(F.lit("models/"), "model"), responseId=_id(), candidates=F.array(_s(finishReason=F.lit("STOP"))), usageMetadata=_s(promptTokenCount=_in(), candidatesTokenCount=_out(), totalTokenCount=_in() + _out())))


def _flat(df: DataFrame) -> DataFrame:
    u = F.col("usage")
    return df.select("request_id", u["model"].alias("usage_model"), u["input_tokens"].alias("usage_in"), u["output_tokens"].alias("usage_out"), u["total_tokens"].alias("usage_total"), u["id"].alias("usage_id"), u["finish_reason"].alias("finish"))


def _body(t: Tables, body: Column) -> DataFrame:
    return t.usage.withColumn("response_body", body)


query("parse_chat_completion", _ROW.format(finish="'stop'"))(lambda t: _flat(S.parse_chat_completion(_body(t, chat_body()))))
query("parse_messages_api", _ROW.format(finish="'end_turn'"))(lambda t: _flat(S.parse_messages_api(_body(t, messages_body()))))
query("parse_generate_content", _ROW.format(finish="'STOP'"))(lambda t: _flat(S.parse_generate_content(_body(t, generate_body()))))
query("parse_responses_api", _ROW.format(finish="'completed'"))(
    lambda t: _flat(S.parse_responses_api(_body(t, F.to_json(_s(id=_id(), model=F.col("model"), output=F.array(_s(status=F.lit("in_progress")), _s(status=F.lit("completed"))), usage=_s(input_tokens=_in(), output_tokens=_out(), total_tokens=_in() + _out()))))))
)
query("parse_converse", _ROW.format(finish="'end_turn'").replace("model AS usage_model", "'' AS usage_model").replace("'id-' || request_id AS usage_id", "'' AS usage_id"))(
    lambda t: _flat(S.parse_converse(_body(t, F.when(F.col("request_id") % 2 == 0, F.to_json(_s(stopReason=F.lit("end_turn"), usage=_s(inputTokens=_in(), outputTokens=_out())))).otherwise(F.to_json(_s(stop_reason=F.lit("end_turn"), usage=_s(input_tokens=_in(), output_tokens=_out())))))))
)
query("detect_body_shape", "SELECT request_id, CASE request_id % 4 WHEN 0 THEN 'chat' WHEN 1 THEN 'messages' WHEN 2 THEN 'generate' ELSE '' END AS shape FROM usage")(
    lambda t: S.detect_body_shape(_body(t, F.when(F.col("request_id") % 4 == 0, chat_body()).when(F.col("request_id") % 4 == 1, messages_body()).when(F.col("request_id") % 4 == 2, generate_body()).otherwise("not json"))).select("request_id", "shape")
)


def _lines(*parts: Column) -> Column:
    return F.concat(*[F.concat(F.lit("data: "), p, F.lit("\n\n")) for p in parts])


def sse_chat() -> Column:
    """A streamed chat."""
    delta = F.to_json(_s(id=_id(), model=F.col("model"), choices=F.array(_s(delta=_s(content=F.lit("hi"))))))
    end = F.to_json(_s(id=_id(), model=F.col("model"), choices=F.array(_s(finish_reason=F.lit("stop")))))
    used = F.to_json(_s(id=_id(), model=F.col("model"), usage=_s(prompt_tokens=_in(), completion_tokens=_out(), total_tokens=_in() + _out())))
    return _lines(delta, delta, end, used, F.lit("[DONE]"))


def sse_messages() -> Column:
    """A streamed message; outputs are cumulative."""
    start = F.to_json(_s(type=F.lit("message_start"), message=_s(id=_id(), model=F.col("model"), usage=_s(input_tokens=_in(), output_tokens=F.lit(1)))))
    half = F.to_json(_s(type=F.lit("message_delta"), usage=_s(output_tokens=F.expr("output_tokens div 2"))))
    end = F.to_json(_s(type=F.lit("message_delta"), delta=_s(stop_reason=F.lit("end_turn")), usage=_s(output_tokens=_out())))
    return F.concat(F.lit("event: message_start\n"), _lines(start), F.lit("event: message_delta\n"), _lines(half), F.lit("event: message_delta\n"), _lines(end))


query("parse_sse_chat", _ROW.format(finish="'stop'"))(lambda t: _flat(S.parse_sse_chat(_body(t, sse_chat()))))
query("parse_sse_messages", _ROW.format(finish="'end_turn'"))(lambda t: _flat(S.parse_sse_messages(_body(t, sse_messages()))))
query("parse_sse_generate", _ROW.format(finish="'STOP'"))(
    lambda t: _flat(S.parse_sse_generate(_body(t, F.when(F.col("request_id") % 2 == 0, _lines(generate_body(), generate_body())).otherwise(F.concat(F.lit("["), generate_body(), F.lit("]"))))))
)
query("parse_sse_responses", _ROW.format(finish="'completed'"))(
    lambda t: _flat(S.parse_sse_responses(_body(t, _lines(F.to_json(_s(type=F.lit("response.created"))), F.to_json(_s(type=F.lit("response.completed"), response=_s(id=_id(), model=F.col("model"), status=F.lit("completed"), usage=_s(input_tokens=_in(), output_tokens=_out(), total_tokens=_in() + _out()))))))))
)
def converse_body() -> Column:
    """A converse answer; its model is the request's."""
    return F.to_json(_s(output=_s(message=_s(role=F.lit("assistant"))), stopReason=F.lit("end_turn"), usage=_s(inputTokens=_in(), outputTokens=_out(), totalTokens=_in() + _out())))


def responses_body() -> Column:
    """A response."""
    return F.to_json(_s(id=_id(), model=F.col("model"), output=F.array(_s(status=F.lit("in_progress")), _s(status=F.lit("completed"))), usage=_s(input_tokens=_in(), output_tokens=_out(), total_tokens=_in() + _out())))


def sse_responses() -> Column:
    """A streamed response."""
    made = F.to_json(_s(type=F.lit("response.created"), response=_s(id=_id(), model=F.col("model"))))
    text = F.to_json(_s(type=F.lit("response.output_text.delta"), delta=F.lit('say "choices" and "message_start"')))
    end = F.to_json(_s(type=F.lit("response.completed"), response=_s(id=_id(), model=F.col("model"), output=F.array(_s(status=F.lit("completed"))), usage=_s(input_tokens=_in(), output_tokens=_out(), total_tokens=_in() + _out()))))
    return _lines(made, text, end)


def sse_converse() -> Column:
    """Events of a streamed converse answer."""
    return _lines(F.to_json(_s(messageStop=_s(stopReason=F.lit("end_turn")))), F.to_json(_s(metadata=_s(usage=_s(inputTokens=_in(), outputTokens=_out(), totalTokens=_in() + _out())))))


#: Bodies of all shapes in turn, whatever the provider; one is broken and one missing.
def _bodies() -> Column:
    every = (chat_body(), messages_body(), generate_body(), responses_body(), converse_body(), sse_chat(), sse_messages(), _lines(generate_body(), generate_body()), F.concat(F.lit("["), generate_body(), F.lit("]")), sse_responses(), sse_converse(), F.lit("{broken"), F.lit(None).cast("string"))
    body = F.lit(None).cast("string")
    for i, b in enumerate(every):
        body = F.when(F.col("request_id") % 13 == i, b).otherwise(body)
    return body


query("parse_usage", """SELECT request_id, provider, request_id % 13 >= 11 AS parse_error, CASE WHEN request_id % 13 >= 11 THEN NULL WHEN request_id % 13 IN (4, 10) THEN '' ELSE model END AS usage_model, CASE WHEN request_id % 13 < 11 THEN input_tokens END AS usage_input_tokens,
  CASE WHEN request_id % 13 < 11 THEN output_tokens END AS usage_output_tokens, CASE WHEN request_id % 13 < 11 THEN input_tokens + output_tokens END AS usage_total_tokens,
  CASE request_id % 13 WHEN 0 THEN 'stop' WHEN 5 THEN 'stop' WHEN 1 THEN 'end_turn' WHEN 4 THEN 'end_turn' WHEN 6 THEN 'end_turn' WHEN 10 THEN 'end_turn' WHEN 3 THEN 'completed' WHEN 9 THEN 'completed' WHEN 11 THEN NULL WHEN 12 THEN NULL ELSE 'STOP' END AS usage_finish_reason FROM usage""")(
    lambda t: S.parse_usage(t.usage.select("request_id", "provider", (F.col("request_id") % 13).between(5, 10).alias("is_streaming"), _bodies().alias("response_body"))).select(
        "request_id", "provider", "parse_error", "usage_model", "usage_input_tokens", "usage_output_tokens", "usage_total_tokens", "usage_finish_reason"
    )
)
query("parse_sse_converse", _ROW.format(finish="'end_turn'").replace("model AS usage_model", "'' AS usage_model").replace("'id-' || request_id AS usage_id", "'' AS usage_id"))(lambda t: _flat(S.parse_sse_converse(_body(t, sse_converse()))))
query("sse_event_histogram", "SELECT request_id, k AS kind, n AS name, CAST(c AS BIGINT) AS n FROM usage, (VALUES ('event', 'message_start', 1), ('event', 'message_delta', 2), ('type', 'message_start', 1), ('type', 'message_delta', 2)) AS v(k, n, c)")(lambda t: S.sse_event_histogram(_body(t, sse_messages())))


def _requests(t: Tables) -> DataFrame:
    i = F.col("request_id")
    texts = F.array(_s(role=F.lit("user"), content=F.concat(F.lit("q"), i.cast("string"))), _s(role=F.lit("user"), content=F.lit("more")))
    body = F.when(i % 3 == 0, F.to_json(_s(model=F.col("model"), messages=texts, user=F.when(i % 2 == 0, F.col("user_id"))))).when(i % 3 == 1, F.to_json(_s(contents=F.array(_s(parts=F.array(_s(text=F.concat(F.lit("q"), i.cast("string"))), _s(text=F.lit("more")))))))).otherwise(F.to_json(_s(model=F.col("model"), prompt=F.concat(F.lit("q"), i.cast("string")))))
    path = F.when(i % 3 == 1, F.concat(F.lit("/v1/models/"), "model", F.lit(":generate"))).otherwise(F.concat(F.lit("/meta/m"), i.cast("string"), F.lit("/openai/v1/chat")))
    return t.usage.select("request_id", "key_id", "user_id", F.col("model").alias("true_model"), body.alias("request_body"), path.alias("path"), F.lit("").alias("x_user_id"), F.lit("a=1&llm_user_id=").alias("query"), F.col("key_id").alias("bearer"), F.lit("10.1.2.3").alias("ip"))


query("extract_request_text", "SELECT request_id, model, CASE WHEN request_id % 3 = 2 THEN 'q' || request_id ELSE 'q' || request_id || '|more' END AS texts FROM usage")(lambda t: S.extract_request_text(_requests(t)).select("request_id", "model", F.concat_ws("|", "messages").alias("texts")))
query("extract_path_model", "SELECT request_id, model || ':v1' AS model FROM usage")(lambda t: S.extract_path_model(t.usage.select("request_id", F.concat(F.lit("/model/"), "model", F.lit("%3Av1/converse")).alias("path"))).select("request_id", "model"))
query("resolve_user_id", "SELECT request_id, CASE WHEN request_id % 3 <> 1 THEN 'm' || request_id ELSE 'token:' || substr(key_id, 1, 8) END AS user_id FROM usage")(lambda t: S.resolve_user_id(_requests(t).drop("user_id")).select("request_id", "user_id"))
query("rewrite_meta_path", "SELECT request_id, CASE WHEN request_id % 3 = 1 THEN '/v1/models/' || model || ':generate' ELSE '/openai/v1/chat' END AS path FROM usage")(lambda t: S.rewrite_meta_path(_requests(t)).select("request_id", "path"))

_HASH = "lower(lpad(printf('%x', list_reduce(list_concat([2166136261::UBIGINT], list_transform(string_split(key_id, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296)), 8, '0'))"
query("mask_key_id", f"SELECT DISTINCT key_id, substr(key_id, 1, 12) || '…' || {_HASH} AS masked FROM usage")(lambda t: t.usage.select("key_id").distinct().withColumn("masked", I.mask_key_id(F.col("key_id"))))
query("mask_provider_credential", f"SELECT DISTINCT key_id, 'sk-…' || {_HASH} AS masked FROM usage")(lambda t: t.usage.select("key_id").distinct().withColumn("masked", I.mask_provider_credential(F.col("key_id"))))
query("parse_masked_id", f"SELECT DISTINCT key_id, substr(key_id, 1, 12) AS prefix, {_HASH} AS hash FROM usage")(lambda t: t.usage.select("key_id").distinct().withColumn("p", I.parse_masked_id(I.mask_key_id(F.col("key_id")))).select("key_id", "p.prefix", "p.hash"))
query("parse_breaker_key", "SELECT request_id, provider, CASE WHEN request_id % 4 = 0 THEN '' ELSE model END AS model, CASE WHEN request_id % 4 = 0 THEN 'provider' ELSE 'model' END AS scope FROM usage")(
    lambda t: t.usage.select("request_id", I.parse_breaker_key(F.when(F.col("request_id") % 4 == 0, F.col("provider")).otherwise(F.concat_ws(":", "provider", "model"))).alias("k")).select("request_id", "k.*")
)
query("scope_kind_label", "SELECT request_id, CASE request_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'model' ELSE 'user' END AS kind, CASE request_id % 3 WHEN 0 THEN 'global' WHEN 1 THEN model ELSE 'ip:10.1.x.x' END AS label FROM usage")(
    lambda t: t.usage.select("request_id", I.scope_kind_label(F.when(F.col("request_id") % 3 == 0, "global").when(F.col("request_id") % 3 == 1, F.concat(F.lit("model:"), "model")).otherwise("user:ip:10.1.2.3")).alias("s")).select("request_id", "s.*")
)
query("estimate_tokens", "SELECT request_id, CASE WHEN request_id % 5 = 0 OR input_tokens > 20000 OR output_tokens // 5 = 0 THEN input_tokens // 4 ELSE output_tokens // 5 END AS est_tokens FROM usage")(
    lambda t: P.estimate_tokens(t.usage.withColumns({"chars": F.when(F.col("request_id") % 5 == 0, 0).otherwise(_out()), "bytes": _in()}), "chars", "bytes", 5, 4, 20_000).select("request_id", "est_tokens")
)
