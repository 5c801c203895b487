"""Registered queries for provider requests and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from postweave.operators import relay
from postweave.operators.joins import even_join
from postweave.plans.registry import query, table

HOST = "workspace.example"
OVERRIDES = {"vapi": "own-model"}
_NAMES = [p[0] for p in relay.PROVIDERS] + ["other"]


def requests(spark, sf_dir):
    """One request per user turn: provider by conversation, the system turn of the conversation if
    any (empty for every fourth), a model given, empty or null."""
    turns = table(spark, sf_dir, "conversations")
    systems = turns.filter("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    names = F.array(*[F.lit(n) for n in _NAMES])
    users = even_join(turns.filter("role = 'user'"), systems, "conv_id")
    return users.select(
        "conv_id",
        "turn",
        F.get(names, (F.col("conv_id") % 6).cast("int")).alias("provider"),
        F.expr("if(conv_id % 4 = 0, '', system)").alias("system"),
        F.col("text").alias("prompt"),
        F.expr("case turn % 3 when 0 then null when 1 then '' else concat('m', turn) end").alias("model"),
        F.expr("conv_id % 5 <> 1").alias("has_key"),
        F.expr("conv_id % 7 <> 3").alias("has_host"),
        F.expr("cast(turn as double) / 10").alias("temperature"),
    )


def _case(position: int) -> str:
    whens = " ".join(
        f"WHEN '{p[0]}' THEN '{p[position]}'" for p in relay.PROVIDERS if p[position] is not None
    )
    return f"CASE provider {whens} END"


_REQUESTS = f"""WITH sys AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY 1),
req AS (
  SELECT conv_id, turn, [{", ".join(f"'{n}'" for n in _NAMES)}][conv_id % 6 + 1] AS provider,
    CASE WHEN conv_id % 4 = 0 THEN '' ELSE system END AS system, text AS prompt,
    CASE turn % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'm' || turn END AS given,
    conv_id % 5 <> 1 AS has_key, conv_id % 7 <> 3 AS has_host, CAST(turn AS DOUBLE) / 10 AS temperature
  FROM conversations LEFT JOIN sys USING (conv_id) WHERE role = 'user'),
r AS (
  SELECT *, coalesce(nullif(given, ''), CASE WHEN provider = 'vapi' THEN 'own-model' END, {_case(4)}) AS model,
    {_case(1)} AS family,
    CASE WHEN system <> '' THEN '[system]: ' || system || chr(10) || chr(10) || prompt ELSE prompt END AS single,
    CASE WHEN NOT (has_key AND (has_host OR provider <> 'databricks')) THEN {_case(5)} END AS error
  FROM req)"""


def _model():
    return relay.resolve_model(F.col("provider"), F.col("model"), OVERRIDES)


def _error():
    return relay.credential_error(F.col("provider"), F.col("has_key"), F.col("has_host"))


@query("resolve_model", f"{_REQUESTS} SELECT conv_id, turn, provider, model FROM r")
def resolve_model(spark, sf_dir):
    return requests(spark, sf_dir).select("conv_id", "turn", "provider", _model().alias("model"))


@query("validate_credentials", f"{_REQUESTS} SELECT conv_id, turn, error FROM r")
def validate_credentials(spark, sf_dir):
    return requests(spark, sf_dir).select("conv_id", "turn", _error().alias("error"))


@query(
    "chat_messages",
    f"""{_REQUESTS}
SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, 'system' AS role, system AS content FROM r WHERE system <> ''
UNION ALL SELECT conv_id, turn, CASE WHEN system <> '' THEN 1 ELSE 0 END, 'user', prompt FROM r""",
)
def chat_messages(spark, sf_dir):
    messages = relay.chat_messages(F.col("system"), F.col("prompt"))
    rows = requests(spark, sf_dir).select("conv_id", "turn", F.posexplode(messages).alias("pos", "m"))
    return rows.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query("prefix_system", f"{_REQUESTS} SELECT conv_id, turn, single AS message FROM r")
def prefix_system(spark, sf_dir):
    single = relay.prefix_system(F.col("system"), F.col("prompt"))
    return requests(spark, sf_dir).select("conv_id", "turn", single.alias("message"))


_PAYLOAD = f"""CAST(CASE family
  WHEN 'chat' THEN to_json({{'model': model, 'messages': CASE WHEN system <> ''
      THEN [{{'role': 'system', 'content': system}}, {{'role': 'user', 'content': prompt}}]
      ELSE [{{'role': 'user', 'content': prompt}}] END, 'temperature': temperature, 'stream': false}})
  WHEN 'message' THEN to_json({{'model': model, 'message': single, 'temperature': temperature}})
  WHEN 'input' THEN to_json({{'input': single, 'model': model, 'temperature': temperature}}) END AS VARCHAR)"""


@query(
    "request_payload",
    f"""{_REQUESTS}
SELECT conv_id, turn, {_PAYLOAD} AS payload
FROM r""",
)
def request_payload(spark, sf_dir):
    payload = relay.request_payload(
        F.col("provider"), _model(), F.col("system"), F.col("prompt"), F.col("temperature")
    )
    return requests(spark, sf_dir).select("conv_id", "turn", payload.alias("payload"))


@query(
    "request_url",
    f"""WITH p AS (SELECT page_id, [{", ".join(f"'{n}'" for n in _NAMES)}][page_id % 6 + 1] AS provider,
  CASE WHEN page_id % 2 = 0 THEN url || CASE WHEN page_id % 4 = 0 THEN '//' ELSE '' END END AS base FROM pages),
b AS (SELECT *, coalesce(base, replace({_case(2)}, '{{host}}', '{HOST}')) AS root, {_case(3)} AS path FROM p)
SELECT page_id, provider, CASE WHEN path IS NULL THEN root ELSE rtrim(root, '/') || path END AS url FROM b""",
)
def request_url(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.get(names, (F.col("page_id") % 6).cast("int")).alias("provider"),
        F.expr("if(page_id % 2 = 0, concat(url, if(page_id % 4 = 0, '//', '')), null)").alias("base"),
    )
    url = relay.request_url(F.col("provider"), F.lit(HOST), F.col("base"))
    return pages.select("page_id", "provider", url.alias("url"))


@query(
    "build_requests",
    f"""{_REQUESTS},
b AS (SELECT *, coalesce(CASE WHEN turn % 2 = 0 THEN 'https://own.example/' || conv_id || '/' END,
    replace({_case(2)}, '{{host}}', '{HOST}')) AS root, {_case(3)} AS path FROM r)
SELECT conv_id, turn, model, error,
  CASE WHEN error IS NULL THEN CASE WHEN path IS NULL THEN root ELSE rtrim(root, '/') || path END END AS url,
  CASE WHEN error IS NULL THEN {_PAYLOAD} END AS payload FROM b""",
)
def build_requests(spark, sf_dir):
    """The request table; every other request goes to an address of its own."""
    own = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://own.example/"), "conv_id", F.lit("/")))
    built = relay.build_requests(requests(spark, sf_dir), HOST, OVERRIDES, own)
    return built.select("conv_id", "turn", "model", "error", "url", "payload")


# ---- replies -------------------------------------------------------------------------------


def replies(spark, sf_dir):
    """A JSON reply per request in the shape of its family, complete and incomplete ones."""
    rows = requests(spark, sf_dir).withColumn("kind", relay.family(F.col("provider")))
    chat = """case turn % 4 when 0 then '{"choices":[]}' when 1 then '{"error":"overloaded"}'
      else to_json(named_struct('choices', array(named_struct('message', named_struct('content', prompt))))) end"""
    message = """case conv_id % 4 when 0 then to_json(named_struct('text', '', 'output_text', prompt))
      when 1 then to_json(named_struct('text', '', 'generations', array(named_struct('text', prompt))))
      when 2 then '{"text":"","output_text":"","generations":[{"text":"no"}]}'
      else to_json(named_struct('text', prompt, 'output_text', 'no')) end"""
    output = """case conv_id % 4 when 0 then to_json(named_struct('output', prompt, 'message', 'no'))
      when 1 then to_json(named_struct('text', '', 'message', named_struct('content', 'x')))
      when 2 then '{"other":1}' else to_json(named_struct('text', prompt)) end"""
    raw = F.expr(f"case kind when 'chat' then {chat} when 'message' then {message} when 'input' then {output} end")
    return rows.withColumns({"raw": raw, "error": _error(), "model": _model()})


# The text that each reply must give, from the rules above and not from the JSON.
_CHAT = "CASE WHEN turn % 4 IN (0, 1) THEN NULL ELSE prompt END"
_TEXT = "CASE conv_id % 4 WHEN 2 THEN '' ELSE prompt END"
_OUTPUT = """CASE conv_id % 4 WHEN 1 THEN '{"content":"x"}' WHEN 2 THEN NULL ELSE prompt END"""
# The replies as they come.
_RAW = """CAST(CASE family
  WHEN 'chat' THEN CASE turn % 4 WHEN 0 THEN '{"choices":[]}' WHEN 1 THEN '{"error":"overloaded"}'
    ELSE CAST(to_json({'choices': [{'message': {'content': prompt}}]}) AS VARCHAR) END
  WHEN 'message' THEN CASE conv_id % 4 WHEN 0 THEN CAST(to_json({'text': '', 'output_text': prompt}) AS VARCHAR)
    WHEN 1 THEN CAST(to_json({'text': '', 'generations': [{'text': prompt}]}) AS VARCHAR)
    WHEN 2 THEN '{"text":"","output_text":"","generations":[{"text":"no"}]}'
    ELSE CAST(to_json({'text': prompt, 'output_text': 'no'}) AS VARCHAR) END
  WHEN 'input' THEN CASE conv_id % 4 WHEN 0 THEN CAST(to_json({'output': prompt, 'message': 'no'}) AS VARCHAR)
    WHEN 1 THEN '{"text":"","message":{"content":"x"}}' WHEN 2 THEN '{"other":1}'
    ELSE CAST(to_json({'text': prompt}) AS VARCHAR) END END AS VARCHAR)"""
_ROUTED = f"""{_REQUESTS},
o AS (SELECT *, CAST(CASE WHEN family IS NULL THEN 2 WHEN error IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS code,
  CASE family WHEN 'chat' THEN {_CHAT} WHEN 'message' THEN {_TEXT} WHEN 'input' THEN {_OUTPUT} END AS reply FROM r)"""


def _of_family(spark, sf_dir, name, text):
    rows = replies(spark, sf_dir).filter(F.col("kind") == name)
    return rows.select("conv_id", "turn", text(F.col("raw")).alias("text"))


@query("reply_chat", f"{_REQUESTS} SELECT conv_id, turn, {_CHAT} AS text FROM r WHERE family = 'chat'")
def reply_chat(spark, sf_dir):
    return _of_family(spark, sf_dir, "chat", relay.reply_chat)


@query("reply_text_chain", f"{_REQUESTS} SELECT conv_id, turn, {_TEXT} AS text FROM r WHERE family = 'message'")
def reply_text_chain(spark, sf_dir):
    return _of_family(spark, sf_dir, "message", relay.reply_text_chain)


@query("reply_output_chain", f"{_REQUESTS} SELECT conv_id, turn, {_OUTPUT} AS text FROM r WHERE family = 'input'")
def reply_output_chain(spark, sf_dir):
    return _of_family(spark, sf_dir, "input", relay.reply_output_chain)


@query(
    "route_provider",
    f"""{_ROUTED} SELECT conv_id, turn, provider, code, CASE WHEN code = 0 THEN reply END AS output_text FROM o""",
)
def route_provider(spark, sf_dir):
    routed = relay.route_replies(replies(spark, sf_dir))
    return routed.select("conv_id", "turn", "provider", "code", "output_text")


@query(
    "select_output",
    f"""{_ROUTED} SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN
    rtrim(CAST(to_json({{'provider': provider, 'model': model, 'output_text': reply}}) AS VARCHAR), '}}')
      || ',"raw":' || {_RAW} || '}}'
  ELSE coalesce(reply, '') END AS output FROM o WHERE code = 0""",
)
def select_output(spark, sf_dir):
    routed = relay.route_replies(replies(spark, sf_dir)).filter("code = 0")
    whole = relay.result_json(F.col("provider"), F.col("model"), F.col("output_text"), F.col("raw"))
    output = relay.select_output(F.col("turn") % 2 == 0, whole, F.col("output_text"))
    return routed.select("conv_id", "turn", output.alias("output"))


@query(
    "failure_message",
    """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, props FROM events)
SELECT event_id, CASE k % 5 WHEN 3 THEN 'Network error calling https://api.example/' || event_type || ': timed out'
  WHEN 1 THEN 'HTTP 404 calling https://api.example/' || event_type || ': ' || props
  WHEN 2 THEN 'HTTP 500 calling https://api.example/' || event_type || ': ' || props END AS failure FROM e""",
)
def failure_message(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    calls = events.selectExpr(
        "event_id",
        "props as body",
        "concat('https://api.example/', event_type) as url",
        "case k % 5 when 1 then 404 when 2 then 500 when 3 then null else 200 end as status",
        "case when k % 5 = 3 then 'timed out' end as reason",
    )
    failure = relay.failure_message(F.col("status"), F.col("url"), F.col("body"), F.col("reason"))
    return calls.select("event_id", failure.alias("failure"))
