"""Queries over request bodies, tool results, responses and the library's open ends, and the SQL that checks them.

The tables hold plain texts only, so bodies and payloads are built from them by fixed rules, with the same shapes in
the query and in its SQL.
"""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import sql as S
from ..functions import text as X
from ..operators import compressors, model_requests, tools
from ..operators.config import Config
from ..sources import messages as R
from . import pipeline as P
from . import queries as Q
from . import reports

CONFIG = Q.CONFIG

#: Of each message of a conversation one of four shapes; {t} is its text as JSON.
SHAPES = [
    """'{"role": "', role, '", "content": ', {t}, ', "name": "n', turn, '"}'""",
    """'{"role":"', role, '","content":[{"type":"text","text":', {t}, ',"x":1.0},{"type":"image","source":{"data":"x"}}]}'""",
    """'{"role":"tool","tool_call_id":"c', turn, '","content":[{"type":"tool_result","tool_use_id":"t","content":', {t}, '}]}'""",
    """'{"content": ', {t}, '}'""",
]
BODY = """concat('{"model": "m", "messages": ', {m}, ', "stream": false}')"""
FIELDS = ["CASE WHEN conv_id % 5 = 0 THEN 'GET' ELSE 'POST' END AS method", "CASE conv_id % 3 WHEN 0 THEN '/v1/messages' WHEN 1 THEN '/v1/chat/completions' ELSE '/v1/other' END AS path"]
LOG = ", ".join(FIELDS)
RESULT = """CASE doc_id % 5 WHEN 0 THEN concat('{"task":{"taskId":"a"},"content":[{"type":"text","text":', {t}, '}]}') WHEN 1 THEN concat('{"content":', {t}, '}') ELSE concat('{"content":[{"type":"text","text":', {u}, '}],"structuredContent":{"content":', {t}, '}', {more}, '}') END"""
KIND = "CASE doc_id % 4 WHEN 0 THEN 'tasks/result' WHEN 1 THEN 'tasks/get' ELSE 'tools/call' END"
SAMPLING = """concat('{"role":"', role, '","content":{"type":"text","text":', {t}, '},"n":', turn, '}')"""


def _fill(template: str, **parts: str) -> str:
    """A template with its {names} filled in; the braces of its JSON stay."""
    for name, part in parts.items():
        template = template.replace("{" + name + "}", part)
    return template


def _shape(t: str) -> str:
    return "CASE (conv_id + turn) % 4 " + " ".join(f"WHEN {i} THEN concat({_fill(s, t=t)})" for i, s in enumerate(SHAPES)) + " END"


def _conversations(spark, sf_dir):
    return Q._table(spark, sf_dir, "conversations").withColumn("t", M.text_content("text"))


def _lists(rows, message: str):
    one = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.expr(message).alias("m")))), lambda x: x["m"]).alias("ms"))
    return one.withColumn("m", F.concat(F.lit("["), F.array_join("ms", ","), F.lit("]")))


def _log(spark, sf_dir):
    return _lists(_conversations(spark, sf_dir), _shape("t")).selectExpr("conv_id AS request_id", *FIELDS, _fill(BODY, m="m") + " AS body")


def request_messages(spark, sf_dir):
    return R.requests(_log(spark, sf_dir)).select("conv_id", "turn", "role", "text", "tool_linked", "content")


def request_bodies(spark, sf_dir):
    log = _log(spark, sf_dir)
    short = P.compress_messages(R.requests(log), CONFIG)
    return R.write_back(log, short)


def stream_bodies(spark, sf_dir):
    from ..streaming.requests import compress_requests

    return compress_requests(_log(spark, sf_dir), CONFIG).select("request_id", "method", "path", "body")


def tool_results(spark, sf_dir):
    docs = Q._spread(spark, sf_dir).withColumn("t", M.text_content("text"))
    rows = docs.selectExpr("doc_id AS request_id", KIND + " AS kind", _fill(RESULT, t="t", u="t", more="''") + " AS payload")
    return tools.compress_traffic(rows, CONFIG)


def sampling(spark, sf_dir):
    rows = _lists(_conversations(spark, sf_dir), _fill(SAMPLING, t="t"))
    rows = rows.selectExpr("conv_id AS request_id", "'sampling/createMessage' AS kind", """concat('{"maxTokens":5,"messages":', m, '}') AS payload""")
    return tools.compress_traffic(rows, CONFIG)


def annotate_responses(spark, sf_dir):
    stats = Q.pipeline_stats(spark, sf_dir).withColumnRenamed("conv_id", "request_id")
    responses = stats.selectExpr("request_id", "request_id % 4 = 0 AS stream", "CASE WHEN request_id % 5 > 0 THEN 'u' END AS usage")
    return R.annotate(responses, stats).select("request_id", "stream", "telemetry.*")


def empty_lists(spark, sf_dir):
    messages = Q._messages(spark, sf_dir)
    lists = messages.select("conv_id").distinct().union(messages.selectExpr("-1 - conv_id").distinct())
    return P.conversation_stats(P.compress_messages(messages, Config(mode="on", threshold_tokens=1_000_000_000)), lists)


def custom_pipeline(spark, sf_dir):
    """A strategy of the caller's, a registered compressor, a route to an unknown one and a label that doesn't exist."""
    head = lambda text, config: F.struct(F.substring(text, 1, 40).alias("text"), X.token_count(text).alias("input_tokens"), X.token_count(F.substring(text, 1, 40)).alias("output_tokens"))
    compressors.register("head", head)
    config = Config(mode="on", threshold_tokens=0, last_turns=1, dedup=False, purge_after=None, routing={"code": "head", "error": "nope", "nope": "extract"})
    users = lambda messages: messages.where("role <> 'system'")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return P.compress_messages(Q._messages(spark, sf_dir), config, (users,))


def term_coverage(spark, sf_dir):
    return reports.coverage(Q._spread(spark, sf_dir), Q.RATIO).select("doc_id", "coverage")


_LEFT = """concat('{"a": 1.0, "b": [true, null], "id": ', event_id, ', "kind": "', event_type, '"}')"""
_RIGHT = """concat('{"kind":"', event_type, '","b":[true,null],"id":', event_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, ',"a":1}')"""


def agreement_report(spark, sf_dir):
    events = Q._table(spark, sf_dir, "events")
    return reports.agreement(*(events.selectExpr("event_id", "event_type", f"{x} AS json") for x in (_LEFT, _RIGHT)), "event_id", "event_type")


def sql_functions(spark, sf_dir):
    S.register(spark)
    Q._messages(spark, sf_dir).createOrReplaceTempView("thresher_messages")
    return spark.sql("SELECT conv_id, turn, token_count(text) AS tokens, message_label(text) AS label, CAST(size(word_list(text)) AS BIGINT) AS words FROM thresher_messages")


def model_bodies(spark, sf_dir):
    out = None
    for i, provider in enumerate([model_requests.Provider("anthropic"), model_requests.Provider("openai", "gpt-5-mini"), model_requests.Provider("gemini")]):
        some = model_requests.requests(Q._table(spark, sf_dir, "conversations").where(f"turn % 3 = {i}"), provider).select("conv_id", "turn", "url", "body")
        out = some if out is None else out.union(some)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        request_messages, request_bodies, stream_bodies, tool_results, sampling, annotate_responses, empty_lists, custom_pipeline, term_coverage, agreement_report, sql_functions, model_bodies,
    )
}

_J = "to_json({})::varchar"
# Conversations as the pipeline leaves them; tool messages and those without a role have the roles of their shapes.
_ROLES = "c AS (SELECT conv_id, turn, role AS own, text, CASE (conv_id + turn) % 4 WHEN 2 THEN 'tool' WHEN 3 THEN NULL ELSE role END AS role FROM conversations)"
_DONE = f"WITH RECURSIVE {_ROLES}, d AS (SELECT conv_id, turn, role, text FROM c), {Q._RUN.replace("role = 'system'", "coalesce(role, '') = 'system'")}, s AS (SELECT c.conv_id, c.turn, c.own AS role, done.text FROM c JOIN done ON c.conv_id = done.conv_id AND c.turn = done.turn)"
_OLD = f"o AS (SELECT conv_id, string_agg({_shape(_J.format('text'))}, ',' ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"
_NEW = f"n AS (SELECT conv_id, string_agg({_shape(_J.format('text'))}, ',' ORDER BY turn) AS m FROM s GROUP BY conv_id)"
_CARRIES = "method = 'POST' AND path <> '/v1/other'"
_BODIES = f"{_DONE}, {_OLD}, {_NEW} SELECT request_id, method, path, CASE WHEN {_CARRIES} THEN new ELSE old END AS body FROM (SELECT o.conv_id AS request_id, {LOG.replace('conv_id', 'o.conv_id')}, {_fill(BODY, m="'[' || o.m || ']'")} AS old, {_fill(BODY, m="'[' || n.m || ']'")} AS new FROM o JOIN n ON o.conv_id = n.conv_id)"
_META = """concat(',"_meta":{"thresher":{"tokensSaved":', input_tokens - output_tokens, ',"ratio":', output_tokens::double / input_tokens, ',"method":"extract"}}')"""


def _parts(kind: str) -> str:
    return {
        "role": "CASE (conv_id + turn) % 4 WHEN 2 THEN 'tool' WHEN 3 THEN NULL ELSE role END",
        "content": "CASE (conv_id + turn) % 4 WHEN 1 THEN concat('[{\"type\":\"text\",\"text\":', to_json(text)::varchar, ',\"x\":1.0},{\"type\":\"image\",\"source\":{\"data\":\"x\"}}]') WHEN 2 THEN concat('[{\"type\":\"tool_result\",\"tool_use_id\":\"t\",\"content\":', to_json(text)::varchar, '}]') ELSE to_json(text)::varchar END",
    }[kind]


def _body(provider: model_requests.Provider) -> tuple[str, str]:
    url, _, body = provider.build("\x01")
    before, after = body.replace("'", "''").split("\\u0001")
    return url, f"concat('{before}', substr(to_json(text)::varchar, 2, length(to_json(text)::varchar) - 2), '{after}')"


_PROVIDERS = [_body(p) for p in (model_requests.Provider("anthropic"), model_requests.Provider("openai", "gpt-5-mini"), model_requests.Provider("gemini"))]

ORACLES = {
    "request_messages": f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS turn, {_parts('role')} AS role, text, (conv_id + turn) % 4 = 2 AS tool_linked, {_parts('content')} AS content FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id, {LOG} FROM conversations) WHERE {_CARRIES})",
    "request_bodies": _BODIES,
    "stream_bodies": _BODIES,
    "tool_results": f"WITH RECURSIVE {Q._DOCS}, {Q._EXT}, x AS (SELECT doc_id, {KIND} AS kind, original, text, input_tokens, output_tokens, doc_id % 4 <> 1 AND doc_id % 5 > 1 AND {Q._tok('original')} >= {CONFIG.threshold_tokens} AND {Q._label('original')} = 'prose' AND output_tokens < input_tokens AS short FROM ext WHERE original IS NOT NULL) SELECT doc_id AS request_id, kind, CASE WHEN short THEN {_fill(RESULT, t=_J.format('original'), u=_J.format('text'), more=_META)} ELSE {_fill(RESULT, t=_J.format('original'), u=_J.format('original'), more="''")} END AS payload, CASE WHEN short THEN input_tokens - output_tokens END AS tokens_saved FROM x UNION ALL SELECT doc_id, {KIND}, NULL, NULL FROM documents WHERE text IS NULL",
    "sampling": f"WITH RECURSIVE d AS (SELECT conv_id, turn, role, text FROM conversations), {Q._RUN}, z AS (SELECT conv_id, string_agg({_fill(SAMPLING, t=_J.format('text'))}, ',' ORDER BY turn) AS m, sum(input_tokens - output_tokens)::bigint AS saved FROM done GROUP BY conv_id) SELECT conv_id AS request_id, 'sampling/createMessage' AS kind, concat('{{\"maxTokens\":5,\"messages\":[', m, ']}}') AS payload, CASE WHEN saved > 0 THEN saved END AS tokens_saved FROM z",
    "annotate_responses": f"WITH RECURSIVE {Q._M}, {Q._DEDUP}, {Q._RUN}, a AS (SELECT *, conv_id % 4 > 0 AND conv_id % 5 > 0 AS told FROM stats) SELECT conv_id AS request_id, conv_id % 4 = 0 AS stream, CASE WHEN told THEN input_tokens - output_tokens END AS tokens_saved, CASE WHEN told THEN ratio END AS ratio, CASE WHEN told THEN method END AS method FROM a",
    "empty_lists": f"WITH {Q._M}, {Q._DEDUP}, {Q._POS.format('d')}, {Q._purged(4)}, x AS ({Q._STATS.format(t=Q._tok('text'), m="'below-threshold'", f='e')}) SELECT * FROM x UNION ALL SELECT DISTINCT -1 - conv_id, 0::bigint, 0::bigint, 1.0::double, 'empty', 0.0::double FROM m",
    "custom_pipeline": f"WITH {Q._M}, u AS (SELECT * FROM m WHERE role <> 'system'), {Q._POS.format('u')}, k AS (SELECT *, CASE WHEN pos < n - 1 AND {Q._label('text')} = 'code' THEN 'head' ELSE 'verbatim' END AS method FROM p), f AS (SELECT conv_id, turn, role, CASE WHEN method = 'head' THEN substr(text, 1, 40) ELSE text END AS short, text, method FROM k) SELECT conv_id, turn, role, short AS text, {Q._tok('text')} AS input_tokens, {Q._tok('short')} AS output_tokens, method FROM f",
    "term_coverage": f"WITH {Q._DOCS}, {Q._SENT}, {Q._BASE}, x AS (SELECT d.doc_id, list_distinct({Q._words("coalesce(text, '')")}) AS w, {Q._words("coalesce(b, '')")} AS v FROM documents d LEFT JOIN base ON d.doc_id = base.doc_id) SELECT doc_id, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_distinct(list_intersect(w, v)))::double / len(w) END AS coverage FROM x",
    "agreement_report": "SELECT event_type, count(*) AS rows, sum((event_id % 10 <> 0)::bigint)::bigint AS agree FROM events GROUP BY event_type",
    "sql_functions": f"WITH {Q._M} SELECT conv_id, turn, {Q._tok('text')} AS tokens, {Q._label('text')} AS label, len({Q._words('text')}) AS words FROM m",
    "model_bodies": "SELECT conv_id, turn, CASE turn % 3 " + " ".join(f"WHEN {i} THEN '{u}'" for i, (u, _) in enumerate(_PROVIDERS)) + " END AS url, CASE turn % 3 " + " ".join(f"WHEN {i} THEN {b}" for i, (_, b) in enumerate(_PROVIDERS)) + " END AS body FROM conversations",
}
