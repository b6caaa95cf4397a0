"""Queries over whole tables, and the DuckDB SQL that checks them.

The tables have few shapes that compression tells apart, so some queries derive them: ``MESSAGES``
makes errors, code, structured and blank messages of ``conversations`` by fixed rules, in SQL that both
engines run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions import messages as M
from ..functions import text as X
from ..operators import compressors, strategies
from ..operators.config import Config
from . import pipeline as P
from . import reports as R

RATIO = 500
CONFIG = Config(mode="on", threshold_tokens=300, last_turns=1, purge_after=2)

MESSAGES = """
SELECT conv_id, turn, role, CASE (conv_id + turn) % 7
  WHEN 1 THEN concat('ERROR: ', text)
  WHEN 2 THEN concat('def run():', chr(10), '  import os', chr(10), text)
  WHEN 3 THEN concat('{"id": 1, "name": "row", "state": "ok", "tags": []}', text)
  WHEN 4 THEN chr(10)
  WHEN 5 THEN concat('Do not drop this. It costs 12 units. ', text)
  ELSE text END AS text
FROM conversations
UNION ALL SELECT conv_id, turn + 100 AS turn, role, text FROM conversations WHERE turn % 3 = 0
UNION ALL SELECT conv_id, turn + 200 AS turn, role, text FROM conversations WHERE turn % 3 = 0
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def _spread(spark, sf_dir):
    """Documents for work that takes far longer than reading: a file of fewer splits than cores is dealt out to all."""
    docs = _docs(spark, sf_dir)
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def _messages(spark, sf_dir):
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("thresher_conversations")  # resolved at once, so the name may be used again
    return spark.sql(MESSAGES.replace("FROM conversations", "FROM thresher_conversations"))


def doc_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.token_count("text").alias("tokens"))


def conv_tokens(spark, sf_dir):
    return _messages(spark, sf_dir).withColumn("t", X.token_count("text")).groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum("t").alias("tokens"))


def tokens_by_lang(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("t", X.token_count("text")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"))


def word_tokens(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", X.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("terms"), F.sha2(F.array_join("w", " "), 256).alias("words_sha256"))


def _terms(spark, sf_dir):
    terms = _messages(spark, sf_dir).select("conv_id", F.explode(X.word_tokens(F.col("text"))).alias("term"))
    return terms.where(~F.col("term").isin(C.STOPWORDS))


def term_counts(spark, sf_dir):
    return _terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n"))


def term_weight(spark, sf_dir):
    counts = _terms(spark, sf_dir).groupBy("conv_id", "term").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv_id"))
    return counts.withColumn("weight", X.bit_length(F.call_function("div", total, F.col("n"))).cast("int"))


def classify_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", X.classify(F.col("text")).alias("label"))


def label_histogram(spark, sf_dir):
    m = _messages(spark, sf_dir).select("role", X.classify(F.col("text")).alias("label"), X.token_count("text").alias("t"))
    return m.groupBy("role", "label").agg(F.count("*").alias("messages"), F.sum("t").alias("tokens"))


def span_guards(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return m.select("conv_id", "turn", X.looks_structural(F.col("text")).alias("structural"), X.mostly_ascii(F.col("text")).alias("mostly_ascii"), (X.token_count("text") >= C.LEAST_TOKENS).alias("long_enough"))


def text_signals(spark, sf_dir):
    m, t = _messages(spark, sf_dir), F.col("text")
    return m.select("conv_id", "turn", X.has_digit(t).alias("digit"), X.has_entity(t).alias("entity"), X.has_quoted(t).alias("quoted"), X.has_identifier(t).alias("identifier"), X.is_list_line(t).alias("list_line"), F.size(X.shingles(X.word_tokens(t))).cast("long").alias("shingles"))


def dedup_messages(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("lang").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    return strategies.dedup(docs).select("conv_id", "turn")


def repeat_flags(spark, sf_dir):
    return strategies.repeats(_messages(spark, sf_dir)).select("conv_id", "turn", "is_repeat")


def repeat_hash(spark, sf_dir):
    return _messages(spark, sf_dir).select("conv_id", "turn", X.repeat_hash(F.col("role"), F.col("text")).alias("hash"))


def purge_errors(spark, sf_dir):
    return strategies.purge_errors(_messages(spark, sf_dir), 2).select("conv_id", "turn", "text")


def protect_flags(spark, sf_dir):
    return strategies.protect(_messages(spark, sf_dir), 2).select("conv_id", "turn", "protected")


def route_plan(spark, sf_dir):
    m = strategies.protect(_messages(spark, sf_dir), CONFIG.last_turns)
    name = F.when(F.col("protected"), F.lit("verbatim")).otherwise(compressors.route(X.classify(F.col("text")), CONFIG))
    return m.select("conv_id", "turn", name.alias("compressor"))


def threshold_gate(spark, sf_dir):
    tokens = strategies.dedup(_messages(spark, sf_dir)).withColumn("t", X.token_count("text")).groupBy("conv_id").agg(F.sum("t").alias("tokens"))
    return tokens.withColumn("below", F.col("tokens") < CONFIG.threshold_tokens)


def _sentences(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", F.explode(X.sentences("text")).alias("s")).select("doc_id", "s.*")


def segment_sentences(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "idx", "text", "list_item")


def sentence_scores(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "idx", "tokens", "score")


def sentence_rank(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "idx")
    return _sentences(spark, sf_dir).select("doc_id", "idx", F.row_number().over(w).cast("long").alias("rank"))


def first_last_baseline(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", F.sha2(X.first_last("text", F.lit(RATIO)), 256).alias("baseline_sha256"))


def select_sentences(spark, sf_dir):
    kept = _spread(spark, sf_dir).select("doc_id", X.selected("text", F.lit(RATIO)).alias("k"))
    return kept.select("doc_id", F.array_join(F.col("k").cast("array<string>"), ",").alias("kept"))


def compress_documents(spark, sf_dir):
    return _spread(spark, sf_dir).select("doc_id", X.compress("text", F.lit(RATIO)).alias("c")).select("doc_id", "c.*")


def pipeline_messages(spark, sf_dir):
    return P.compress_messages(_messages(spark, sf_dir), CONFIG)


def pipeline_stats(spark, sf_dir):
    return P.conversation_stats(pipeline_messages(spark, sf_dir))


def pipeline_below_threshold(spark, sf_dir):
    return P.conversation_stats(P.compress_messages(_messages(spark, sf_dir), Config(mode="on", threshold_tokens=1_000_000_000)))


def pipeline_verbatim(spark, sf_dir):
    config = Config(mode="on", threshold_tokens=0, routing={"prose": "verbatim"})
    return P.conversation_stats(P.compress_messages(_messages(spark, sf_dir), config))


def pipeline_passthrough(spark, sf_dir):
    return P.conversation_stats(P.compress_messages(_messages(spark, sf_dir), Config()))


def coverage_report(spark, sf_dir):
    return R.quality(_spread(spark, sf_dir), "lang", RATIO)


def baseline_coverage(spark, sf_dir):
    return coverage_report(spark, sf_dir).select("lang", "spans", "input_tokens", "baseline_tokens", "terms", "baseline_terms_kept", "digit_terms")


def workload_cost(spark, sf_dir):
    return R.workload(pipeline_stats(spark, sf_dir), 0.5)


_EVENT = "concat('{\"user\": ', user_id, ', \"kind\": \"', event_type, '\", \"list\": [', event_id, ', null, true]}')"


def canonical_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", M.canonical_json(F.expr(_EVENT)).alias("json"))


def block_text(spark, sf_dir):
    blocks = "concat('[{\"type\": \"tool_use\", \"id\": \"x\", \"name\": \"', event_type, '\", \"input\": ', %s, '}, {\"type\": \"image\"}, {\"type\": \"tool_result\", \"content\": [{\"type\": \"text\", \"text\": \"seen ', event_id, '\"}]}]')" % _EVENT
    events = _table(spark, sf_dir, "events").select("event_id", F.expr(blocks).alias("content"))
    return events.select("event_id", M.message_text("content").alias("text"), M.tool_linked("content").alias("tool_linked"))


def tool_result_meta(spark, sf_dir):
    done = _spread(spark, sf_dir).select("doc_id", X.compress("text", F.lit(RATIO)).alias("c"))
    return done.select("doc_id", X.stats_meta(F.col("c.input_tokens"), F.col("c.output_tokens"), F.lit("extract")).alias("meta")).select("doc_id", "meta.*")


QUERIES = {
    f.__name__: f
    for f in (
        pipeline_stats, pipeline_messages, pipeline_below_threshold, pipeline_verbatim, pipeline_passthrough, doc_tokens, conv_tokens, tokens_by_lang, word_tokens, term_counts, term_weight,
        classify_messages, label_histogram, span_guards, text_signals, dedup_messages, repeat_flags, repeat_hash, purge_errors, protect_flags, route_plan, threshold_gate, segment_sentences,
        sentence_scores, sentence_rank, first_last_baseline, select_sentences, compress_documents, coverage_report, baseline_coverage, workload_cost, canonical_json, block_text, tool_result_meta,
    )
}


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _low(t: str) -> str:
    return f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tok(t: str) -> str:
    count = lambda p: f"len(regexp_extract_all({t}, {_q(p)}))"
    return f"(CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, {count(C.CHUNK)} - {count(C.DENSE_CHUNK)}) END)::bigint"


def _words(t: str) -> str:
    return f"regexp_extract_all({_low(t)}, {_q(C.WORD)})"


def _in(t: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_q(m)})" for m in markers) + ")"


def _label(t: str) -> str:
    lines = f"len(list_filter(string_split({t}, chr(10)), lambda x: regexp_matches(x, {_q(C.CODE_LINE)})))"
    keys = f"length({t}) >= {C.STRUCTURED_LENGTH} AND len(regexp_extract_all({t}, {_q(C.JSON_KEY)})) * 1000 >= length({t})"
    blank = f"NOT regexp_matches({t}, {_q(f'[^{C.SPACE_CLASS}]')})"
    return f"CASE WHEN {blank} THEN 'unknown' WHEN {_in(t, C.ERROR_MARKERS)} THEN 'error' WHEN contains({t}, '```') OR {lines} >= 2 THEN 'code' WHEN {keys} THEN 'structured' ELSE 'prose' END"


_STOP = ", ".join(map(_q, C.STOPWORDS))
_M = f"m AS ({MESSAGES})"
_DEDUP = "d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS r FROM m) WHERE r = 1 OR text = '')"
_POS = "p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM {})"
_BEFORE = f"(?:^|[{C.pattern([(0x00, 0x2D), (0x2F, 0x2F), *C.ASCII_OTHER[1:]], C.SPACE, C.PUNCT)}])\\.*"
_ABBR = _BEFORE + "(?:" + "|".join(a.replace(".", "\\.") for a in C.ABBREVIATIONS) + ")\\.$"
_DOCS = "src AS (SELECT doc_id, lang, text FROM documents)"
_SENT = rf"""
lines AS (SELECT doc_id, lang, li, regexp_replace(l, {_q(C.TRIM)}, '', 'g') AS line FROM (SELECT doc_id, lang, unnest(ls) AS l, unnest(range(len(ls))) AS li FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM src))),
listed AS (SELECT *, regexp_matches(line, {_q(C.LIST_LINE)}) AS item FROM lines WHERE line <> ''),
pieces AS (SELECT doc_id, lang, li, item, unnest(ps) AS piece, unnest(range(len(ps))) AS pi FROM (SELECT *, CASE WHEN item OR length(line) <= 12 THEN [line] ELSE string_split(regexp_replace(line, '([.!?])([ \t])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS ps FROM listed)),
prev AS (SELECT *, lag(piece) OVER (PARTITION BY doc_id, li ORDER BY pi) AS before FROM pieces),
cuts AS (SELECT *, sum(CASE WHEN before IS NULL THEN 1 WHEN regexp_matches({_low('before')}, {_q(_ABBR)}) OR regexp_matches(before, {_q(_BEFORE + '[A-Z]' + chr(92) + '.$')}) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, li ORDER BY pi) AS g FROM prev),
joined AS (SELECT doc_id, lang, li, g, item, regexp_replace(string_agg(piece, '' ORDER BY pi), {_q(C.TRIM)}, '', 'g') AS text FROM cuts GROUP BY doc_id, lang, li, g, item),
sent AS (SELECT doc_id, lang, (row_number() OVER (PARTITION BY doc_id ORDER BY li, g) - 1)::int AS idx, text, item AS list_item FROM joined WHERE text <> '')"""
_SCORE = f"""
ws AS (SELECT doc_id, idx, unnest({_words('text')}) AS w FROM sent),
tc AS (SELECT doc_id, w, count(*) AS c FROM ws WHERE w NOT IN ({_STOP}) GROUP BY doc_id, w),
tot AS (SELECT doc_id, sum(c)::bigint AS total FROM tc GROUP BY doc_id),
info AS (SELECT ws.doc_id, idx, count(*) AS n, coalesce(sum(length(bin(greatest(1, total) // c))) FILTER (WHERE c IS NOT NULL), 0)::bigint AS v FROM ws LEFT JOIN tc ON ws.doc_id = tc.doc_id AND ws.w = tc.w LEFT JOIN tot ON ws.doc_id = tot.doc_id GROUP BY ws.doc_id, idx),
flags AS (SELECT *, max(idx) OVER (PARTITION BY doc_id) AS last, {_low('text')} AS low FROM sent),
score AS (SELECT f.doc_id, f.idx, {_tok('text')} AS tokens, (CASE WHEN v IS NULL THEN 0 ELSE v * 1000 // n
  + CASE WHEN regexp_matches(text, '[0-9]') THEN 350 ELSE 0 END + CASE WHEN regexp_matches(text, {_q(C.ENTITY_SIGNAL)}) THEN 200 ELSE 0 END
  + CASE WHEN {' OR '.join(f'regexp_matches(text, {_q(p)})' for p in C.QUOTED_SIGNALS)} THEN 200 ELSE 0 END + CASE WHEN regexp_matches(text, {_q(C.IDENTIFIER_SIGNAL)}) THEN 300 ELSE 0 END
  + CASE WHEN f.idx = 0 OR f.idx = last THEN 250 ELSE 0 END + CASE WHEN {_in('low', C.CONSTRAINTS)} THEN 400 ELSE 0 END
  - CASE WHEN {' OR '.join(f'starts_with(low, {_q(m)})' for m in C.FILLERS)} THEN 400 ELSE 0 END END)::bigint AS score
  FROM flags f LEFT JOIN info i ON f.doc_id = i.doc_id AND f.idx = i.idx)"""
_BASE = f"""
bt AS (SELECT *, {_tok('text')} AS t, count(*) OVER (PARTITION BY doc_id) AS n FROM sent),
br AS (SELECT *, least(2 * idx, 2 * (n - 1 - idx) + 1) AS r, sum(t) OVER (PARTITION BY doc_id) AS total FROM bt),
bu AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY doc_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM br),
base AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS b FROM bu WHERE used * 1000 < {RATIO} * total GROUP BY doc_id)"""
# Selection goes down the ranks of all spans at once; which sentences are redundant beside which is known before.
_SELECT = f"""
tw AS (SELECT doc_id, idx, {_words('text')} AS w FROM sent),
sh AS (SELECT doc_id, idx, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) END) AS s FROM tw),
shn AS (SELECT doc_id, idx, count(*) AS n FROM sh GROUP BY doc_id, idx),
dg AS (SELECT doc_id, idx, w[1] AS head, list_sort(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) AS d FROM tw),
pairs AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, count(*) AS m FROM sh a JOIN sh b ON a.doc_id = b.doc_id AND a.s = b.s AND a.idx <> b.idx GROUP BY a.doc_id, a.idx, b.idx),
near AS (SELECT pairs.doc_id, i, list(j) AS js FROM pairs JOIN shn x ON pairs.doc_id = x.doc_id AND i = x.idx JOIN shn y ON pairs.doc_id = y.doc_id AND j = y.idx JOIN dg p ON pairs.doc_id = p.doc_id AND i = p.idx JOIN dg q ON pairs.doc_id = q.doc_id AND j = q.idx WHERE m * 100 > {C.REDUNDANT_PERCENT} * (x.n + y.n - m) AND p.d = q.d GROUP BY pairs.doc_id, i),
rk AS MATERIALIZED (SELECT score.doc_id, score.idx, score.tokens, list_item, coalesce(js, []) AS js, coalesce(head IN ({', '.join(map(_q, C.ANAPHORA))}), false) AS leans, {_in('low', C.PROHIBITIONS)} AS held, row_number() OVER (PARTITION BY score.doc_id ORDER BY score DESC, score.idx) AS r,
  lag(score.tokens) OVER (PARTITION BY score.doc_id ORDER BY score.idx) AS prev, sum(score.tokens) OVER (PARTITION BY score.doc_id) AS total
  FROM score JOIN flags ON score.doc_id = flags.doc_id AND score.idx = flags.idx JOIN dg ON score.doc_id = dg.doc_id AND score.idx = dg.idx LEFT JOIN near ON score.doc_id = near.doc_id AND score.idx = near.i),
sel AS (SELECT doc_id, 0::bigint AS r, coalesce(sum(tokens) FILTER (WHERE held), 0)::bigint AS used, coalesce(list(idx) FILTER (WHERE held), []) AS kept FROM rk GROUP BY doc_id
  UNION ALL SELECT doc_id, r, used + CASE WHEN skip THEN 0 ELSE tokens + CASE WHEN pull THEN prev ELSE 0 END END, CASE WHEN skip THEN kept WHEN pull THEN list_concat(kept, [idx, idx - 1]) ELSE list_concat(kept, [idx]) END
  FROM (SELECT rk.doc_id, rk.r, used, kept, tokens, prev, rk.idx, list_contains(kept, rk.idx) OR (NOT list_item AND list_has_any(kept, js)) AS skip, leans AND rk.idx > 0 AND NOT list_contains(kept, rk.idx - 1) AS pull FROM sel JOIN rk ON sel.doc_id = rk.doc_id AND rk.r = sel.r + 1 WHERE used * 1000 < {RATIO} * total)),
fin AS (SELECT l.doc_id, CASE WHEN len(kept) = 0 THEN [rk.idx] ELSE list_sort(kept) END AS kept FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM sel GROUP BY doc_id) l JOIN rk ON l.doc_id = rk.doc_id AND rk.r = 1)"""
_EXT = f"""{_SENT}, {_SCORE}, {_SELECT},
cand AS (SELECT sent.doc_id, count(*) AS n, string_agg(sent.text, ' ' ORDER BY sent.idx) FILTER (WHERE list_contains(kept, sent.idx)) AS short FROM sent JOIN fin ON sent.doc_id = fin.doc_id GROUP BY sent.doc_id),
told AS (SELECT src.*, short, CASE WHEN NOT regexp_matches(coalesce(text, ''), {_q(f'[^{C.SPACE_CLASS}]')}) THEN 0 ELSE {_tok('text')} END AS i,
  NOT {_in('text', C.STRUCTURAL_MARKERS)} AND {_tok('text')} >= {C.LEAST_TOKENS} AND length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) * 100 >= length(text) * {C.ASCII_PERCENT} AND n >= {C.LEAST_SENTENCES} AND {_tok('short')} < {_tok('text')} AS gains
  FROM src LEFT JOIN cand ON src.doc_id = cand.doc_id),
ext AS (SELECT doc_id, lang, text AS original, CASE WHEN gains THEN short ELSE text END AS text, i AS input_tokens, CASE WHEN gains THEN {_tok('short')} ELSE i END AS output_tokens FROM told)"""
# The whole pipeline over the messages that a source CTE "d" has after dedup.
_RUN = f"""{_POS.format('d')}, e AS (SELECT conv_id, turn, role, pos, n, CASE WHEN pos < n - {CONFIG.purge_after} AND {_label('text')} = 'error' THEN {_q(C.PURGED)} ELSE text END AS text FROM p),
g AS (SELECT *, {_tok('text')} AS t, sum({_tok('text')}) OVER (PARTITION BY conv_id) < {CONFIG.threshold_tokens} AS below FROM e),
h AS (SELECT *, CASE WHEN below THEN 'below-threshold' WHEN role = 'system' OR pos >= n - {CONFIG.last_turns} OR {_label('text')} <> 'prose' THEN 'verbatim' ELSE 'extract' END AS method FROM g),
src AS (SELECT conv_id * 1000 + turn AS doc_id, '' AS lang, text FROM h WHERE method = 'extract'), {_EXT},
done AS (SELECT conv_id, turn, role, CASE WHEN method = 'extract' THEN ext.text ELSE h.text END AS text, CASE WHEN method = 'extract' THEN input_tokens ELSE t END AS input_tokens, CASE WHEN method = 'extract' THEN output_tokens ELSE t END AS output_tokens, method FROM h LEFT JOIN ext ON h.conv_id * 1000 + turn = ext.doc_id),
stats AS (SELECT conv_id, sum(input_tokens)::bigint AS input_tokens, sum(output_tokens)::bigint AS output_tokens, CASE WHEN sum(input_tokens) > 0 THEN sum(output_tokens)::double / sum(input_tokens) ELSE 1.0 END AS ratio, CASE WHEN min(method) = max(method) THEN min(method) ELSE 'hybrid' END AS method, 0.0::double AS cost_usd FROM done GROUP BY conv_id)"""
_STATS = "SELECT conv_id, sum({t})::bigint AS input_tokens, sum({t})::bigint AS output_tokens, 1.0::double AS ratio, {m} AS method, 0.0::double AS cost_usd FROM {f} GROUP BY conv_id"
def _purged(after: int) -> str:
    return f"e AS (SELECT conv_id, turn, role, CASE WHEN pos < n - {after} AND {_label('text')} = 'error' THEN {_q(C.PURGED)} ELSE text END AS text FROM p)"


_EV_JSON = "'{\"kind\":\"' || event_type || '\",\"list\":[' || event_id || ',null,true],\"user\":' || user_id || '}'"

ORACLES = {
    "doc_tokens": f"SELECT doc_id, {_tok('text')} AS tokens FROM documents",
    "conv_tokens": f"WITH {_M} SELECT conv_id, count(*) AS messages, sum({_tok('text')})::bigint AS tokens FROM m GROUP BY conv_id",
    "tokens_by_lang": f"SELECT lang, count(*) AS docs, sum({_tok('text')})::bigint AS tokens FROM documents GROUP BY lang",
    "word_tokens": f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS terms, sha256(array_to_string(w, ' ')) AS words_sha256 FROM (SELECT doc_id, {_words('text')} AS w FROM documents)",
    "term_counts": f"WITH {_M} SELECT term, count(*) AS n FROM (SELECT unnest({_words('text')}) AS term FROM m) WHERE term NOT IN ({_STOP}) GROUP BY term",
    "term_weight": f"WITH {_M}, c AS (SELECT conv_id, term, count(*) AS n FROM (SELECT conv_id, unnest({_words('text')}) AS term FROM m) WHERE term NOT IN ({_STOP}) GROUP BY conv_id, term) SELECT conv_id, term, n, length(bin(sum(n) OVER (PARTITION BY conv_id)::bigint // n))::int AS weight FROM c",
    "classify_messages": f"WITH {_M} SELECT conv_id, turn, {_label('text')} AS label FROM m",
    "label_histogram": f"WITH {_M} SELECT role, label, count(*) AS messages, sum(t)::bigint AS tokens FROM (SELECT role, {_label('text')} AS label, {_tok('text')} AS t FROM m) GROUP BY role, label",
    "span_guards": f"WITH {_M} SELECT conv_id, turn, {_in('text', C.STRUCTURAL_MARKERS)} AS structural, length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) * 100 >= length(text) * 60 AS mostly_ascii, {_tok('text')} >= 40 AS long_enough FROM m",
    "text_signals": f"WITH {_M}, w AS (SELECT *, {_words('text')} AS ws FROM m) SELECT conv_id, turn, regexp_matches(text, '[0-9]') AS digit, regexp_matches(text, {_q(C.ENTITY_SIGNAL)}) AS entity, {' OR '.join(f'regexp_matches(text, {_q(p)})' for p in C.QUOTED_SIGNALS)} AS quoted, regexp_matches(text, {_q(C.IDENTIFIER_SIGNAL)}) AS identifier, regexp_matches(text, {_q('(?s)' + C.LIST_LINE)}) AS list_line, (CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) < 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' ')))) END)::bigint AS shingles FROM w",
    "dedup_messages": "SELECT conv_id, turn FROM (SELECT lang AS conv_id, doc_id AS turn, text, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS r FROM documents) WHERE r = 1 OR coalesce(text, '') = ''",
    "repeat_flags": f"WITH {_M} SELECT conv_id, turn, text <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) > 1 AS is_repeat FROM m",
    "repeat_hash": f"WITH {_M} SELECT conv_id, turn, CASE WHEN text <> '' THEN sha256(role || '|' || text) END AS hash FROM m",
    "purge_errors": f"WITH {_M}, {_POS.format('m')}, {_purged(2)} SELECT conv_id, turn, text FROM e",
    "protect_flags": f"WITH {_M}, {_POS.format('m')} SELECT conv_id, turn, role = 'system' OR pos >= n - 2 AS protected FROM p",
    "route_plan": f"WITH {_M}, {_POS.format('m')} SELECT conv_id, turn, CASE WHEN role <> 'system' AND pos < n - {CONFIG.last_turns} AND {_label('text')} = 'prose' THEN 'extract' ELSE 'verbatim' END AS compressor FROM p",
    "threshold_gate": f"WITH {_M}, {_DEDUP} SELECT conv_id, sum({_tok('text')})::bigint AS tokens, sum({_tok('text')}) < {CONFIG.threshold_tokens} AS below FROM d GROUP BY conv_id",
    "segment_sentences": f"WITH {_DOCS}, {_SENT} SELECT doc_id, idx, text, list_item FROM sent",
    "sentence_scores": f"WITH {_DOCS}, {_SENT}, {_SCORE} SELECT doc_id, idx, tokens, score FROM score",
    "sentence_rank": f"WITH {_DOCS}, {_SENT}, {_SCORE} SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, idx) AS rank FROM score",
    "first_last_baseline": f"WITH {_DOCS}, {_SENT}, {_BASE} SELECT d.doc_id, sha256(coalesce(b, '')) AS baseline_sha256 FROM documents d LEFT JOIN base ON d.doc_id = base.doc_id",
    "pipeline_below_threshold": f"WITH {_M}, {_DEDUP}, {_POS.format('d')}, {_purged(4)} " + _STATS.format(t=_tok("text"), m="'below-threshold'", f="e"),
    "pipeline_verbatim": f"WITH {_M}, {_DEDUP}, {_POS.format('d')}, {_purged(4)} " + _STATS.format(t=_tok("text"), m="'verbatim'", f="e"),
    "pipeline_passthrough": f"WITH {_M} " + _STATS.format(t="0", m="'passthrough'", f="m"),
    "baseline_coverage": f"WITH {_DOCS}, {_SENT}, {_BASE}, x AS (SELECT d.lang, text, {_words('text')} AS w, {_words('b')} AS v, {_tok('text')} AS t, {_tok('b')} AS bt FROM documents d LEFT JOIN base ON d.doc_id = base.doc_id WHERE {_label('text')} = 'prose') SELECT lang, count(*) AS spans, sum(t)::bigint AS input_tokens, sum(bt)::bigint AS baseline_tokens, sum(len(list_distinct(w)))::bigint AS terms, sum(len(list_distinct(list_intersect(w, v))))::bigint AS baseline_terms_kept, sum(len(list_filter(list_distinct(w), lambda x: regexp_matches(x, '[0-9]'))))::bigint AS digit_terms FROM x GROUP BY lang",
    "select_sentences": f"WITH RECURSIVE {_DOCS}, {_SENT}, {_SCORE}, {_SELECT} SELECT d.doc_id, coalesce(array_to_string(kept, ','), '') AS kept FROM documents d LEFT JOIN fin ON d.doc_id = fin.doc_id",
    "compress_documents": f"WITH RECURSIVE {_DOCS}, {_EXT} SELECT doc_id, text, input_tokens, output_tokens FROM ext",
    "tool_result_meta": f"WITH RECURSIVE {_DOCS}, {_EXT} SELECT doc_id, CASE WHEN input_tokens > output_tokens THEN input_tokens - output_tokens END AS tokens_saved, CASE WHEN input_tokens > output_tokens THEN output_tokens::double / input_tokens END AS ratio, CASE WHEN input_tokens > output_tokens THEN 'extract' END AS method FROM ext",
    "coverage_report": f"WITH RECURSIVE {_DOCS}, {_EXT}, {_BASE}, x AS (SELECT e.lang, input_tokens AS i, output_tokens AS o, list_distinct({_words('original')}) AS w, {_words('e.text')} AS v, {_words('b')} AS u, {_tok('b')} AS bt FROM ext e LEFT JOIN base ON e.doc_id = base.doc_id WHERE {_label('original')} = 'prose'), y AS (SELECT *, list_filter(w, lambda a: regexp_matches(a, '[0-9]')) AS g FROM x) SELECT lang, count(*) AS spans, sum(i)::bigint AS input_tokens, sum(o)::bigint AS output_tokens, sum(bt)::bigint AS baseline_tokens, sum(len(w))::bigint AS terms, sum(len(list_distinct(list_intersect(w, v))))::bigint AS terms_kept, sum(len(list_distinct(list_intersect(w, u))))::bigint AS baseline_terms_kept, sum(len(g))::bigint AS digit_terms, sum(len(list_distinct(list_intersect(g, v))))::bigint AS digit_terms_kept FROM y GROUP BY lang",
    "pipeline_messages": f"WITH RECURSIVE {_M}, {_DEDUP}, {_RUN} SELECT * FROM done",
    "pipeline_stats": f"WITH RECURSIVE {_M}, {_DEDUP}, {_RUN} SELECT * FROM stats",
    "workload_cost": f"WITH RECURSIVE {_M}, {_DEDUP}, {_RUN}, w AS (SELECT count(*) AS lists, sum(input_tokens)::bigint AS i, sum(output_tokens)::bigint AS o FROM stats) SELECT lists, i AS input_tokens, o AS output_tokens, i - o AS saved_tokens, (i - o)::double / i * 100 AS saved_percent, i::double / 1000 * 0.5 AS cost_before, o::double / 1000 * 0.5 AS cost_after, (i - o)::double / 1000 * 0.5 AS cost_saved FROM w",
    "canonical_json": f"SELECT event_id, {_EV_JSON} AS json FROM events",
    "block_text": f"SELECT event_id, '[tool_use ' || event_type || '] ' || {_EV_JSON} || chr(10) || 'seen ' || event_id AS text, true AS tool_linked FROM events",
}
