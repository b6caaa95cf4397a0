"""Text functions, strategies and the pipeline against stated cases and against one another."""

import json
import random

import pytest
from pyspark.sql import functions as F

from thresher.functions import classes as C
from thresher.functions import content as N
from thresher.functions import kernels as K
from thresher.functions import lists as L
from thresher.functions import messages as M
from thresher.functions import text as X
from thresher.operators import compressors, model_requests, strategies, tools
from thresher.operators.config import Config
from thresher.plans import pipeline as P
from thresher.plans import queries as Q
from thresher.plans import reports, traffic
from thresher.sources import messages as S
from thresher.streaming import requests as R

ODD = ["", " ", "hi", "hello world", "a, b.", "漢字かな交じり文", "ไทย abc", "a😀b", "﻿x y\u0085z", "x​y", "née Ünïcode", "“q” — r", "𝔘𝔫𝔦", "ab\n\ncd", "12345", "가나다라", "　"]


def column(spark, values, *columns):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", *columns)
    return [tuple(r)[1:] for r in rows.orderBy("i").collect()]


def test_tokens(spark):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab1 ,.漢字ไé 😀\n") for _ in range(rnd.randint(0, 40))) for _ in range(400)]
    got = column(spark, texts, X.token_count("t").alias("a"), X.token_count_expr(F.col("t")).alias("b"))
    assert all(a == b for a, b in got)
    assert [K.token_counts([t])[0] for t in ODD[:5]] == [0, 1, 1, 4, 4]
    assert K.token_counts(["漢字かな交じり文"])[0] == 6 and list(K.token_counts(["", None, "ab", ""])) == [0, 0, 1, 0]
    assert len(K.token_counts([])) == 0


def test_words(spark):
    assert K.words("Hello, World! x2") == ["hello", "world", "x2"]
    got = column(spark, ODD, X.word_tokens(F.col("t")).alias("w"))
    assert [w for (w,) in got] == [K.words(t) for t in ODD]


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("", "unknown"), (" \n ", "unknown"), ("plain words", "prose"), ("Here:\n```py\nx\n```", "code"), ("import os\n  from sys import path", "code"), ("the import statement", "prose"),
        ("Traceback (most recent call last):\n x", "error"), ("thread 'main' panicked at a.rs", "error"), ('{"id": 1, "n": "r"},' * 12, "structured"), ('"k" : ' + "x" * 193, "prose"), ('"k" : ' + "x" * 194, "structured"), ('"k" : ' + "x" * 995, "prose"),
        ('"' + "k" * 64 + '":' + "x" * 200, "structured"), ('"' + "k" * 65 + '":' + "x" * 200, "prose"), ("a\rimport x\rimport y", "prose"),
    ],
)
def test_labels(spark, text, label):
    assert column(spark, [text], X.classify(F.col("t")).alias("l")) == [(label,)]
    assert L.label(text) == label


def test_segments():
    assert K.segment("Dr. Smith met J. Doe. They spoke! Really? Yes e.g. here. v1.2 is out.") == [(t, False) for t in ("Dr. Smith met J. Doe.", "They spoke!", "Really?", "Yes e.g. here.", "v1.2 is out.")]
    assert K.segment("- a thing. two\n1. first one here. and\nshort. ab\n | cell\n\n") == [("- a thing. two", True), ("1. first one here. and", True), ("short. ab", False), ("| cell", True)]
    assert K.segment("﻿ A sentence of words here.\u0085") == [("A sentence of words here.", False)]
    assert K.segment("") == []


def test_score_boosts():
    from collections import Counter

    of = lambda t, edge=False: K.score(t, K.words(t), edge, Counter(K.words(t)), len(K.words(t)))
    base = of("quiet gardens grow")
    assert of("quiet gardens grow", True) == base + C.POSITION
    assert of("quiet Gardens grow") == base + C.ENTITY and of("quiet 'gardens' grow") == base + C.QUOTED
    assert of("quiet gar_dens grow") - C.IDENTIFIER > 0 and of("...") == 0
    assert of("basically quiet gardens") == base - C.FILLER and of("quiet gardens always") == base + C.IMPERATIVE


def test_select():
    s = [(t, False) for t in ("Always keep backups of data.", "The quick team wrote nine reports.", "Never delete the archive.", "It failed on node 7 yesterday.", "Filler text goes on here.")]
    assert 2 in K.select(s, 1) and K.select(s, 1000) == [0, 1, 2, 3, 4]
    same = [("The nightly build failed on runner 12 with errors.", False), ("The nightly build failed on runner 12 with errors!", False), ("Another thing.", False)]
    assert len(K.select(same, 1000)) == 2
    assert len(K.select([(t, True) for t, _ in same], 1000)) == 3
    assert K.select([("...", False), ("!!!", False)], 1) == [0]


def test_compress_guards(spark):
    long = " ".join(f"The crew moved {w} boxes to hall {i}." for i, w in enumerate("red blue green pink grey".split() * 4))
    short, before, after = K.compress_text(long, 500)
    assert after < before and short != long
    for kept in ("tiny", "```" + long, long.replace(".", ","), "é" * 2000 + ". a. b. c"):
        assert K.compress_text(kept, 500)[0] == kept
    got = column(spark, [long, " ", None, ""], X.compress("t", F.lit(500)).alias("c"))
    assert [tuple(c) for (c,) in got] == [(short, before, after), (" ", 0, 0), (None, 0, 0), ("", 0, 0)]


def test_long_single_line():
    text = " ".join(f"Sentence number {i} talks about item {i * 7 % 1000}." for i in range(3_000))
    assert K.compress_text(text, 500)[2] < K.compress_text(text, 500)[1]


def test_content(spark):
    blocks = [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "f", "input": {"b": 1.0, "a": [None, True, "é"]}}, {"type": "tool_use", "name": "f"}, {"type": "tool_result", "content": [{"type": "document", "source": {"data": "d"}}]}, {"type": "image"}, 3, None]
    assert N.content_text(blocks) == 'a\n[tool_use f] {"a":[null,true,"é"],"b":1}\nd'
    assert N.content_text({"type": "text", "text": "x"}) == "x" and N.content_text(7) == ""
    assert N.tool_linked(blocks) and not N.tool_linked({"type": "tool_use"})
    assert [N.number(x) for x in (1.0, 1e21, 1e-7, 0.1, 1e20, -0.0, 123.456, -1.5e300, 1e-6)] == ["1", "1e+21", "1e-7", "0.1", "100000000000000000000", "0", "123.456", "-1.5e+300", "0.000001"]
    got = column(spark, [json.dumps(blocks), "{bad", None], M.message_text("t").alias("a"), M.tool_linked("t").alias("b"))
    assert got == [(N.content_text(blocks), True), ("", False), ("", False)]


def test_compress_content():
    long = " ".join(f"The crew moved {w} boxes to hall {i}." for i, w in enumerate("red blue green pink grey".split() * 4))
    blocks = [{"type": "text", "text": long, "x": 1}, {"type": "text", "text": " "}, {"type": "tool_result", "content": "```" + long}, {"type": "tool_result", "content": [{"type": "text", "text": long}]}, {"type": "tool_use", "input": "abcd"}]
    short, before, after = N.compress_content(blocks, 500)
    one = K.compress_text(long, 500)
    assert short[0] == {"type": "text", "text": one[0], "x": 1} and short[1:3] == blocks[1:3] and short[3]["content"][0]["text"] == one[0]
    assert before - after == 2 * (one[1] - one[2]) and N.compress_content({"type": "text", "text": long}, 500)[1:] == (0, 0)


def test_splice():
    assert N.splice('{"a": [1,2] , "mess\\u0061ges" :[ {"x":1} ],"b":2}', "messages", "[]") == '{"a": [1,2] , "mess\\u0061ges" :[],"b":2}'
    for bad in ('{"messages":1,"messages":2}', '{"a":1}', '{"messages":[}', "[]", "", '{"messages":[]} x', '{"messages":[],}'):
        assert N.splice(bad, "messages", "[]") is None


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_strategies(spark):
    rows = [(1, 0, "user", "same"), (1, 1, "assistant", "same"), (1, 2, "user", "same"), (1, 3, "user", ""), (1, 4, "user", ""), (2, 0, "user", "same"), (1, 5, "user", "ERROR: x"), (1, 6, "user", None)]
    df = frame(spark, rows)
    assert sorted((r["conv_id"], r["turn"]) for r in strategies.dedup(df).collect()) == [(1, 0), (1, 1), (1, 3), (1, 4), (1, 5), (1, 6), (2, 0)]
    assert [r["turn"] for r in strategies.repeats(df).where("is_repeat").collect()] == [2]
    assert strategies.purge_errors(df, 1).where(F.col("text") == C.PURGED).count() == 1
    assert strategies.purge_errors(df, 2).where(F.col("text") == C.PURGED).count() == 0
    assert sorted(r["turn"] for r in strategies.protect(df, 2).where("protected AND conv_id = 1").collect()) == [5, 6]


def test_pipeline(spark):
    long = " ".join(f"The crew moved {w} boxes to hall {i}." for i, w in enumerate("red blue green pink grey".split() * 4))
    rows = [(1, 0, "system", long), (1, 1, "user", long), (1, 2, "user", long), (1, 3, "user", "bye"), (2, 0, "user", "tiny")]
    cfg = Config(mode="on", threshold_tokens=10, last_turns=1)
    out = {(r["conv_id"], r["turn"]): r for r in P.compress_messages(frame(spark, rows), cfg).collect()}
    assert set(out) == {(1, 0), (1, 1), (1, 3), (2, 0)}
    assert out[1, 0]["text"] == long and out[1, 1]["text"] == K.compress_text(long, 500)[0]
    stats = {r["conv_id"]: r for r in P.conversation_stats(P.compress_messages(frame(spark, rows), cfg), spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")).collect()}
    assert (stats[1]["method"], stats[2]["method"], stats[3]["method"]) == ("hybrid", "below-threshold", "empty")
    assert stats[1]["input_tokens"] == 2 * int(K.token_counts([long])[0]) + 1 and stats[3]["ratio"] == 1
    off = P.compress_messages(frame(spark, rows), Config()).collect()
    assert len(off) == 5 and {r["method"] for r in off} == {"passthrough"}


def test_one_shuffle_for_the_pipeline(spark):
    plan = P.compress_messages(frame(spark, [(1, 0, "user", "x")]), Config(mode="on", dedup=False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_config():
    with pytest.raises(ValueError, match="ratio"):
        Config(ratio=0)
    with pytest.raises(ValueError, match="mode"):
        Config(mode="")
    with pytest.warns(UserWarning, match="unknown"):
        assert Config(routing={"nope": "extract", "code": "nope"}).routes(compressors.known()) == {"code": "verbatim"}
    assert not Config(mode="Passthrough").active and Config(ratio=0.3335).ratio_millis == 334


def test_registered_compressor(spark):
    compressors.register("upper", lambda text, config: F.struct(F.upper(text).alias("text"), F.lit(2).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens")))
    out = P.compress_messages(frame(spark, [(1, 0, "user", "ab"), (1, 1, "user", "cd")]), Config(mode="on", threshold_tokens=0, last_turns=1, routing={"prose": "upper"})).orderBy("turn").collect()
    assert [r["text"] for r in out] == ["AB", "cd"]


def test_sources(spark, tmp_path):
    messages = [{"role": "user", "content": "hé \"x\""}, {"role": "assistant", "content": [{"type": "text", "text": "b"}, {"type": "tool_use", "input": {}}]}]
    (tmp_path / "a.json").write_text(json.dumps(messages))
    rows = S.read_lists(spark, f"file://{tmp_path}/*.json").orderBy("turn").collect()
    assert [(r["file"], r["role"], r["text"], r["tool_linked"]) for r in rows] == [("a.json", "user", 'hé "x"', False), ("a.json", "assistant", "b\n{}", True)]
    body = '{ "model": "m", "messages": ' + json.dumps(messages) + "}"
    log = spark.createDataFrame([(1, "POST", "/v1/chat/completions", body), (2, "GET", "/v1/messages", body), (3, "POST", "/v1/other", body)], "request_id long, method string, path string, body string")
    found = S.requests(log)
    assert [r["conv_id"] for r in found.collect()] == [1, 1]
    back = {r["request_id"]: r["body"] for r in S.write_back(log, found).collect()}
    assert json.loads(back[1]) == json.loads(body) and back[1].startswith('{ "model": "m", "messages": [') and back[2] == body


def test_streaming(spark, tmp_path):
    long = " ".join(f"The crew moved {w} boxes to hall {i}." for i, w in enumerate("red blue green pink grey".split() * 4))
    body = json.dumps({"messages": [{"role": "user", "content": long}, {"role": "user", "content": "bye"}]})
    spark.createDataFrame([("POST", "/v1/messages", body), ("GET", "/x", body), ("POST", "/v1/messages", "{bad")], "method string, path string, body string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("method string, path string, body string").json(f"{tmp_path}/in")
    query = R.compress_requests(stream, Config(mode="on", threshold_tokens=10, last_turns=1)).writeStream.format("memory").queryName("bodies").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["method"], r["body"]) for r in spark.table("bodies").collect()}
    assert ("GET", body) in got and ("POST", "{bad") in got
    assert any(json.loads(b)["messages"][0]["content"] == K.compress_text(long, 500)[0] for _, b in got if b != "{bad")


def test_streaming_repeats(spark, tmp_path):
    """The state lasts over batches; tool messages and empty texts never repeat."""
    first = [("a", 0, "user", "x", False), ("a", 1, "assistant", "x", False), ("a", 2, "user", "x", False), ("b", 0, "user", "x", False), ("a", 3, "user", "", False)]
    later = [("a", 4, "user", "", False), ("b", 1, "user", "x", False), ("b", 2, "user", "t", True), ("b", 3, "user", "t", True), ("a", 5, "user", "y", False)]
    schema = "session string, turn long, role string, text string, tool_linked boolean"
    for n, rows in enumerate((first, later)):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(f"{tmp_path}/in")
        query = R.flag_repeats(stream).writeStream.format("json").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
        query.awaitTermination(120)
    out = spark.read.json(f"{tmp_path}/out")
    assert out.count() == len(first) + len(later)
    assert sorted((r["session"], r["turn"]) for r in out.where("is_repeat").collect()) == [("a", 2), ("b", 1)]


ANSWERS = {
    "anthropic": {"content": [{"text": "s"}], "usage": {"input_tokens": 5, "output_tokens": 1}},
    "openai": {"choices": [{"message": {"content": "s"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}},
    "gemini": {"candidates": [{"content": {"parts": [{"text": "s"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 1}},
}


@pytest.mark.parametrize("name", sorted(ANSWERS))
def test_model_requests(spark, name):
    provider = model_requests.Provider(name, key="k", url="http://x/")
    url, headers, body = provider.build("hello")
    assert url.startswith("http://x/v1") and "hello" in body and "k" in " ".join(headers.values()) and "k" not in repr(provider).split()
    raw = json.dumps(ANSWERS[name])
    assert provider.parse(200, raw) == ("s", 5, 1) and provider.parse(200, "{}") == ("", 0, 0)
    with pytest.raises(RuntimeError, match="answered 500: no"):
        provider.parse(500, "no")
    rows = [(1, 1, "user", "b"), (1, 0, "assistant", "a"), (2, 0, "user", " "), (2, 1, None, None)]

    def transport(url, headers, body, raw=raw):
        assert "a\\n\\nb" in body
        return 200, raw

    out = sorted(tuple(r) for r in model_requests.compress_spans(spark.createDataFrame(rows, "span_id long, turn long, role string, text string"), provider, transport).collect())
    assert out == [(1, 0, "assistant", "s", 5, 1, "selfllm"), (2, 0, "user", " ", 0, 0, "selfllm"), (2, 1, "user", "", 0, 0, "selfllm")]


def test_model_defaults():
    body = lambda *a: json.loads(model_requests.Provider(*a).build("x")[2])
    assert "reasoning_effort" not in body("openai") and body("openai", "o3-mini")["reasoning_effort"] == "minimal"
    assert body("gemini")["generationConfig"]["thinkingConfig"] == {"thinkingBudget": 0} and "thinkingConfig" not in body("gemini", "gemini-1.5-pro")["generationConfig"]
    assert body("anthropic")["max_tokens"] == 500
    with pytest.raises(ValueError, match="unknown provider"):
        model_requests.Provider("nobody")


def test_model_as_compressor(spark):
    model_requests.register(model_requests.Provider("openai"), lambda u, h, b: (200, json.dumps(ANSWERS["openai"])))
    config = Config(mode="on", threshold_tokens=0, last_turns=1, routing={"prose": "selfllm"})
    out = P.compress_messages(frame(spark, [(1, 0, "user", "some words"), (1, 1, "user", "cd")]), config).orderBy("turn").collect()
    assert [(r["text"], r["input_tokens"], r["output_tokens"], r["method"]) for r in out] == [("s", 5, 1, "selfllm"), ("cd", 1, 1, "verbatim")]


LONG = " ".join(f"The crew moved {w} boxes to hall {i}." for i, w in enumerate("red blue green pink grey".split() * 4))


def test_bodies_keep_their_other_bytes(spark):
    short = K.compress_text(LONG, 500)[0]
    one = lambda t: '{ "role" : "user","name":"n", "content": %s , "x": 1.0}' % json.dumps(t)
    tool = lambda t: '{"tool_call_id": "c", "content": %s}' % t
    block = lambda t: json.dumps([{"type": "tool_result", "content": t}], separators=(",", ":"))
    body = '{"model" : "m", "messages": [%s], "n": 1e3}'
    old = body % ",".join([one(LONG), tool(block(LONG + " And more.")), '{"tool_calls": []}', one("bye")])
    new = body % ",".join([one(short), tool(block(K.compress_text(LONG + " And more.", 500)[0])), '{"tool_calls": []}', one("bye")])
    log = spark.createDataFrame([(1, "POST", "/v1/messages", old), (2, "POST", "/v1/messages", "{bad"), (3, "POST", "/v1/messages", '{"messages": [1]}'), (4, "POST", "/v1/messages", None)], "request_id long, method string, path string, body string")
    config = Config(mode="on", threshold_tokens=10, last_turns=1)
    back = {r["request_id"]: r["body"] for r in S.write_back(log, P.compress_messages(S.requests(log), config)).collect()}
    assert back == {1: new, 2: "{bad", 3: '{"messages": [1]}', 4: None}
    assert R.compress_body(old, config)[0] == new and R.compress_body(None, config) == (None, 0, 0)
    assert [R.compress_body(x, config)[0] for x in ("{bad", '{"messages": [1]}', "[]", '{"messages": {}}')] == ["{bad", '{"messages": [1]}', "[]", '{"messages": {}}']


def test_lists_equal_the_pipeline(spark):
    rnd = random.Random(3)
    texts = [LONG, LONG + " Never stop.", "ERROR: it broke", "Uncaught exception here", "def f():\nimport x", " ", "hi", "", LONG.replace("crew", "team")]
    shapes = [lambda t: t, lambda t: [{"type": "text", "text": t}], lambda t: [{"type": "tool_result", "content": t}, {"type": "image"}], lambda t: {"type": "text", "text": t}, lambda t: None]
    lists = [[{"role": rnd.choice(["user", "assistant", "system"]), "content": rnd.choice(shapes)(rnd.choice(texts))} for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    config = Config(mode="on", threshold_tokens=60, last_turns=1, purge_after=2, routing={"prose": "extract", "error": "extract"})
    raw = [(c, i, json.dumps(m)) for c, ms in enumerate(lists) for i, m in enumerate(ms)]
    df = spark.createDataFrame(raw, "conv_id long, turn long, message string")
    done = P.compress_messages(S.with_text(df.select("conv_id", "turn", *S._parts())), config)
    got = {}
    for r in done.select("conv_id", "turn", M.with_content("message", "content").alias("m")).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], json.loads(r["m"])))
    stats = {r["conv_id"]: r for r in P.conversation_stats(done).collect()}
    for c, ms in enumerate(lists):
        kept, before, after, method = L.compress_list(ms, config)
        assert got[c] == kept
        assert (stats[c]["input_tokens"], stats[c]["output_tokens"], stats[c]["method"]) == (before, after, method)


def test_elements_and_put():
    assert N.elements('{"a": 1, "messages" : [ {"x": [1, 2]} , "b",3 ] }', "messages") == ['{"x": [1, 2]}', '"b"', "3"]
    assert N.elements('{"messages": []}', "messages") == [] and N.elements('{"messages": {}}', "messages") is None and N.elements("[", "messages") is None
    assert N.put('{"a": 1 }', "b", "2") == '{"a": 1,"b":2}' and N.put("{}", "b", "2") == '{"b":2}' and N.put('{ "b" : 1}', "b", "2") == '{ "b" : 2}'
    assert json.loads(N.put('{"b": 1, "b": 3}', "b", "2")) == {"b": 2}


def test_tool_traffic(spark):
    short, before, after = K.compress_text(LONG, 500)
    result = '{"content": [{"type": "text", "text": %s}], "structuredContent": {"text": %s, "n": 1.0}%s}'
    meta = '{"old":1,"m":{"tokensSaved":%d,"ratio":%s,"method":"extract"}}' % (before - after, N.number(after / before))
    q = json.dumps
    rows = [
        ("tools/call", result % (q(LONG), q(LONG), ', "_meta": {"old": 1}'), (result % (q(LONG), q(LONG), ', "_meta": ' + meta)).replace('[{"type": "text", "text": %s}]' % q(LONG), '[{"type":"text","text":%s}]' % q(short))),
        ("tools/call", '{"task": {"taskId": "t"}, "content": [{"type": "text", "text": %s}]}' % q(LONG), None),
        ("tools/call", '{"content": %s}' % q(LONG), None), ("tasks/get", result % (q(LONG), q(LONG), ""), None), ("tools/call", "{bad", None), ("tools/call", None, None), (None, "{}", None), ("tools/call", "[1]", None),
        ("tools/call", '{"content": [{"type": "text", "text": "tiny"}]}', None),
    ]
    df = spark.createDataFrame([(i, k, p) for i, (k, p, _) in enumerate(rows)], "request_id long, kind string, payload string")
    config = Config(mode="on", threshold_tokens=10)
    got = tools.compress_traffic(df, config, "m").orderBy("request_id").collect()
    assert [r["payload"] for r in got] == [p if new is None else new for _, p, new in rows]
    assert [r["tokens_saved"] for r in got] == [before - after] + [None] * (len(rows) - 1)
    # A repeat leaves the list, and each of the others keeps its own block; a purged one becomes text.
    m = lambda t, n: {"role": "user", "content": {"type": "text", "text": t}, "n": n}
    payload = json.dumps({"messages": [m("Uncaught exception", 0), m(LONG, 1), m(LONG, 2), m(LONG + " More.", 3), m("bye", 4)], "maxTokens": 5})
    out = json.loads(tools.compress_sampling(payload, Config(mode="on", threshold_tokens=10, last_turns=1, purge_after=2))[0])
    assert [(x["n"], x["content"]["text"]) for x in out["messages"]] == [(0, C.PURGED), (1, short), (3, K.compress_text(LONG + " More.", 500)[0]), (4, "bye")] and out["maxTokens"] == 5


def test_annotate(spark):
    responses = spark.createDataFrame([(1, False, "u"), (2, True, "u"), (3, False, None), (4, None, "u"), (5, False, "u")], "request_id long, stream boolean, usage string")
    stats = spark.createDataFrame([(i, 10, 4, 0.4, "extract") for i in range(1, 5)], "request_id long, input_tokens long, output_tokens long, ratio double, method string")
    got = {r["request_id"]: r["telemetry"] for r in S.annotate(responses, stats).collect()}
    assert tuple(got[1]) == tuple(got[4]) == (6, 0.4, "extract") and got[2] is got[3] is got[5] is None


def test_agreement(spark, tmp_path):
    left = spark.createDataFrame([(1, "a", '{"x":1,"y":[1,2]}'), (2, "a", "[1,2]"), (3, "b", "1")], "k long, g string, json string")
    right = spark.createDataFrame([(1, "a", '{"y":[1,2.0],"x":1e0}'), (2, "a", "[2,1]"), (3, "b", "1.0")], "k long, g string, json string")
    table = reports.agreement(left, right, "k", "g")
    text, whole = reports.dashboard(table, "Forms")
    assert text.splitlines()[2:] == ["| g | rows | agree | match |", "|---|---|---|---|", "| a | 2 | 1 | no |", "| b | 1 | 1 | yes |"] and not whole
    reports.write_report(table, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r").count() == 2


def test_streaming_drops_repeats(spark, tmp_path):
    schema = "session string, role string, text string, ts timestamp"
    spark.createDataFrame([("a", "user", "x"), ("a", "user", "x"), ("b", "user", "x"), ("a", "assistant", "x")], "session string, role string, text string").selectExpr("*", "timestamp'2024-01-01' AS ts").coalesce(1).write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in").withWatermark("ts", "1 hour")
    query = R.drop_repeats(stream).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["session"], r["role"]) for r in spark.table("once").collect()) == [("a", "assistant"), ("a", "user"), ("b", "user")]


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry

    assert {"pipeline_stats", "doc_tokens"} <= set(Q.QUERIES) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith("thresher.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "thresher.llm.queries", None)
    assert set(entry.queries()) == {*Q.QUERIES, *traffic.QUERIES} and set(entry.oracle_sql()) == {*Q.ORACLES, *traffic.ORACLES}
