"""Golden vectors and corpora: results that every implementation of the compression shares."""

import json
import pathlib

import pytest

from thresher.functions import content as N
from thresher.functions import kernels as K
from thresher.functions import lists as L
from thresher.functions import messages as M
from thresher.functions import text as X
from thresher.operators import strategies
from thresher.operators.config import Config
from thresher.plans import pipeline as P
from thresher.plans import reports
from thresher.sources import messages as S

GOLDEN = pathlib.Path(__file__).parent / "golden"


def load(name):
    return json.loads((GOLDEN / f"{name}.json").read_text())


def rows(spark, messages, conv=1):
    """A message list as the readers give it."""
    raw = [(conv, i, json.dumps(m, ensure_ascii=False)) for i, m in enumerate(messages)]
    df = spark.createDataFrame(raw, "conv_id long, turn long, message string")
    return S.with_text(df.select("conv_id", "turn", *S._parts()))


def as_messages(df):
    got = df.select("turn", M.with_content("message", "content").alias("m")).orderBy("turn").collect()
    return [json.loads(r["m"]) for r in got]


def test_tokens(spark):
    cases = load("tokens")
    assert K.token_counts([c["text"] for c in cases]).tolist() == [c["tokens"] for c in cases]
    df = spark.createDataFrame([(c["text"], c["tokens"]) for c in cases], "text string, n long")
    assert df.where(X.token_count("text") != df["n"]).count() == 0


def test_words(spark):
    cases = load("word-tokens")
    assert [K.words(c["text"]) for c in cases] == [c["tokens"] for c in cases]
    df = spark.createDataFrame([(c["text"], c["tokens"]) for c in cases], "text string, w array<string>")
    assert df.where(X.word_tokens(df["text"]) != df["w"]).count() == 0


def test_content(spark):
    cases = load("content")
    assert [N.content_text(c["message"].get("content")) for c in cases] == [c["text"] for c in cases]
    assert [r["text"] for r in rows(spark, [c["message"] for c in cases]).orderBy("turn").collect()] == [c["text"] for c in cases]


def test_labels(spark):
    cases = load("classifier")
    assert [L.label(N.content_text(c["message"].get("content"))) for c in cases] == [c["label"] for c in cases]
    df = rows(spark, [c["message"] for c in cases])
    assert [r[0] for r in df.orderBy("turn").select(X.classify(df["text"])).collect()] == [c["label"] for c in cases]


def test_repeats(spark):
    cases = load("repeat-tracker")
    df = strategies.repeats(rows(spark, [c["message"] for c in cases]))
    assert [r["is_repeat"] for r in df.orderBy("turn").collect()] == [c["isRepeat"] for c in cases]


def test_strategies(spark):
    case = load("strategies")
    df = rows(spark, case["input"])
    assert as_messages(strategies.dedup(df)) == case["dedup"]
    purged = strategies.purge_errors(df, 2)
    assert [r["text"] for r in purged.orderBy("turn").collect()] == [m["content"] for m in case["purgeAfter2"]]


def test_extract(spark):
    for c in load("extract"):
        sentences = K.segment(c["text"])
        assert [{"text": t, "listItem": item} for t, item in sentences] == c["sentences"]
        assert " ".join(sentences[i][0] for i in K.select(sentences, c["ratioMillis"])) == c["selected"]


def test_middleware(spark):
    case = load("middleware")
    config = Config(mode="on", threshold_tokens=10, last_turns=1, ratio=0.5)
    done = P.compress_messages(rows(spark, case["input"]), config)
    assert as_messages(done) == case["output"]
    stats = P.conversation_stats(done).first()
    assert (stats["input_tokens"], stats["output_tokens"], stats["method"]) == (1347, 1184, "hybrid") == (case["inputTokens"], case["outputTokens"], case["method"])
    kept, before, after, method = L.compress_list(case["input"], config)
    assert ([m for _, m in kept], before, after, method) == (case["output"], 1347, 1184, "hybrid")


@pytest.mark.parametrize(("name", "before", "after"), [("prose-heavy", 1555, 958), ("agent-heavy", 631, 619)])
def test_corpora(spark, name, before, after):
    config = Config(mode="on", threshold_tokens=10, last_turns=0, ratio=0.5)
    df = S.read_lists(spark, f"file://{GOLDEN}/{name}.json").withColumnRenamed("file", "conv_id")
    stats = P.conversation_stats(P.compress_messages(df, config)).first()
    assert (stats["input_tokens"], stats["output_tokens"]) == (before, after)
    assert L.compress_list(load(name), config)[1:3] == (before, after)


@pytest.mark.parametrize(
    ("name", "tokens", "terms", "digits"),
    [("prose-heavy", (1555, 958, 963), (0.6956, 0.7136), (0.7368, 0.7368)), ("agent-heavy", (260, 248, 235), (0.9487, 0.9060), (1.0, 1.0))],
)
def test_quality(spark, name, tokens, terms, digits):
    """The report's totals; its compression is of whole texts, as no message here is prose in several blocks."""
    df = S.read_lists(spark, f"file://{GOLDEN}/{name}.json").where("text <> ''")
    r = reports.quality(df, "file", 500).first()
    assert (r["input_tokens"], r["output_tokens"], r["baseline_tokens"]) == tokens
    assert (r["terms_kept"] / r["terms"], r["baseline_terms_kept"] / r["terms"]) == pytest.approx(terms, abs=1e-4)
    assert r["digit_terms_kept"] / r["digit_terms"] == pytest.approx(digits[0], abs=1e-4)
