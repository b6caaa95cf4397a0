"""The corpus pipeline against a brute-force version of its stages."""

import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from thresher.llm import pieces, toxicity

from .test_operators import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(9)
    item = prose(rnd, 30)
    docs = [(i, prose(rnd, 60) + (f"\nFollow us on page {i // 50}" if i % 2 else ""), "en", "s") for i in range(120)]
    docs += [(200 + i, docs[i][1].replace("alpha", "omega", 1), "en", "t") for i in range(10)]
    docs += [(300, prose(rnd, 40) + " " + item + " " + prose(rnd, 40), "en", "s"), (301, None, "en", "s"), (302, "", None, None), (303, docs[4][1], "en", "s")]
    docs += [(400 + i, prose(rnd, 30) + " worthless scumbag " + prose(rnd, 30), "en", "s") for i in range(30)]
    docs.append((None, prose(rnd, 20), "en", "s"))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] >= 400)) for d in docs if d[0] is not None and (d[0] < 120 or d[0] >= 400)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item


def test_run(spark, tables):
    path, docs, item = tables
    model = toxicity.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"), keep=~toxicity.held_out())
    auto = model.automaton()
    rejected = lambda t: sum(a * b for a, b in zip(toxicity.features(t or "", auto, model.window), model.weights)) >= 0
    kept = [[i, t] for i, t, _, _ in docs if not rejected(t)]
    assert {i for i, t, _, _ in docs if rejected(t)} == {d[0] for d in docs if d[0] and d[0] >= 400}
    lines = Counter(x for _, t in kept for x in {x.strip().lower() for x in (t or "").split("\n")})
    kept = [[i, "\n".join(x for x in (t or "").split("\n") if not x.strip() or lines[x.strip().lower()] < 10)] for i, t in kept]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()} for i, t in kept for w in [t.lower().split()]}
    root = {i: i for i in sets if i is not None}
    for a in sorted(root):
        for b in sorted(root):
            both = len(sets[a] & sets[b])
            if a < b and both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    kept = [(i, t) for i, t in kept if i is None or root[i] == i]
    kept = [(i, t) for i, t in kept if i != 300]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == {i for i, _ in kept}
    for i, t in kept:
        assert (got[i]["text"], got[i]["n_chars"], got[i]["ids"], got[i]["decoded"]) == (t, len(t), sp.encode(t), sp.decode(sp.encode(t)))
    assert 303 not in got and 4 in got and not any(200 <= (i or 0) < 210 for i in got)


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), tables[0]).dtypes == docs.dtypes
