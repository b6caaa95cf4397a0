"""Operators against brute force, on small tables with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest

from thresher.llm import decontaminate, jaccard, line_dedup, lm, pieces, sharding, substrings, token_files, toxicity, vectors
from thresher.llm.common import components

SCHEMA = "doc_id long, text string, source string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", ".", "é"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    passage = prose(rnd, 60)
    out = [(i, prose(rnd, rnd.randint(1, 90)) + "\n" + rnd.choice(["Shared line", " shared LINE\t", "own " + str(i)]), "s") for i in range(40)]
    out += [(100 + i, passage + "\n" + prose(rnd, 10), "s") for i in range(4)]
    out += [(110, out[0][1], "s"), (111, out[0][1], "t"), (112, out[1][1] + " tail", "t")]
    long = prose(rnd, 6000)
    out += [(120, None, None), (121, "", "s"), (122, " \t\n", "s"), (123, "one", "s"), (124, long, "s"), (125, long.replace("alpha", "beta", 3), "s"), (126, "é ▁▁ x\x00y 😀", "s")]
    out += [(0, out[0][1], "s")]  # a row that repeats
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces(docs, empty, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode_decode(docs, table_rows=50, batch_chars=300).collect()}
    for i, t, _ in rows:
        ids = sp.encode(t or "")
        assert got[i] == (ids, sp.decode(ids))
    assert pieces.encode_decode(empty).collect() == []
    with pytest.raises(ValueError, match="named like"):
        pieces.encode_decode(docs.withColumnRenamed("source", "ids"))


def test_decontaminate(spark, docs, empty, rows):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    texts = {i: t for i, t, _ in rows}
    items = [(1, " ".join(cut(texts[100])[5:40])), (2, texts[3]), (3, "alpha beta"), (4, None), (5, "zeta"), (6, "Q " * 14), (1, "sigma tau alpha"), (None, texts[5][:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench).collect()}
    for i, t, _ in rows:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    found.add("" if item is None else str(item))
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), i
    assert decontaminate.find_contamination(empty, bench).collect() == []
    assert sum(r["n_hit"] for r in decontaminate.find_contamination(docs, bench.limit(0)).collect()) == 0


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50), (1, 10), (3, 100)])
def test_jaccard(spark, rows, empty, n, percent):
    rnd = random.Random(n)
    base = prose(rnd, 120).split()
    family = []
    for i in range(60):  # copies with a few words changed: links between some, chains between others
        w = list(base)
        for _ in range(i % 9):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        family.append((500 + i, " ".join(w), "f"))
    family.append((None, " ".join(base), "f"))
    family += [(600 + k, " ".join(f"w{i}" for i in range(10 ** (k + 1))), "s") for k in range(3)]  # one inside the other: a tenth at 1 word
    data = rows + family
    found = jaccard.jaccard_components(spark.createDataFrame(data, SCHEMA), n, percent, block_bytes=20_000, bucket_rows=300, chunk=17, chunk_shingles=900).collect()
    sets = {}
    for i, t, _ in data:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, rows_of = sorted(root), Counter(i for i, _, _ in data)
    links = {i: rows_of[i] - 1 if sets[i] else 0 for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a != b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                if p != q:
                    root[q] = p
                links[a] += rows_of[b]
    assert len(found) == len(data)
    for r in found:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"]))
        assert r["n_links"] == links.get(r["doc_id"])
    if n == 1:
        assert find(602) == find(601) == find(600)
    assert jaccard.jaccard_components(empty).collect() == []


def test_lines(docs, empty, rows):
    strip = lambda s: s.strip(" \t\n\x0b\x0c\r")
    key = lambda s: "".join(c.lower() if c.isascii() else c for c in strip(s))
    count = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    expected = Counter()
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or count[key(x)] < 10]
        expected[(i, "\n".join(kept), s, len(lines), len(lines) - len(kept))] += 1
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(docs).collect()) == expected
    assert any(r[4] for r in expected)
    assert line_dedup.dedup_lines(empty).collect() == []


def test_line_key_keeps_other_letters(spark):
    from pyspark.sql import functions as F

    lines = ["À", "à", "É\t", "é", "Ñ", "ñ", "ãé", "Ãé", "中", "ä¸­", "K", "k", "K", "İ", "i", "ß", "\xa0x", "x"]
    keys = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(line_dedup.line_key(F.col("x"))).collect()]
    exact = ["".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
    assert all((keys[a] == keys[b]) == (exact[a] == exact[b]) for a in range(len(lines)) for b in range(len(lines)))


def test_vectors(spark):
    rng = np.random.default_rng(3)
    data, centres = [], rng.standard_normal((12, 16))
    for c, m in enumerate([1, 2, 3, 5, 60, 90, 1, 1, 1, 1, 1, 1]):
        data += [(len(data) + k, (centres[c] + 0.08 * rng.standard_normal(16)).tolist(), c % 3) for k in range(m)]
    data += [(900 + i, rng.standard_normal(16).tolist(), i % 3) for i in range(120)]
    data += [(2000, data[0][1], 0), (2001, data[0][1], 1), (2002, None, 0), (2003, [0.0] * 16, 0), (2004, [None] + [1.0] * 15, 0), (2005, [float("nan")] * 16, 0), (2006, data[0][1], None), (2007, [1.0, 2.0], 0), (None, data[0][1], 0), (2008, [], 0), (2009, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame, leaf=16, chunk=25).collect()}
    assert len(got) == len(data)
    good = [(i, np.array(v, float), lab) for i, v, lab in data if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: [j for j, w, m in good if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for i, v, lab in good}
    comp = {i: i for i in got if i is not None}
    for _ in range(len(good)):
        new = {i: min([c] + [comp[j] for j in links.get(i, [])]) for i, c in comp.items()}
        if new == comp:
            break
        comp = new
    for i, r in got.items():
        if i is not None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(links.get(i, [])), comp[i], comp[i] == i), i
    assert vectors.near_duplicates(frame.limit(0)).collect() == []


def brute_vectors(data):
    """(n_links, component) of each id of rows (id, vector, label)."""
    ids, labels = np.array([r[0] for r in data]), np.array([r[2] for r in data])
    unit = np.array([r[1] for r in data], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (labels[:, None] == labels)
    comp = np.where(linked, ids, ids.max() + 1).min(1)
    while (new := np.where(linked, comp, ids.max() + 1).min(1)).tolist() != comp.tolist():
        comp = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1) - 1, comp)}


def test_vectors_close_families(spark):
    # Families of 0.99 within and just over 0.93 between: each has more members than a list has places.
    rng = np.random.default_rng(4)
    data = []
    for _ in range(4):
        q = np.linalg.qr(rng.standard_normal((32, 3)))[0].T
        for side in (1, -1):
            centre = np.cos(0.183) * q[0] + side * np.sin(0.183) * q[1]
            data += [(len(data) + i, (centre + 0.006 * rng.standard_normal(32)).tolist(), 0) for i in range(60)]
    expected = brute_vectors(data)
    assert len({c for _, c in expected.values()}) == 4
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(frame, leaf=16, sample=1, recall=0.0).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == expected


def test_vectors_isolated_pairs(spark):
    # Pairs just over the threshold without any other neighbours; leaves so small that eight trees miss some.
    rng = np.random.default_rng(6)
    data = []
    for _ in range(150):
        u, v = np.linalg.qr(rng.standard_normal((48, 2)))[0].T
        data += [(len(data) + i, w.tolist(), 0) for i, w in enumerate((u, 0.935 * u + np.sqrt(1 - 0.935**2) * v))]
    data += [(len(data) + i, rng.standard_normal(48).tolist(), 0) for i in range(1_700)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(frame, leaf=4).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == brute_vectors(data)
    with pytest.raises(RuntimeError, match="the audit found"):
        vectors.near_duplicates(frame, leaf=2, trees=1, pair_recall=0.0, more=1)


def test_vectors_tree_count():
    for depth in (0, 3, 6, 10, 17):
        n = int(vectors.tree_count(np.array([depth]), 0.93, 0.999, 8)[0])
        missed = (1 - 0.88021**depth) ** n
        assert n >= 8 and missed <= 0.001


def lm_brute(texts, train, seeds, classes, weight=0.95):
    """Scores of texts by the method's rules over whole texts, without blocks or buckets."""
    tokens = [(t or "").encode().lower().split() + [lm.END] for t in texts]
    learn = [x for x, ok in zip(tokens, train) if ok]
    count = Counter(w for x in learn for w in x)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])) if w != lm.END][:seeds]
    place = {w: i for i, w in enumerate(top)} | {lm.END: len(top) + 1}
    bigrams = np.zeros((len(top) + 2,) * 2, np.int64)
    for x in learn:
        for v, w in zip([lm.END, *x], x):
            bigrams[place.get(v, len(top)), place.get(w, len(top))] += 1
    of = lm.exchange(bigrams, classes, fixed=2)
    k, classes = int(of.max()) + 1, max(1, min(classes, len(top)))
    table = np.zeros((k, k))
    for (v, w), n in np.ndenumerate(bigrams):
        table[of[v], of[w]] += n
    kind = {w: int(of[i]) for w, i in place.items()} | {lm.END: classes}
    symbol = lambda w: int(of[place.get(w, len(top))])
    around = defaultdict(Counter)
    for x in learn:
        for i, w in enumerate(x):
            if w not in place:
                around[w][symbol(x[i - 1] if i else lm.END), None] += 1
                around[w][None, symbol(x[i + 1])] += 1
    for w, contexts in around.items():
        gain = [sum(n * (np.log((table[b, c] + 1) / (table[:, c].sum() + k)) if a is None else np.log((table[c, a] + 1) / (table[c].sum() + k))) for (b, a), n in contexts.items()) for c in range(classes)]
        best = sorted(range(classes), key=lambda c: (-gain[c], c))
        kind[w] = best[0] if len(best) < 2 or gain[best[0]] - gain[best[1]] > 1e-9 else None  # a tie may go either way
    total, types = sum(count.values()), len(count)
    return tokens, count, kind, total, types


def test_lm(spark, docs, empty, rows):
    from pyspark.sql import functions as F

    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm.score_texts(docs, train, block_tokens=700, bucket_words=60, seeds=15, classes=4).collect()
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _, _ in rows]
    tokens, count, kind, total, types = lm_brute([t for _, t, _ in rows], learn, 15, 4)
    assert None not in kind.values()
    classes = 4
    words, sums, table = np.zeros(classes + 1, int), np.zeros(classes + 1, int), np.zeros((classes + 1,) * 2)
    for w, n in count.items():
        words[kind[w]] += 1
        sums[kind[w]] += n
    for x, ok in zip(tokens, learn):
        for v, w in zip([lm.END, *x], x) if ok else ():
            table[kind[v], kind[w]] += 1
    unknown = int(np.argmax(words[:classes]))
    unigram = (sums + 1) / (sums.sum() + classes + 1)
    step = (table + 10 * unigram) / (table.sum(1, keepdims=True) + 10)
    step[:, (sums == 0) & (np.arange(classes + 1) != unknown)] = 0
    step /= step.sum(1, keepdims=True)
    model = lm.make_model(table, words, sums, 0.95)
    assert model.transitions == pytest.approx(step) and (model.unknown, model.tokens, model.types) == (unknown, total, types)
    of, share = model.emission(np.array([*(kind[w] for w in count), 0]), np.array([*count.values(), 0]))  # all known words and an unknown one
    assert (model.transitions[:, of] * share).sum(1) == pytest.approx(1)
    expected = {}
    for (i, _, _), x in zip(rows, tokens):
        score = base = 0.0
        for v, w in zip([lm.END, *x], x):
            a, b = (kind[u] if count[u] else unknown for u in (v, w))
            share = (count[w] + 1) / (sums[unknown] + words[unknown] + 1) if b == unknown else count[w] / sums[b]
            alone = (count[w] + 1) / (total + types + 1)
            score += np.log10(0.95 * step[a, b] * share + 0.05 * alone)
            base += np.log10(alone)
        expected[i] = (len(x), sum(count[w] > 0 for w in x), total, base, score)
    assert len(got) == len(rows)
    for r in got:
        n, known, all_tokens, base, score = expected[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, all_tokens)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    assert lm.score_texts(empty, train).collect() == []
    none = lm.score_texts(docs, F.lit(False)).collect()
    assert {r["n_known"] for r in none} == {0} and all(np.isfinite(r["score"]) for r in none)


def test_exchange_is_settled():
    rng = np.random.default_rng(5)
    table = rng.poisson(0.4, (30, 30)) * rng.integers(0, 9, (30, 30))
    found = lm.exchange(table, 4, fixed=2)

    def likelihood(of):
        member = np.zeros((30, 6))
        member[np.arange(30), of] = 1
        t = member.T @ table @ member
        return sum((x[x > 0] * np.log(x[x > 0])).sum() for x in (t,)) - sum((x[x > 0] * np.log(x[x > 0])).sum() for x in (t.sum(0), t.sum(1)))

    best = likelihood(found)
    for w in range(28):
        for c in range(4):
            assert likelihood(np.where(np.arange(30) == w, c, found)) <= best + 1e-6


def test_exchange_gains():
    rng = np.random.default_rng(0)
    n, kinds = 24, 3
    of = np.arange(n) % kinds
    table = np.zeros((n + 1, n + 1), np.int64)
    state = 0
    for _ in range(20_000):  # a chain that goes through the kinds in turn
        new = rng.choice(np.flatnonzero(of == (of[state] + 1) % kinds))
        table[state, new] += 1
        state = new
    rng.shuffle(perm := np.arange(n))
    table[:n, :n] = table[np.ix_(perm, perm)]
    found = lm.exchange(table, kinds, fixed=1)[:n]
    assert len({(a, b) for a, b in zip(found, of[perm])}) == kinds


@pytest.mark.parametrize("percent", [10, 33, 50, 80, 90, 99])
def test_length_bounds(percent):
    bounds = jaccard.length_bounds(30_000, percent)
    of = lambda size: sum(b <= size for b in bounds)
    for size in range(1, 30_000, 7):
        assert of(size) <= of(min(30_000, 100 * size // percent)) <= of(size) + 1


def test_prints_in_steps():
    data = np.random.default_rng(2).integers(0, 256, 5_000, dtype=np.uint8)
    at = np.sort(np.random.default_rng(3).choice(4_900, 700, replace=False))
    whole = substrings.Prints(data, substrings.BASES[0]).of(at, 100)
    assert (substrings.prints_at(data, at, 100, substrings.BASES[0], step=333) == whole).all()


@pytest.mark.parametrize(("block", "bucket"), [(10**7, 10**6), (3_000, 200)])
def test_substrings(docs, empty, rows, block, bucket):
    for length in (200, 30):
        texts = [(t or "").encode() for _, t, _ in rows]
        count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
        expected = Counter()
        for (i, _, _), t in zip(rows, texts):
            hit = np.zeros(len(t), bool)
            for p in range(len(t) - length + 1):
                if count[t[p : p + length]] > 1:
                    hit[p : p + length] = True
            runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
            expected[(i, len(t), tuple(runs.tolist()), bytes(np.frombuffer(t, np.uint8)[~hit]))] += 1
        got = substrings.remove_repeats(docs, length, block_bytes=block, bucket_rows=bucket).collect()
        assert Counter((r["doc_id"], r["n_bytes"], tuple(x for s in r["spans"] for x in s), bytes(r["kept"])) for r in got) == expected
    assert substrings.remove_repeats(empty).collect() == []


def test_covers():
    for v, d in substrings.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_toxicity(spark):
    rnd = random.Random(2)
    clean = [(i, prose(rnd, 40)) for i in range(300)]
    toxic = [(1000 + i, prose(rnd, 20) + " you " + rnd.choice(["scumbag", "worthless", "idiotic"]) + " " + rnd.choice(["scumbag", "worthless"]) + " " + prose(rnd, 20)) for i in range(80)]
    odd = [(5000, None), (5001, ""), (5002, prose(rnd, 10) + " wortless scumbagg worthles " + prose(rnd, 10)), (None, "x")]
    docs = spark.createDataFrame(clean + toxic + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic] + [(None, 1), (7, None), (8, 3)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, keep=~toxicity.held_out())
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == 0 for i, _ in clean) and all(got[i]["predicted"] == 1 for i, _ in toxic)
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0
    assert got[5002]["score"] > 10 * got[0]["score"]
    assert toxicity.score(docs.limit(0), model).collect() == []
    for label in (0, 1):  # labels of one class: their share, for every text
        one = toxicity.fit(docs, labels.where(f"toxic = {label} AND doc_id IS NOT NULL"))
        n = 300 if label == 0 else 80
        assert {round(r["score"], 9) for r in toxicity.score(docs, one).collect()} == {round((n * label + 0.5) / (n + 1), 9)}
    blank = toxicity.fit(docs, labels.limit(0))
    assert all(r["predicted"] == 0 for r in toxicity.score(docs, blank).collect())


def test_toxicity_scores(spark):
    """Scores worked out anew: hits by edit distance to every term, contexts by slices, weights by what makes the fit best."""
    rnd = random.Random(12)
    terms, short = ["scumbag", "worthless", "idiotic*"], ["hag"]
    model = toxicity.Model({t: 1.0 for t in terms + short}, np.array([-2.0, 1.5, 0.7, 2.5, 1.1]))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    def kind(w):
        best = 0
        for t in terms + short:
            stem = t.rstrip("*")
            d = min(distance(w[:k], stem) for k in range(len(w) + 1)) if t.endswith("*") else distance(w, stem)
            best = max(best, 2 if d == 0 else 1 if d == 1 and len(stem) >= 5 else 0)
        return best

    def score(text):
        text = (text or "").lower()
        spans = [m.span() for m in toxicity.WORD.finditer(text)]
        hits = [(i, k) for i, (a, b) in enumerate(spans) if (k := kind(text[a:b]))]
        x = [1.0, 0, 0, 0, 0]
        for i, k in hits:
            left = text[spans[max(0, i - 8)][0] : spans[i][0]]
            right = text[spans[i][1] : spans[min(len(spans) - 1, i + 8)][1]]
            quoted = sum(c in toxicity.QUOTES for c in left) % 2 == 1 and any(c in toxicity.QUOTES for c in right)
            near = sum(0 < abs(j - i) <= 8 for j in [*[j for j, _ in hits if j < i][-1:], *[j for j, _ in hits if j > i][:1]])
            x[1 if k == 2 else 2] += 1
            x[3 if k == 2 else 4] += (0.25 if quoted else 1.0) + 0.5 * near
        x = [1.0, min(x[1], 4) / 4, min(x[2], 4) / 4, min(x[3], 6) / 6, min(x[4], 6) / 6]
        return 1 / (1 + np.exp(-np.dot(x, model.weights)))

    bad = ["scumbag", "scumbg", "idiotically", "idiotc", "hag", "hags", "“worthless”", '"scumbag"', "Worthless,", "wortless"]
    texts = [" ".join(rnd.choice(bad if rnd.random() < 0.25 else WORDS) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "scumbag " * 3000, texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        assert r["score"] == pytest.approx(score(texts[r["doc_id"]])) and r["predicted"] == (r["score"] >= 0.5)
    x = np.array([[1.0, 0.2], [1.0, 0.9], [1.0, 0.4], [1.0, 0.7]])
    y = np.array([0.0, 1.0, 1.0, 0.0])
    w = toxicity._logistic(x, y)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (1e-3 * w[0] ** 2 + 0.5 * w[1] ** 2)
    assert all(loss(w) <= loss(w + d) for d in np.vstack([np.eye(2), -np.eye(2)]) * 1e-3)


def test_automaton():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    rnd = random.Random(1)
    terms = ["abcab", "bcabca", "aab", "ccbaa*"]
    auto = toxicity.Automaton(terms, 5)
    for _ in range(3000):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9)))
        best = 0
        for t in terms:
            s = t.rstrip("*")
            d = min(distance(w[:k], s) for k in range(len(w) + 1)) if t.endswith("*") else distance(w, s)
            best = max(best, 2 if d == 0 else 1 if d == 1 and len(s) >= 5 else 0)
        assert auto.match(w) == best, w


def test_quotation_scores_less():
    auto = toxicity.Automaton(["idiotic"], 5)
    plain, quoted = (toxicity.features(t, auto, 8) for t in ("you are idiotic today", 'they said "you are idiotic" today'))
    assert plain[3] > quoted[3] > 0


def test_token_files(spark, docs, empty, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    path = f"file://{tmp_path}/t"
    token_files.write(docs, path, segment_tokens=500, table_rows=40, batch_chars=400)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _, _ in rows)
    texts, start = {i: t for i, t, _ in rows}, 0
    for r in got:
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        assert (r["start"], r["ids"]) == (start, ids)
        start += len(ids)
    token_files.write(empty, f"{path}-empty")
    assert token_files.read(spark, f"{path}-empty").collect() == []


def test_word_table_encodes_little():
    """Words differing in case or in the punctuation behind them are encoded once, and a full table keeps what came again."""

    class Spy:
        def __init__(self, tok):
            self.tok, self.sent = tok, []

        def encode_batch_fast(self, texts, **kw):
            self.sent += texts
            return self.tok.encode_batch_fast(texts, **kw)

    table = token_files.WordTable(token_files.default_tokenizer(), 200)
    table.tok, table.bare = whole, bare = Spy(table.tok), Spy(table.bare)
    common = " ".join(WORDS)
    table.encode([common, " ".join(w.title() + tail for w in WORDS for tail in ("!!", "...", ",***", "'"))], 1)
    assert sorted(" ".join(bare.sent).split()) == sorted(WORDS)
    assert not any(w in t.lower() for t in whole.sent for w in WORDS)
    rare = lambda k: " ".join(f"rare{''.join(chr(97 + int(d)) for d in str(k * 1000 + j))}" for j in range(250))
    table.encode([f"{common} {rare(1)}"], 1)
    bare.sent.clear()
    table.encode([f"{common} {rare(2)}"], 1)
    assert len(table.words) == len(WORDS) + 250 and not set(" ".join(bare.sent).split()) & set(WORDS)


def test_word_table_on_odd_words():
    from tokenizers import Tokenizer

    tok, rnd = Tokenizer.from_file(token_files.default_tokenizer()), random.Random(7)
    parts = ["foo", "Foo", "É", "e\u0301", "ß", "ẞ", "İ", "ſ", "K", "µ", "ª", "×", "Ÿ", "a" * 300, "don't", "'s", "'reason", "'", ".", ",", "...", "$$$", "<|", "|>", "<|endoftext|>", "<", "=", "\u0338", "_", "-", "23", "²", "\n", "\t", "\x0b", "  ", "\u00a0", "\u2003", "\x85", "\x00", "\x1c", "\u200b", "😀", "中文", "ﬁ", "Привет"]
    table = token_files.WordTable(token_files.default_tokenizer(), 300)
    for _ in range(8):
        texts = ["".join(rnd.choice(parts) + rnd.choice(["", "", " "]) for _ in range(rnd.randint(0, 12))) for _ in range(150)]
        ids, n = table.encode(texts, 1)
        for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == tok.encode(t, add_special_tokens=False).ids + [1], repr(t)


def test_short_texts_are_encoded_together():
    import pyarrow as pa

    rows = [(i, "" if i % 3 else f"text {i}") for i in range(600)]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows[k : k + 10]]) for k in range(0, 600, 10)]
    got = list(token_files._gathered(iter(batches), 4000))
    assert [x for ids, texts in got for x in zip(ids, texts)] == rows
    assert 2 <= len(got) <= 4


def test_token_files_query(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    texts, start = {i: t for i, t, _ in rows}, 0
    got = token_files.query(spark, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(i for i, _, _ in rows)
    for r in got:
        ids = np.array(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_directly_addressable_codes():
    ids = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint64)
    ids[::2] %= 300
    codes = token_files.Dac(token_files.dac_encode(ids))
    assert [codes[i] for i in range(len(ids))] == ids.tolist()
    assert all((codes.run(a, a + 77) == ids[a : a + 77]).all() for a in range(0, 4900, 13))
    assert len(token_files.Dac(token_files.dac_encode(ids[:0]))) == 0


def test_sharding(docs, empty, rows):
    out = sharding.shard_rows(docs, shards=7, part_rows=6, bin_rows=3).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted((r["doc_id"], r["text"]) for r in out if r["text"]) == sorted((i, t) for i, t, _ in rows if t)
    assert len(out) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.shard_rows(docs.repartition(5), shards=7, part_rows=6, bin_rows=3).collect()
    place = lambda x: sorted((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest(), r["shard"], r["slot"]) for r in x if r["doc_id"])
    assert place(out) == place(again)
    assert sharding.shard_rows(empty).collect() == []


def test_sharding_of_equal_rows(spark):
    rows = [(None, "", "s")] * 300 + [(i, str(i), "s") for i in range(40)]
    out = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=4, part_rows=20, bin_rows=10).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == 340 and all(sorted(s) == list(range(85)) for s in slots.values())
    hot = Counter(r["shard"] for r in out if r["doc_id"] is None)
    assert min(hot.values()) > 50


def test_sharding_query(spark, docs, rows, tmp_path, monkeypatch):
    """The query puts the texts themselves into shards, and its digests are of the texts that came there."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, real = [], sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda *args, **kw: kept.append(real(*args, **kw)) or kept[-1])
    query = sharding.query(spark, str(tmp_path))
    moved = {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in kept[0].collect()}
    assert Counter(moved.values()) == Counter((i, t) for i, t, _ in rows)
    out = query.collect()
    assert len(out) == len(rows) and {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
    for r in out:
        i, t = moved[r["shard"], r["slot"]]
        utf8 = (t or "").encode()
        assert (r["doc_id"], r["size"], r["text_crc32"]) == (i, len(utf8) + 1, zlib.crc32(utf8))
    # The plan doesn't leave them out either: the exchange into shards carries them.
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(query._jdf.queryExecution(), "formatted")
    sent = [node for node in plan.split("\n\n") if "Exchange" in node and "__again" in node]
    assert sent and all("text#" in node for node in sent)


def test_sharding_has_a_task_for_each_part(spark, docs, rows, monkeypatch):
    """Two exchanges carry the texts, with a task for each part and each bin, also where the joins aren't broadcast."""
    monkeypatch.setattr(sharding, "maybe_broadcast", lambda df, row_bytes: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = sharding.shard_rows(docs, shards=3, part_rows=6, bin_rows=3)
        plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
        sent = [node for node in plan.split("\n\n") if "Exchange" in node and "text#" in node and "__order#" in node]  # not the one of the fixture
        parts, boxes = -(-len(rows) // 6), 3 * -(-len(rows) // 9)
        assert len(sent) == 2 and f", {parts})" in sent[0] and f", {boxes})" in sent[1], sent
        assert sorted((r["shard"], r["slot"]) for r in out.collect()) == sorted((i % 3, i // 3) for i in range(len(rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sharding_of_equal_checksums(spark):
    """Different texts of one CRC32 and no id are told apart, so that a task that runs again deals them out as before."""
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    texts = ["plumless", "buckeroo"]
    place = lambda x: {r["text"]: (r["shard"], r["slot"]) for r in sharding.shard_rows(spark.createDataFrame([(None, t, "s") for t in x], SCHEMA).coalesce(1), shards=2).collect()}
    assert place(texts) == place(texts[::-1])


def test_sharding_writes_equal_rows_only(spark, monkeypatch):
    """Numbers that spread equal rows are written for these alone, not with the texts of all other rows."""
    written, real = {}, sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name: written.setdefault(name, real(df, name)))
    rows = [(None, "", "s")] * 60 + [(i, str(i), "s") for i in range(40)]
    out = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=4, part_rows=20, bin_rows=10)
    assert Counter((r["doc_id"], r["text"]) for r in written["spread"].collect()) == {(None, ""): 60}
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((i, t) for i, t, _ in rows)


CLASHES = {
    "n_hit": lambda d, spark: decontaminate.find_contamination(d, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
    "n_lines": lambda d, spark: line_dedup.dedup_lines(d),
    "score": lambda d, spark: toxicity.score(d, toxicity.Model()),
    "slot": lambda d, spark: sharding.shard_rows(d),
}


@pytest.mark.parametrize("name", sorted(CLASHES))
def test_clashing_columns(spark, docs, name):
    with pytest.raises(ValueError, match="named like"):
        CLASHES[name](docs.withColumnRenamed("source", name), spark)


def test_clashing_columns_elsewhere(docs):
    """Operators that return no other columns don't mind what these are called."""
    named = docs.limit(12).withColumnRenamed("source", "n_shingles").selectExpr("*", "1 AS block", "2 AS `key`", "3 AS component_id")
    from pyspark.sql import functions as F

    assert jaccard.jaccard_components(named).count() == substrings.remove_repeats(named).count() == lm.score_texts(named, F.lit(True)).count() == 12


def test_texts_as_ids_raise(spark):
    named = spark.createDataFrame([("x", "some text", [1.0], 1)], "doc_id string, text string, embedding array<double>, label int")
    from pyspark.sql import functions as F

    for run in (jaccard.jaccard_components, substrings.remove_repeats, lambda d: lm.score_texts(d, F.lit(True)), lambda d: vectors.near_duplicates(d, id_col="doc_id"), lambda d: toxicity.fit(named, d, label_col="label")):
        with pytest.raises(ValueError, match="whole numbers"):
            run(named)


def test_matrix_margins():
    counts, sizes = np.array([5, 0, 7, 30, 1]), np.array([10, 11, 11, 11])
    total, known = np.concatenate([[0], np.cumsum(counts)]), {}
    matrix = np.array([sharding.matrix_row(p, total, sizes, 3, known) for p in range(len(counts))])
    assert (matrix.sum(0) == sizes).all() and (matrix.sum(1) == counts).all()
    assert all((sharding.matrix_row(p, total, sizes, 3) == matrix[p]).all() for p in range(len(counts)))


def test_matrix_of_many_rows():
    counts, sizes = np.array([3 * 10**9, 10**9, 0, 5 * 10**9 + 1]), np.array([10**9] * 8 + [10**9 + 1])
    total = np.concatenate([[0], np.cumsum(counts)])
    matrix = np.array([sharding.matrix_row(p, total, sizes, 3) for p in range(len(counts))])
    assert (matrix.sum(0) == sizes).all() and (matrix.sum(1) == counts).all()
    assert abs(matrix[0] / 3e9 * 9 - 1).max() < 1e-3


@pytest.mark.parametrize("good, bad, draws", [(40, 60, 30), (3, 50, 50), (60, 5, 20), (7, 0, 3), (0, 7, 3), (5, 5, 10)])
def test_hypergeometric(good, bad, draws):
    """The sampler for large populations against the exact distribution, on small ones."""
    rng, n = np.random.default_rng(8), 20_000
    seen = np.bincount([sharding.hypergeometric(rng, good, bad, draws, 0) for _ in range(n)], minlength=draws + 1)
    exact = np.array([comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(draws + 1)])
    assert abs(seen / n - exact).max() < 5 * (0.25 / n) ** 0.5


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(80)] + [(5000, 5001 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: c for x, c in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_toxicity_rare_terms(spark):
    # 60 terms, each in 16 of 960 toxic documents (1.7 %), and one by chance in 3 toxic ones.
    slurs = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}zqzq" for i in range(60)]
    rnd = random.Random(8)
    data = [(i, prose(rnd, 12) + " " + slurs[i % 60] + (" chancex" if i < 3 else ""), 1) for i in range(960)]
    data += [(1_000 + i, prose(rnd, 12), 0) for i in range(960)]
    sample = spark.createDataFrame(data, "id long, text string, label int").select("text", "label")
    terms = toxicity._terms(sample, 3, 0.02, 20.0, 2_000)
    known = lambda w, terms: w in terms or any(w.startswith(s[:-1]) for s in terms if s.endswith("*"))
    assert all(known(w, terms) for w in slurs) and not known("chancex", terms)
    # Where max_terms binds, the terms of most evidence stay, though they are long.
    data += [(2_000 + i, "verylongcommonslur", 1) for i in range(100)]
    sample = spark.createDataFrame(data, "id long, text string, label int").select("text", "label")
    assert known("verylongcommonslur", toxicity._terms(sample, 3, 0.0, 10.0, 2))


def test_toxicity_of_near_copies(spark):
    # 40 near copies of a toxic text: its slur is learned from other texts too, its other words aren't.
    rnd = random.Random(9)
    words = [f"{chr(97 + i) * 3}copied" for i in range(20)]
    data = []
    for i in range(40):
        text = list(words)
        text[rnd.randrange(20)] = "other"
        data.append((" ".join([*text, "zqslur", prose(rnd, 3)]), 1))
    data += [(prose(rnd, 6) + " zqslur " + prose(rnd, 6), 1) for _ in range(100)]
    data += [(prose(rnd, 12), 0) for _ in range(600)]
    terms = toxicity._terms(spark.createDataFrame(data, "text string, label int"), 3, 0.02, 20.0, 2_000)
    known = lambda w: w in terms or any(w.startswith(s[:-1]) for s in terms if s.endswith("*"))
    assert known("zqslur") and not any(map(known, words))
