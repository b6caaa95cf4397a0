"""Toxicity scores from a learned lexicon, misspellings and context.

Fitting takes a bounded sample of labelled rows (``sample_rows``, chosen by a hash of the id).  Terms
are words, or stems (a stem matches every word that begins with it), that toxic sample documents
have far more often than others, between different neighbours: copies of a text aren't so many observations.  A trie holds the terms; a Levenshtein automaton of one edit is
intersected with it and made deterministic as words are read, so a word leaves the automaton as
soon as no term is within an edit of it.  Short terms match exactly only.

Each hit is scored in a window of words around it: less where it stands in quotation marks, more
where other hits are near.  A logistic regression over a document's exact and misspelled hits and
their context scores gives the score.

What is defined for odd input: null or empty text has no hits and gets the model's score for that;
labels that are null or not 0 or 1, or whose id is null or unknown, are left out; of several
labels for an id the greatest holds; without any usable label the score is 0; where no term tells labels apart,
as when all are of one class, every score is the share of label 1, (n1 + 0.5) / (n + 1); an empty table gives
an empty table; other columns pass through, and fitting looks at none but id, text and label.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, give_back, long_id, text_slices

WORD = re.compile(r"[^\W\d_]+")
# Marks that open or close a quotation.
QUOTES = "\"“”„«»‹›"
STEMS = range(4, 8)
FEATURES = 5


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)  # a stem ends in "*"
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0] + [0.0] * (FEATURES - 1)))
    fuzzy_length: int = 5
    window: int = 8

    def automaton(self) -> "Automaton":
        return Automaton(self.terms, self.fuzzy_length)


class Automaton:
    """The terms' trie intersected with the Levenshtein automaton of one edit, determinised lazily."""

    def __init__(self, terms, fuzzy_length: int):
        self.child: list[dict[str, int]] = [{}]
        self.final: list[tuple[bool, bool, bool]] = [(False, False, False)]  # a word ends, a stem ends, an edit is allowed
        for term in terms:
            stem, at = term.rstrip("*"), 0
            for c in stem:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.final.append((False, False, False))
                at = self.child[at][c]
            word, prefix, _ = self.final[at]
            self.final[at] = (word or not term.endswith("*"), prefix or term.endswith("*"), len(stem) >= fuzzy_length)
        self.start = self._close({(0, 0)})
        self.next: dict[tuple[frozenset, str], tuple[frozenset, int]] = {}
        self.known: dict[str, int] = {}

    def _close(self, states: set[tuple[int, int]]) -> frozenset:
        # A letter that the word lacks costs an edit; a state without edits makes one with an edit needless.
        states |= {(k, 1) for n, e in states if not e for k in self.child[n].values()}
        return frozenset((n, e) for n, e in states if not e or (n, 0) not in states)

    def _step(self, states: frozenset, c: str) -> tuple[frozenset, int]:
        """The states after a letter, and whether a stem ends in them."""
        key = (states, c)
        if key not in self.next:
            out = {(self.child[n][c], e) for n, e in states if c in self.child[n]}
            out |= {x for n, e in states if not e for x in [(n, 1), *((k, 1) for k in self.child[n].values())]}
            closed = self._close(out)
            self.next[key] = closed, self._ends(closed, 1)
        return self.next[key]

    def _ends(self, states: frozenset, which: int) -> int:
        """2 if a term ends here as it is, 1 with an edit, 0 if none does."""
        return max((2 if not e else int(self.final[n][2]) for n, e in states if self.final[n][which]), default=0)

    def match(self, word: str) -> int:
        """2: a term or a word of a stem, 1: within an edit of one, 0: neither."""
        if (found := self.known.get(word)) is not None:
            return found
        states, best = self.start, 0
        for c in word:
            states, end = self._step(states, c)
            best = max(best, end)
            if best == 2 or not states:
                break
        else:
            best = max(best, self._ends(states, 0))
        if len(self.known) > 400_000:
            self.known.clear()
        self.known[word] = best
        return best


def features(text: str, auto: Automaton, window: int) -> list[float]:
    """Of a whole text: exact hits, misspelled hits, context score of each, and 1 for the constant."""
    words = WORD.findall(text.lower())
    known, match = auto.known, auto.match
    kinds = [known[w] if w in known else match(w) for w in words]
    if not any(kinds):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    hits = [(i, k) for i, k in enumerate(kinds) if k]
    exact, fuzzy, scores = 0, 0, [0.0, 0.0]
    spans = [m.span() for m in WORD.finditer(text.lower())]
    lowered = text.lower()
    for x, (i, kind) in enumerate(hits):
        exact, fuzzy = exact + (kind == 2), fuzzy + (kind == 1)
        a, b = spans[max(0, i - window)][0], spans[min(len(spans) - 1, i + window)][1]
        before, after = lowered[a : spans[i][0]], lowered[spans[i][1] : b]
        quoted = sum(before.count(q) for q in QUOTES) % 2 == 1 and any(q in after for q in QUOTES)
        near = sum(abs(hits[y][0] - i) <= window for y in (x - 1, x + 1) if 0 <= y < len(hits))
        scores[kind == 1] += (0.25 if quoted else 1.0) + 0.5 * near
    return [1.0, min(exact, 4) / 4, min(fuzzy, 4) / 4, min(scores[0], 6.0) / 6, min(scores[1], 6.0) / 6]


def _variety(sample: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each term its accessor variety: the fewer of the different words before it and after it in the sample.

    Copies of a text, near ones too, are many documents but hold a word between the same neighbours, so they
    aren't so many observations of it.  Each start or end of a text counts as a neighbour of its own.
    """

    def triples(batches):
        seen: Counter = Counter()

        def flush():
            columns = list(zip(*seen)) or [[], [], []]
            out = pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(("word", "before", "after"), columns)} | {"n": pd.Series(list(seen.values()), dtype="int64")})
            seen.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                words = WORD.findall((text or "").lower())
                seen.update(zip(words, [None, *words], [*words[1:], None]))
                if len(seen) > 1_000_000:
                    yield flush()
        yield flush()

    near = sample.select("text").mapInPandas(triples, "word string, before string, after string, n long")
    stems = [F.when(F.length("word") >= k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STEMS]
    near = near.select(F.explode(F.array_compact(F.array("word", *stems))).alias("term"), "before", "after", "n")
    near = near.join(terms.select("term"), "term", "left_semi")
    variety = lambda c: F.countDistinct(c) + F.sum(F.when(F.col(c).isNull(), F.col("n")).otherwise(0))
    return near.groupBy("term").agg(F.least(variety("before"), variety("after")).alias("variety"))


def _terms(sample: DataFrame, min_docs: int, min_share: float, min_odds: float, max_terms: int) -> dict[str, float]:
    def count(batches):
        seen = {0: Counter(), 1: Counter()}

        def flush():
            keys = list(seen[0].keys() | seen[1].keys())
            # Strings as objects: Arrow-backed ones may come in chunks, which a batch of rows can't hold.
            out = pd.DataFrame({"term": pd.Series(keys, dtype=object), "toxic": [seen[1][k] for k in keys], "clean": [seen[0][k] for k in keys]})
            seen[0].clear(), seen[1].clear()
            return out

        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                words = set(WORD.findall((text or "").lower()))
                seen[label].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
                if len(seen[0]) + len(seen[1]) > 1_000_000:
                    yield flush()
        yield flush()

    counted = sample.select("text", "label").mapInPandas(count, "term string, toxic long, clean long")
    total = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return {}
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    kept = counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= min_docs)
    candidates = kept.count()
    kept = kept.withColumn("odds", odds).where(F.col("odds") >= min_odds)
    kept = kept.join(_variety(sample.where("label = 1"), kept), "term").withColumn("seen", F.least("toxic", "variety"))
    # Evidence is the Chernoff bound, as a negative logarithm, on so large a toxic share by chance.  A rare term is
    # kept if less than one of all candidates is expected to reach that, a common one by its odds alone.
    base, q = toxic / (toxic + clean), F.col("seen") / (F.col("seen") + F.col("clean"))
    evidence = F.col("seen") * F.log(q / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - base))).otherwise(0.0)
    kept = kept.withColumn("evidence", F.when(q > base, evidence).otherwise(0.0))
    kept = kept.where((F.col("seen") >= min_share * toxic) | (F.col("evidence") >= float(np.log(max(candidates, 1)))))
    # The model is bounded by max_terms, whatever the sample; the terms of most evidence come first.
    rows = kept.orderBy(F.desc("evidence"), F.length("term"), "term").limit(20 * max_terms).collect()  # bounded by max_terms
    stems: set[str] = set()
    terms = []
    for r in sorted(rows, key=lambda r: (len(r["term"]), -r["toxic"], r["term"])):  # by length, so a stem comes before the words that it stands for
        if not any(r["term"][:k] in stems for k in STEMS):
            terms.append(r)
            if r["term"].endswith("*"):
                stems.add(r["term"][:-1])
    terms = sorted(terms, key=lambda r: (-r["evidence"], len(r["term"]), r["term"]))[:max_terms]
    return {r["term"]: float(np.log(r["odds"])) for r in sorted(terms, key=lambda r: (len(r["term"]), -r["toxic"], r["term"]))}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, sample_rows: int = 20_000, min_docs: int = 3, min_share: float = 0.02, min_odds: float = 20.0, max_terms: int = 2_000) -> Model:
    """Learn from at most ``sample_rows`` labelled rows (of those where ``keep`` holds, a condition on the labels)."""
    bound_batches(docs.sparkSession)
    usable = labels if keep is None else labels.where(keep)
    usable = usable.select(long_id(usable, id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id IS NOT NULL AND label IN (0, 1)")
    usable = usable.groupBy("__id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows))  # bounded by sample_rows
    sample = docs.select(long_id(docs, id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id").select("text", "label")
    model = Model(_terms(sample, min_docs, min_share, min_odds, max_terms))
    if not model.terms:
        n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}  # two classes
        if n:
            model.weights[0] = np.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))
        return model

    def rows(batches):
        auto = model.automaton()
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t or "", auto, model.window) for t in pdf["text"]], "label": pdf["label"]})

    # Rows of equal features are counted, so the driver gets few of them.
    data = sample.mapInPandas(rows, "x array<double>, label int").groupBy("x", "label").count().collect()
    x = np.repeat(np.array([r["x"] for r in data]), [r["count"] for r in data], axis=0)
    model.weights = _logistic(x, np.repeat([r["label"] for r in data], [r["count"] for r in data]).astype(float))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", batch_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with score (double, 0 to 1) and predicted (int, 1 if the score is 0.5 or more)."""
    if clash := [c for c in docs.columns if c in ("score", "predicted")]:
        raise ValueError(f"columns named like added ones: {clash}")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        auto = model.automaton()
        for batch in batches:
            for part, texts in text_slices(batch, text_col, batch_chars):
                x = np.array([features(t, auto, model.window) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -60, 60)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])
        del auto
        give_back()

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all ``documents``, the model learned from labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels, keep=~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
