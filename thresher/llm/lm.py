r"""Language-model scores from Brown-style class n-grams.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, and one end for each text.  The corpus is read
once into blocks: each holds its own vocabulary, its tokens as numbers into that, and how often each
word occurs in its training texts.  From these,

1. all words are counted: a block sends its words, packed, to buckets by their hash;
2. the ``seeds`` most frequent words are put in classes by exchange clustering: their bigrams in all training
   texts are counted, and each word in turn moves to the class where the class bigram likelihood is
   greatest, until none moves.  The end is a class of its own;
3. every other word moves once, from its own contexts: how often each class stands before and after it in
   all training texts is summed in its bucket, and it goes to the class of the greatest gain in that likelihood.
   (Words are rare beside classes, so the gain is linear in the contexts; those that share no context with a
   seed are told apart by how often unseeded words and ends are their neighbours);
4. counts and classes go back to the blocks, class bigrams are counted over all words, and each block scores
   its texts.

p(w | v) = weight * p(class w | class v) * p(w | class w) + (1 - weight) * base(w), where class
transitions are smoothed by class frequencies and a word's emission is its share of its class.
Unknown words are in the class of the most different words, whose emissions are
(count + 1) / (tokens of the class + its words + 1), and base is the unigram estimate
(count + 1) / (N + V + 1).  Over all V known tokens and the unknown one, p sums to 1.

Memory is bounded by ``block_tokens`` and ``bucket_words``, which grow with the square root of a large table up
to sixteenfold; the driver gets the seeds, their bigrams and the class bigrams.

What is defined for odd input: null or empty text is an end alone; rows with a null id are trained on
and scored with a null id; rows of one id are scored each; without training texts every count is 0;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop_cut, grown, long_id, spread, text_slices
from .substrings import in_buckets

BLOCKS = "block long, doc_ids array<long>, lengths array<int>, trained array<boolean>, codes binary, n_words long, words binary, counts binary"
SENT = "bucket int, block long, n long, words binary, counts binary, sizes binary, codes binary, times binary"
BACK = "block long, bucket int, n long, counts binary, classes binary"
CLASSED = "doc_ids array<long>, lengths array<int>, codes binary, counts binary, classes binary, keys array<long>, times array<long>"
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PA = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_()), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
END = b""  # no word is empty


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _PA[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(schema, list(zip(*rows)) if rows else [[]] * len(schema.split(", ")))])


def _zip(a: np.ndarray, kind: str) -> bytes:
    return zstandard.compress(a.astype(kind).tobytes(), 1)


def _unzip(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _words(data: bytes) -> list[bytes]:
    return zstandard.decompress(data).split(b"\n")


def marks_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def blocks(docs: DataFrame, train: Column, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """Tokenised blocks of about ``block_tokens`` tokens, numbered by task and order, words in the order of their hashes."""
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), F.coalesce(train, F.lit(True)).alias("trained"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        part, number, held = TaskContext.get().partitionId(), 0, 0
        code: dict = defaultdict()
        code.default_factory = code.__len__
        ids, trained, codes = [], [], []

        def close():
            flat, words = np.concatenate(codes), list(code)
            order = np.argsort(marks_of(words), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            flat, lengths = place[flat], [len(c) for c in codes]
            seen = np.bincount(flat[np.repeat(trained, lengths)], minlength=len(words))
            packed = zstandard.compress(b"\n".join(words[i] for i in order.tolist()), 1)
            return _batch(BLOCKS, [[part << 32 | number], [ids], [lengths], [trained], [_zip(flat, "<i4")], [len(words)], [packed], [_zip(seen, "<i8")]])

        for batch in batches:
            for piece, texts in text_slices(batch, "text", 1_000_000):
                ids += piece.column(0).to_pylist()
                trained += piece.column(1).to_pylist()
                for t in texts:
                    words = t.encode().lower().split()  # of bytes: ASCII letters and white space only
                    words.append(END)
                    codes.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                    held += len(words)
                if held >= block_tokens:
                    yield close()
                    code.clear()
                    ids, trained, codes, number, held = [], [], [], number + 1, 0
        if codes:
            yield close()

    return spread(rows).mapInArrow(run, BLOCKS)


def exchange(bigrams: np.ndarray, classes: int, fixed: int) -> np.ndarray:
    """The class of each word: words are moved one by one to the class of the greatest likelihood.

    ``bigrams[v, w]`` counts w after v.  The last ``fixed`` words are classes of their own and don't move.
    """
    n = len(bigrams)
    movable = n - fixed
    classes = min(classes, max(1, movable))
    of = np.concatenate([np.arange(movable) % classes, classes + np.arange(fixed)]).astype(np.int64)
    total = classes + fixed
    member = np.zeros((n, total))
    member[np.arange(n), of] = 1
    after, before = bigrams @ member, bigrams.T @ member  # of each word: what follows it, what precedes it, by class
    table = member.T @ after
    left, right = bigrams.sum(1).astype(float), bigrams.sum(0).astype(float)
    sum_left, sum_right = member.T @ left, member.T @ right
    log = lambda x: x * np.log(np.maximum(x, 1e-300))
    while True:  # a move makes the likelihood greater, so this ends
        moved = 0
        for w in np.flatnonzero(left[:movable] + right[:movable]):
            k = of[w]
            own = float(bigrams[w, w])
            out, into = after[w].copy(), before[w].copy()
            out[k] -= own
            into[k] -= own
            table[k] -= out
            table[:, k] -= into
            table[k, k] -= own
            sum_left[k] -= left[w]
            sum_right[k] -= right[w]
            c = classes
            gain = (log(table[:c] + out) - log(table[:c])).sum(1) + (log(table[:, :c].T + into) - log(table[:, :c].T)).sum(1)
            # The cell of a class with itself gets both sides and the word's bigrams with itself.
            d = np.arange(c)
            cell = table[d, d]
            gain += log(cell + out[:c] + into[:c] + own) - log(cell) - (log(cell + out[:c]) - log(cell)) - (log(cell + into[:c]) - log(cell))
            gain -= log(sum_left[:c] + left[w]) - log(sum_left[:c]) + log(sum_right[:c] + right[w]) - log(sum_right[:c])
            best = int(np.argmax(gain))
            if gain[best] <= gain[k] + 1e-9:
                best = int(k)
            table[best] += out
            table[:, best] += into
            table[best, best] += own
            sum_left[best] += left[w]
            sum_right[best] += right[w]
            if best != k:
                of[w] = best
                after[:, k] -= bigrams[:, w]
                after[:, best] += bigrams[:, w]
                before[:, k] -= bigrams[w]
                before[:, best] += bigrams[w]
                moved += 1
        if not moved:
            return of


@dataclass
class Model:
    unknown: int  # the class of words that weren't in training
    end: int
    transitions: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    weight: float

    @property
    def tokens(self) -> int:
        return int(self.class_tokens.sum())

    @property
    def types(self) -> int:
        return int(self.class_words.sum())

    def emission(self, of: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word and its share of that, from classes and counts in training."""
        of = np.where(counts > 0, of, self.unknown)
        open_share = (counts + 1) / (self.class_tokens[self.unknown] + self.class_words[self.unknown] + 1)
        return of, np.where(of == self.unknown, open_share, counts / np.maximum(self.class_tokens[of], 1))


def _send(tokens: DataFrame, buckets: int, contexts=None) -> DataFrame:
    """Each block's words, their counts and, if ``contexts`` gives them, their contexts, a row for each bucket that occurs."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _words(row["words"]), _unzip(row["counts"], "<i8")
                at, code, n = contexts(row, words) if contexts else (np.zeros(0, np.int64),) * 3
                size = np.bincount(at, minlength=len(words))
                ends = np.cumsum(size)
                for b, a, e in in_buckets(marks_of(words), buckets)[1]:
                    of = slice(ends[a] - size[a], ends[e - 1])
                    yield _batch(SENT, [[b], [row["block"]], [e - a], [zstandard.compress(b"\n".join(words[a:e]), 1)], [_zip(counts[a:e], "<i8")], [_zip(size[a:e], "<u2")], [_zip(code[of], "u1")], [_zip(n[of], "<u4")]])

    return tokens.select("block", "lengths", "trained", "codes", "words", "counts").mapInArrow(run, SENT)


def _gathered(sent: pa.Table) -> tuple[list[dict], list[bytes], np.ndarray, np.ndarray]:
    """A bucket's rows, its distinct words in order, the place of each word sent, and the words' counts."""
    rows = sorted(sent.to_pylist(), key=lambda r: r["block"])
    for r in rows:
        r["words"] = _words(r["words"])
    known = sorted(set().union(*(r["words"] for r in rows)))
    place = dict(zip(known, range(len(known))))
    at = np.fromiter((place[w] for r in rows for w in r["words"]), np.int64, sum(r["n"] for r in rows))
    counts = np.bincount(at, np.concatenate([_unzip(r["counts"], "<i8") for r in rows]), len(known)).astype(np.int64)
    return rows, known, at, counts


def seed_words(tokens: DataFrame, buckets: int, seeds: int) -> list[bytes]:
    """The most frequent words, the end aside."""

    def top(sent: pa.Table) -> pa.Table:
        _, known, _, counts = _gathered(sent)
        best = [(known[i].decode(), int(counts[i])) for i in np.argsort(-counts, kind="stable")[: seeds + 1].tolist() if counts[i] and known[i] != END]
        return _table("word string, c long", best[:seeds])

    found = _send(tokens, buckets).groupBy("bucket").applyInArrow(top, "word string, c long")
    return [r["word"].encode() for r in found.orderBy(F.desc("c"), "word").limit(seeds).collect()]  # bounded by seeds


def _symbols(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    rest = len(index) - 1
    return np.fromiter((index.get(w, rest) for w in words), np.int64, len(words))


def _flat(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's tokens, and which of them are in training."""
    return _unzip(row["codes"], "<i4"), np.repeat(np.array(row["trained"], bool), row["lengths"])


def seed_bigrams(tokens: DataFrame, index: dict[bytes, int]) -> np.ndarray:
    """Bigrams of seeds, other words (as one) and ends in training texts."""
    width = len(index) + 1  # the seeds, the others, the end: ``index`` has no entry for the others
    end = index[END]

    def pairs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes, keep = _flat(row)
                flat = _symbols(_words(row["words"]), index)[codes]
                before = np.concatenate([[end], flat[:-1]])  # a text begins after an end
                key, n = np.unique((before * width + flat)[keep], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    summed = tokens.select("words", "codes", "trained", "lengths").mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # bounded by width squared
    out = np.zeros(width * width, np.int64)
    out[summed["key"].to_numpy()] = summed["n"].to_numpy()
    return out.reshape(width, width)


def gains(table: np.ndarray, classes: int) -> np.ndarray:
    """Of a context (a class before: first half, after: second half) in a word, the gain of the word's being in each class."""
    k = len(table)
    after = np.log((table[:classes] + 1) / (table[:classes].sum(1, keepdims=True) + k))
    before = np.log((table[:, :classes] + 1) / (table[:, :classes].sum(0) + k))
    return np.concatenate([before, after.T])


def place_words(tokens: DataFrame, index: dict[bytes, int], of: np.ndarray, gain: np.ndarray, buckets: int) -> DataFrame:
    """A row of counts and classes for each block and bucket, the words in their order; and of each bucket, with block -1, its
    numbers of words and of tokens by class."""
    k, classes, end = len(gain) // 2, gain.shape[1], index[END]

    def contexts(row: dict, words: list[bytes]):
        symbol = _symbols(words, index)
        codes, keep = _flat(row)
        now = of[symbol][codes]
        keep &= symbol[codes] == len(index) - 1  # seeds and the end have their classes
        at = np.flatnonzero(keep)
        before = np.concatenate([[of[end]], now[:-1]])[at]
        after = now[np.minimum(at + 1, len(now) - 1)]  # an end follows every word
        word = codes[at].astype(np.int64)
        key, n = np.unique(np.concatenate([word * 2 * k + before, word * 2 * k + k + after]), return_counts=True)
        return key // (2 * k), key % (2 * k), n

    def assign(sent: pa.Table) -> pa.Table:
        rows, known, at, counts = _gathered(sent)
        home = np.repeat(at, np.concatenate([_unzip(r["sizes"], "<u2") for r in rows]))
        code, n = (np.concatenate([_unzip(r[c], kind) for r in rows]).astype(np.int64) for c, kind in (("codes", "u1"), ("times", "<u4")))
        symbol = _symbols(known, index)
        # The end's class comes after those of words.
        best = np.where(symbol == end, classes, of[symbol])
        order = np.argsort(home, kind="stable")
        home, code, n = home[order], code[order], n[order]
        for lo in range(0, len(known), 50_000):
            hi = min(lo + 50_000, len(known))
            a, e = np.searchsorted(home, (lo, hi))
            seen = np.bincount((home[a:e] - lo) * 2 * k + code[a:e], n[a:e], (hi - lo) * 2 * k).reshape(hi - lo, 2 * k)
            rest = symbol[lo:hi] == len(index) - 1
            best[lo:hi] = np.where(rest, np.argmax(seen @ gain, axis=1), best[lo:hi])
        number, out, first = rows[0]["bucket"], [], 0
        for r in rows:
            mine = at[first : first + r["n"]]
            first += r["n"]
            out.append((r["block"], number, r["n"], _zip(counts[mine], "<i8"), _zip(best[mine], "u1")))
        live = counts > 0
        sums = [np.bincount(best[live], w, classes + 1).astype(np.int64) for w in (None, counts[live])]
        out.append((-1, number, 0, _zip(sums[0], "<i8"), _zip(sums[1], "<i8")))
        return _table(BACK, out)

    return _send(tokens, buckets, contexts).groupBy("bucket").applyInArrow(assign, BACK)


def join_back(tokens: DataFrame, back: DataFrame, classes: int) -> DataFrame:
    """Blocks with their words' counts and classes, and their class bigrams in training texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        out = []
        for row in left.to_pylist():
            if sum(p["n"] for p in parts) != row["n_words"]:
                raise RuntimeError("a block's rows changed between two passes")
            counts, of = (np.concatenate([_unzip(p[c], kind) for p in parts]) for c, kind in (("counts", "<i8"), ("classes", "u1")))
            codes, keep = _flat(row)
            now = of[codes].astype(np.int64)
            before = np.concatenate([[classes], now[:-1]])
            key, n = np.unique((before * (classes + 1) + now)[keep], return_counts=True)
            out.append((row["doc_ids"], row["lengths"], row["codes"], _zip(counts, "<i8"), _zip(of, "u1"), key.tolist(), n.tolist()))
        return _table(CLASSED, out)

    left = tokens.select("block", "doc_ids", "lengths", "trained", "codes", "n_words")
    return left.groupBy("block").cogroup(back.where("block >= 0").groupBy("block")).applyInArrow(run, CLASSED)


def fit(tokens: DataFrame, buckets: int, seeds: int = 1_000, classes: int = 48, weight: float = 0.95) -> tuple[DataFrame, Model]:
    """Train on all blocks -> (blocks with counts and classes, model)."""
    top = seed_words(tokens, buckets, seeds)
    index = {w: i for i, w in enumerate(top)}
    index[END] = len(top) + 1  # the others, as one, come between
    bigrams = seed_bigrams(tokens, index)
    of = exchange(bigrams, classes, fixed=2)
    classes = max(1, min(classes, len(top)))
    member = np.zeros((len(of), int(of.max()) + 1))
    member[np.arange(len(of)), of] = 1
    gain = gains(member.T @ bigrams @ member, classes)

    back = cut(place_words(tokens, index, of, gain, buckets), "classes")
    # A row for each bucket, of a number for each class.
    sums = back.where("block = -1").select("counts", "classes").collect()
    class_words, class_tokens = (sum((_unzip(r[c], "<i8") for r in sums), np.zeros(classes + 1, np.int64)) for c in ("counts", "classes"))
    classed = cut(join_back(tokens, back, classes), "classed")
    drop_cut(back)
    table = np.zeros((classes + 1) ** 2, np.int64)
    for r in classed.select(F.explode(F.arrays_zip("keys", "times")).alias("x")).groupBy("x.keys").agg(F.sum("x.times").alias("n")).collect():  # bounded by classes squared
        table[r[0]] = r[1]
    return classed, make_model(table.reshape(classes + 1, classes + 1), class_words, class_tokens, weight)


def make_model(table: np.ndarray, class_words: np.ndarray, class_tokens: np.ndarray, weight: float) -> Model:
    k = len(table)
    unknown = int(np.argmax(class_words[:-1]))  # the end's class is the last
    unigram = (class_tokens + 1) / (class_tokens.sum() + k)
    transitions = (table + 10 * unigram) / (table.sum(1, keepdims=True) + 10)
    # An empty class emits nothing, so it may not take a share of the transitions.
    live = class_tokens > 0
    live[unknown] = True
    transitions = np.where(live, transitions, 0)
    transitions /= transitions.sum(1, keepdims=True)
    return Model(unknown, k - 1, transitions, class_tokens, class_words, weight)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1_500_000, bucket_words: int = 500_000, **options) -> DataFrame:
    """Train where ``train`` holds and score all: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    bound_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    block_tokens, bucket_words = grown(total, block_tokens, bucket_words)
    tokens = cut(blocks(docs, train, id_col, text_col, block_tokens), "blocks")
    words = tokens.agg(F.sum("n_words")).first()[0] or 0
    classed, model = fit(tokens, max(1, -(-words // bucket_words)), **options)
    drop_cut(tokens)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = _unzip(row["counts"], "<i8")
                of, emission = model.emission(_unzip(row["classes"], "u1").astype(np.int64), count)
                base = (count + 1) / (model.tokens + model.types + 1)
                flat = _unzip(row["codes"], "<i4")
                now = of[flat]
                before = np.concatenate([[model.end], now[:-1]])
                p = model.weight * model.transitions[before, now] * emission[flat] + (1 - model.weight) * base[flat]
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                known = np.add.reduceat((count[flat] > 0).astype(np.int64), starts)
                sums = [np.add.reduceat(np.log10(x), starts) for x in (base[flat], p)]
                yield _batch(SCORES, [row["doc_ids"], row["lengths"], known, [model.tokens] * len(starts), *sums])

    return classed.select("doc_ids", "lengths", "codes", "counts", "classes").mapInArrow(run, SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: all ``documents`` scored, learned from those whose id's remainder is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    out = score_texts(docs, remainder != 2)
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
