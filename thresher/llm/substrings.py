"""Removal of repeated substrings by a blockwise suffix sort over a difference cover.

Two places of a text that share ``length`` bytes are found without sorting every suffix.  Residues
modulo v = q*q+q+1 that form a perfect difference set hit any two positions together at one shift
below v, so of two equal strings of ``length`` bytes some two *cover suffixes* (12 of 133 positions)
share their first ``length - v + 1`` bytes.  The steps:

1. cover suffixes are dealt to buckets by their first bytes' fingerprint and each bucket is sorted
   on its own; equal neighbours share a rank, and each block of documents learns which of its
   cover suffixes have a rank in common with others (one bit each, in sorted order);
2. only positions up to v-1 bytes before such a suffix can start a repeated string.  Their
   whole strings are told apart by 96-bit fingerprints, again one bucket sorted at a time;
3. bytes under any repeated string are cut.

Memory is bounded by ``block_bytes`` of text and ``bucket_rows`` fingerprints (or one document, if
longer); no suffix carries its text through an exchange, and ties of any length, such as copies of
whole documents, cost a fixed number of bytes.  Whole texts that occur again are represented by one
of them.  Both bounds grow with the square root of the table up to sixteenfold, and a block sends rows only
to buckets that it has fingerprints for, so the rows sent are at most as many as the fingerprints.

What is defined for odd input: null counts as empty; each row is a document, so a row that occurs
twice is a repeat; a document's text that occurs again is removed whole if it has ``length`` bytes
or more; an empty table gives an empty table.  Columns other than id and text aren't returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, grown, long_id, ragged, row_key, squeezed, text_of, unsqueezed

_M = np.uint64(0xBF58476D1CE4E5B9)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


# Perfect difference sets modulo q*q+q+1, every residue the difference of one pair.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    133: (1, 11, 16, 40, 41, 43, 52, 60, 74, 78, 121, 128),
}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves cover suffixes a third of the string in common at least."""
    v = max(v for v in COVERS if 3 * v <= 2 * length + 1)
    return v, COVERS[v]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M
    return x ^ (x >> np.uint64(29))


class Prints:
    """Fingerprints of any substrings of a buffer by prefix sums of base powers, modulo 2**64."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data) + 1
        inverse = pow(base, -1, 1 << 64)
        powers, self.inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (base, inverse))
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=self.prefix[1:])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.prefix[at + length] - self.prefix[at]) * self.inverse[at])


def prints_at(data: np.ndarray, at: np.ndarray, length: int, base: int, step: int = 4 << 20) -> np.ndarray:
    """Fingerprints of the strings at ascending positions, the tables kept for ``step`` bytes at a time."""
    out, lo = np.empty(len(at), np.uint64), 0
    while lo < len(at):
        first = int(at[lo])
        hi = int(np.searchsorted(at, first + step))
        out[lo:hi] = Prints(data[first : int(at[hi - 1]) + length], base).of(at[lo:hi] - first, length)
        lo = hi
    return out


class Block:
    """Documents of one block: unique texts that represent themselves, joined in a buffer."""

    def __init__(self, docs: pa.Table, notes: pa.Table, length: int):
        self.length = length
        rows = sorted(zip(docs["doc_id"].to_pylist(), docs["key"].to_pylist(), unsqueezed(docs["text"])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        notes = notes.to_pydict()
        flags = {(i, k): n for kind, i, k, n in zip(notes["kind"], notes["doc_id"], notes["key"], notes["n"]) if kind == 0}
        self.bits = {kind: {b: (n, d) for x, b, n, d in zip(notes["kind"], notes["bucket"], notes["n"], notes["data"]) if x == kind} for kind in (1, 2)}
        self.rows = rows
        self.copied = [(i, k) in flags for i, k, _ in self.rows]
        seen: set = set()
        self.own = []  # rows in the buffer
        for r, (i, k, t) in enumerate(self.rows):
            if flags.get((i, k), 1) and (i, k) not in seen and len(t) >= length:
                seen.add((i, k))
                self.own.append(r)
        size = np.array([len(self.rows[r][2]) for r in self.own], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.data = np.frombuffer(b"".join(self.rows[r][2] for r in self.own), np.uint8)

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of cover suffixes, and their first bytes' fingerprints."""
        v, residues = cover_for(self.length)
        common = self.length - v + 1
        last = self.end - common - self.start  # the last start of a prefix, from the text's start
        at = [np.zeros(0, np.int64)]
        for r in residues:
            count = np.maximum(0, (last - r) // v + 1)
            first = np.repeat(self.start + r, count)
            at.append(first + v * ragged(np.zeros(len(count), np.int64), count))
        at = np.sort(np.concatenate(at))
        return at, prints_at(self.data, at, common, BASES[0])

    def candidates(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of strings that may be repeated, their fingerprints and 32 bits more of them."""
        v, _ = cover_for(self.length)
        at, marks = self.cover()
        shared = at[flagged(marks, buckets, self.bits[1])]
        edge = np.zeros(len(self.data) + 1, np.int32)
        home = np.searchsorted(self.end, shared, side="right")
        np.add.at(edge, np.maximum(shared - v + 1, self.start[home]), 1)
        np.add.at(edge, shared + 1, -1)
        may = np.cumsum(edge[:-1]) > 0
        for_text = np.repeat(self.end, self.end - self.start)
        at = np.flatnonzero(may & (np.arange(len(self.data)) + self.length <= for_text))
        more = (prints_at(self.data, at, self.length, BASES[1]) >> np.uint64(32)).astype(np.uint32)
        return at, prints_at(self.data, at, self.length, BASES[0]), more

    def spans(self, cover_buckets: int, buckets: int) -> list[list[tuple[int, int]]]:
        """Of each row: its repeated bytes as maximal runs."""
        at, marks, more = self.candidates(cover_buckets)
        repeated = at[flagged(marks, buckets, self.bits[2], more)]
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, repeated, 1)
        np.add.at(edge, repeated + self.length, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out: list = [[(0, len(t))] if c and len(t) >= self.length else [] for (_, _, t), c in zip(self.rows, self.copied)]
        for r, a, b in zip(self.own, self.start.tolist(), self.end.tolist()):
            if not out[r]:
                step = np.diff(np.concatenate([[0], covered[a:b].astype(np.int8), [0]]))
                out[r] = list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))
        return out


def in_buckets(marks: np.ndarray, buckets: int, more: np.ndarray | None = None):
    """Sorted order of the fingerprints, and (bucket, first, end) in it of each bucket that occurs."""
    order = np.argsort(marks, kind="stable") if more is None else np.lexsort((more, marks))
    of = ((marks[order] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    return order, list(zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(of)).tolist()))


def flagged(marks: np.ndarray, buckets: int, bits: dict[int, tuple[int, bytes]], more: np.ndarray | None = None) -> np.ndarray:
    """Which fingerprints their buckets found shared."""
    order, cuts = in_buckets(marks, buckets, more)
    out = np.zeros(len(marks), bool)
    for b, a, e in cuts:
        if b in bits:
            n, data = bits[b]
            if e - a != n:
                raise RuntimeError("a block's rows changed between two passes")
            out[order[a:e]] = np.unpackbits(np.frombuffer(zstandard.decompress(data), np.uint8), count=n).astype(bool)
    return out


def pack(marks: np.ndarray, more: np.ndarray | None) -> bytes:
    """Sorted fingerprints as byte planes of their differences, compressed."""
    gaps = np.diff(marks, prepend=np.uint64(0)).astype("<u8")
    planes = gaps.view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.compress(planes + (b"" if more is None else more.astype(more.dtype.newbyteorder("<")).tobytes()), 1)


def unpack(data: bytes, n: int, wide: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and what was packed with them, numbers of the type ``wide`` (None: zeros)."""
    raw = zstandard.decompress(data)
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, wide, n, 8 * n) if wide else np.zeros(n, np.uint16)


SENT = "bucket int, block int, n long, data binary"
NOTES = "block int, kind int, doc_id long, key long, bucket int, n long, data binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(list(c), kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _sort_bucket(kind: int):
    def run(sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        parts = [unpack(r["data"], r["n"], "<u4" if kind == 2 else None) for r in rows]
        marks, more = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((more, marks)) if kind == 2 else np.argsort(marks, kind="stable")
        same = (marks[order][1:] == marks[order][:-1]) & (more[order][1:] == more[order][:-1])
        shared = np.zeros(len(marks), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        out, at = [], 0
        for r in rows:
            bits = shared[at : at + r["n"]]
            at += r["n"]
            if bits.any():
                out.append((r["block"], kind, None, None, r["bucket"], r["n"], zstandard.compress(np.packbits(bits).tobytes(), 1)))
        return _table(NOTES, out)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, bucket_rows: int = 1_000_000) -> DataFrame:
    """Of each document: doc_id, n_bytes (long), spans (removed runs of bytes, array<struct<a, b>>), kept (binary)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    digest = rows.select("doc_id", "key", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    total = digest.agg(F.sum("bytes")).first()[0] or 0
    block_bytes, bucket_rows = grown(total, block_bytes, bucket_rows)
    blocks = max(1, -(-total // block_bytes))
    v, residues = cover_for(length)
    cover_buckets = max(1, -(-total * len(residues) // (v * bucket_rows)))
    string_buckets = max(1, -(-total // (4 * bucket_rows)))
    block = F.pmod(F.col("key"), F.lit(blocks)).cast("int").alias("block")
    texts = squeezed(rows.select(block, "doc_id", "key", "text")).groupBy("block")

    groups = digest.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNotNull().alias("x"), "doc_id", "key")).alias("first")).where("copies > 1")
    copies = digest.join(groups, ["t1", "t2"])
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    own_id, own_key = F.col("doc_id").alias("doc_id"), F.col("key").alias("key")  # columns of their own, apart from those of the texts
    flags = copies.select(block, F.lit(0).alias("kind"), own_id, own_key, F.lit(None).cast("int").alias("bucket"), is_first.cast("long").alias("n"), F.lit(None).cast("binary").alias("data")).distinct()

    def send(kind: int, buckets: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table(SENT, [])
            own, more = Block(left, right, length), None
            if kind == 1:
                _, marks = own.cover()
            else:
                _, marks, more = own.candidates(cover_buckets)
            order, cuts = in_buckets(marks, buckets, more)
            marks, more, number = marks[order], None if more is None else more[order], left["block"][0].as_py()
            return _table(SENT, [(b, number, e - a, pack(marks[a:e], None if more is None else more[a:e])) for b, a, e in cuts])

        return run

    notes = flags
    for kind, buckets in ((1, cover_buckets), (2, string_buckets)):
        sent = texts.cogroup(notes.groupBy("block")).applyInArrow(send(kind, buckets), SENT)
        notes = notes.union(sent.groupBy("bucket").applyInArrow(_sort_bucket(kind), NOTES))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            left_rows: list = []
            return pa.table({"doc_id": pa.array(left_rows, pa.int64()), "n_bytes": pa.array(left_rows, pa.int64()), "spans": pa.array(left_rows, spans_type), "kept": pa.array(left_rows, pa.binary())})
        own = Block(left, right, length)
        spans = own.spans(cover_buckets, string_buckets)
        kept = []
        for (_, _, t), runs in zip(own.rows, spans):
            ends = [0, *(b for _, b in runs)]
            kept.append(b"".join(t[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(t)])))
        return pa.table({
            "doc_id": pa.array([r[0] for r in own.rows], pa.int64()),
            "n_bytes": pa.array([len(r[2]) for r in own.rows], pa.int64()),
            "spans": pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], spans_type),
            "kept": pa.array(kept, pa.binary()),
        })

    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    return texts.cogroup(notes.groupBy("block")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: strings of 200 bytes that repeat anywhere in ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), s AS (
  SELECT doc_id, i, md5(array_slice(t, i + 1, i + 200)) AS x
  FROM (SELECT doc_id, t, unnest(range(greatest(0, octet_length(t) - 199))) AS i FROM d)
), c AS (
  SELECT doc_id, i FROM s WHERE x IN (SELECT x FROM s GROUP BY x HAVING count(*) > 1)
), g AS (
  SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 201) > 200 AS new FROM c
), k AS (
  SELECT doc_id, i, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g
), r AS (
  SELECT doc_id, k, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, k
), l AS (
  SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM r GROUP BY doc_id
), o AS (
  SELECT d.doc_id, octet_length(t) AS n, CASE WHEN a IS NULL THEN [] ELSE a END AS a, CASE WHEN b IS NULL THEN [] ELSE b END AS b, hex(t) AS h
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(list_sum(b) - list_sum(a), 0)::BIGINT AS n_removed, len(a) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(len(a) + 1), lambda j:
         substr(h, 2 * coalesce(b[j], 0) + 1, 2 * (coalesce(a[j + 1], n) - coalesce(b[j], 0)))), ''))) AS kept_sha256
FROM o
"""
