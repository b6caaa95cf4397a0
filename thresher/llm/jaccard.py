r"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct shingles of ``n`` words (``[^\x20\x09-\x0D]+`` with A-Z lower-cased), as
64-bit fingerprints; with fewer words, its words are one shingle.  Two documents link when
100 * intersection >= percent * union.  The steps:

1. shingles are counted exactly over the corpus: each block of documents sends packed, sorted
   fingerprints to buckets and gets back how common each is.  The most rare come first in
   a set's order, so its prefix (size - ceil(percent * size) + 1 shingles) avoids common passages;
2. documents whose prefix has a shingle that another document has too are candidates, and
   keep their set; the rest link with nothing.  Equal sets are one class, represented by one set;
3. classes of identical prefix and size are one group.  Groups meet in a bucket for each prefix
   shingle and length class (linked sets' sizes are within percent of one another); buckets with the
   same groups are one;
4. in each group and bucket all are verified against a leader.  Where that leaves a bucket
   in one component it is done; else its groups are expanded, and all pairs of members that are
   not in one component are verified by products of shingle matrices, in chunks of bounded size.

Only links that join components are kept, so a group of m copies costs about m links.  The
result is exact: every pair of different texts that links ends in the same component.

5. each document's links are counted within its component, by products of shingle matrices in pairs of
   chunks of bounded size; no pair is written.

What is defined for odd input: null or empty text and text of white space alone have an empty
set and link with nothing; rows of one id are one node; a row with a null id takes part in no
link and has a null component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, components, cut, drop_cut, grown, lean, long_id, maybe_broadcast, row_key, squeezed, text_of, unsqueezed
from .substrings import BASES, Prints, _table, in_buckets, pack, unpack

SENT = "bucket int, block int, n long, data binary"
BACK = "block int, bucket int, n long, data binary"
SETS = "doc_id long, size long, s1 long, s2 long, tokens binary, prefix array<long>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes], n: int, step: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of each text's shingles, one text after the other, and their numbers."""
    lengths, done = np.cumsum([len(t) for t in texts]), []
    for piece in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(lengths // step)) + 1):  # tables are kept for about ``step`` bytes
        done.append(_shingle_sets([texts[i] for i in piece], n))
    return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.lower() for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    length = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1 - start
    prints = Prints(data, BASES[0])
    word = (prints.prefix[start + length] - prints.prefix[start]) * prints.inverse[start] + length.astype(np.uint64) * _MIX[5]
    word = (word ^ (word >> np.uint64(31))) * _MIX[0]
    word ^= word >> np.uint64(29)
    doc = np.searchsorted(ends, start, side="right")
    count = np.bincount(doc, minlength=len(raw))
    first = np.cumsum(count) - count
    spans = [(np.flatnonzero(np.arange(len(word)) + n <= (first + count)[doc]), n)] if len(word) else []
    spans += [(first[count == k], k) for k in range(1, n) if (count == k).any()]  # a short text is one shingle
    marks, homes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, k in spans:
        h = np.full(len(at), k, np.uint64)
        for d in range(k):
            h = (h ^ word[at + d]) * _MIX[1 + d % 4]
            h ^= h >> np.uint64(32)
        marks.append(h)
        homes.append(doc[at])
    mark, home = np.concatenate(marks), np.concatenate(homes)
    order = np.lexsort((mark, home))
    mark, home = mark[order], home[order]
    keep = np.ones(len(mark), bool)
    keep[1:] = (mark[1:] != mark[:-1]) | (home[1:] != home[:-1])
    return mark[keep], np.bincount(home[keep], minlength=len(raw))


def _block(left: pa.Table, n: int, bits: int):
    """A block's rows in a fixed order, their sets, and the shortened fingerprints that are counted."""
    rows = sorted(zip(left["doc_id"].to_pylist(), left["key"].to_pylist(), unsqueezed(left["text"])), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    marks, sizes = shingle_sets([r[2] for r in rows], n)
    short = marks & ~np.uint64((1 << (64 - bits)) - 1)
    known, inverse, count = np.unique(short, return_inverse=True, return_counts=True)
    return rows, marks, sizes, known, inverse, count


def _count_bucket(sent: pa.Table) -> pa.Table:
    rows = sent.to_pylist()
    parts = [unpack(r["data"], r["n"], "<u2") for r in rows]
    known, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([p[1] for p in parts]).astype(np.float64))
    rank = (1 + np.floor(np.log2(total))).astype(np.uint8)[inverse]  # 1: a single document, 2: two or three, ...
    ends = np.cumsum([r["n"] for r in rows])
    return _table(BACK, [(r["block"], r["bucket"], r["n"], zstandard.compress(rank[e - r["n"] : e].tobytes(), 1)) for r, e in zip(rows, ends)])


def candidate_sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, block_bytes: int, bucket_rows: int) -> DataFrame:
    """A row for each document; tokens and prefix (shared shingles of it) are null where it links with nothing."""
    bound_batches(docs.sparkSession)
    rows = docs.select(long_id(docs, id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), text_of(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block_bytes, bucket_rows = grown(total, block_bytes, bucket_rows)
    blocks, buckets = max(1, -(-total // block_bytes)), max(1, -(-total // (7 * bucket_rows)))
    # Shortened fingerprints only order shingles: two that fall together are both taken for less rare.
    bits = min(63, 18 + max(1, total).bit_length())
    texts = squeezed(rows.select(F.pmod(F.col("key"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "key", "text")).groupBy("block")

    def send(left: pa.Table) -> pa.Table:
        _, _, _, known, _, count = _block(left, n, bits)
        _, cuts = in_buckets(known, buckets)
        number, more = left["block"][0].as_py(), np.minimum(count, 65535).astype(np.uint16)
        return _table(SENT, [(b, number, e - a, pack(known[a:e], more[a:e])) for b, a, e in cuts])

    back = texts.applyInArrow(lean(send), SENT).groupBy("bucket").applyInArrow(lean(_count_bucket), BACK)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            rows, marks, sizes, known, inverse, _ = _block(left, n, bits)
            places = {b: (a, e) for b, a, e in in_buckets(known, buckets)[1]}
            rank = np.zeros(len(known), np.uint8)
            for b, size, data in zip(*(right[c].to_pylist() for c in ("bucket", "n", "data"))):
                a, e = places.get(b, (0, 0))
                if e - a != size:
                    raise RuntimeError("a block's rows changed between two passes")
                rank[a:e] = np.frombuffer(zstandard.decompress(data), np.uint8)
            ranks = rank[inverse]
            home = np.repeat(np.arange(len(rows)), sizes)
            order = np.lexsort((marks, ranks, home))
            ends = np.cumsum(sizes)
            for (doc_id, _, _), size, end in zip(rows, sizes.tolist(), ends.tolist()):
                prefix = order[end - size : end - size + size - -(-percent * size // 100) + 1] if size else order[:0]
                shared = prefix[ranks[prefix] > 1]
                if doc_id is None or not len(shared):
                    out.append((doc_id, size, None, None, None, None))
                    continue
                own = marks[end - size : end]
                s1 = int((own * _MIX[0]).sum(dtype=np.uint64).astype(np.int64))
                s2 = int(np.bitwise_xor.reduce((own ^ (own >> np.uint64(31))) * _MIX[2]).astype(np.int64))
                out.append((doc_id, size, s1, s2, own.tobytes(), marks[shared].astype(np.int64).tolist()))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in SETS.split(", ")])

    return texts.cogroup(back.groupBy("block")).applyInArrow(lean(finish), SETS)


def length_bounds(largest: int, percent: int) -> list[int]:
    """The least size of each length class: sets that link are in one class or in two that follow each other.

    A set of a size below bound k + 1 links with none of bound k + 2 or more: 100 * (bound k + 1) < percent * (bound k + 2).
    """
    out = [1]
    while out[-1] <= largest:
        out.append(100 * out[-1] // percent + 1)
    return out


def _linked(inter, a, b, percent: int):
    return 100 * inter >= percent * (a + b - inter)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b), b the first of its group, that link."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("tokens").alias("ta")), sets.where("rep = gid").select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))

    def run(batches):
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            kept = []
            for i, (x, y) in enumerate(zip(ta, tb)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if _linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in kept], pa.int64()) for v in (a, b)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


class Chunk:
    """Shingle sets of some members, and which pairs of them link, by products of slabs of their matrix."""

    def __init__(self, tokens: list[bytes], percent: int, slab: int = 512):
        sets = [np.frombuffer(t, np.uint64) for t in tokens]
        self.size, self.percent = np.array([len(s) for s in sets], np.int64), percent
        known, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1  # a shingle of one member adds to no intersection
        self.width = int(column[-1]) + 1
        keep = count[inverse] > 1
        self.at, self.to = np.repeat(np.arange(len(sets)), self.size)[keep], column[inverse[keep]]
        self.rows = max(1, min(slab, 8_000_000 // max(1, self.width)))

    def _matrix(self, a: int, b: int) -> np.ndarray:
        m = np.zeros((b - a, self.width), np.float32)
        lo, hi = np.searchsorted(self.at, (a, b))
        m[self.at[lo:hi] - a, self.to[lo:hi]] = 1
        return m

    def linked(self):
        """(first row, first column, matrix of links) of all pairs of slabs with row <= column."""
        n = len(self.size)
        for a in range(0, n, self.rows):
            left = self._matrix(a, min(a + self.rows, n))
            for b in range(a, n, self.rows):
                right = left if b == a else self._matrix(b, min(b + self.rows, n))
                inter = (left @ right.T).astype(np.int64)
                yield a, b, _linked(inter, self.size[a : a + len(left), None], self.size[None, b : b + len(right)], self.percent)


def _members_links(percent: int):
    """Links between members of one bucket, as many as join its components."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted({(r["rep"], r["component"]): r["tokens"] for r in table.select(["rep", "component", "tokens"]).to_pylist()}.items())
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        links, group = [], [c for (_, c), _ in rows]
        for a, b, hits in Chunk([t for _, t in rows], percent).linked():
            for x, y in np.argwhere(hits).tolist():
                x, y = x + a, y + b
                if x < y and (p := find(group[x])) != (q := find(group[y])):
                    root[p] = q
                    links.append((rows[x][0][0], rows[y][0][0]))
        return _table("a long, b long", links)

    return run


def _chunk_pairs(rows: DataFrame, keys: list[str], chunks: Column) -> DataFrame:
    """``rows`` dealt out to all pairs of their group's ``chunks``: lo, hi and side added."""
    rows = rows.withColumn("n", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"), "rep", *[c for c in ("component", "weight") if c in rows.columns and c not in keys])


def _link_counts(members: DataFrame, sets: DataFrame, percent: int, chunk_shingles: int) -> DataFrame:
    """Of members (rep, size, component, weight) of components of several: (rep, links), the weights of those that each links with."""
    # Chunks are bounded by their shingles, so that few components are dealt out more than once.
    size = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("size").alias("shingles")).where("members > 1")
    pairs = _chunk_pairs(members.join(size, "component"), ["component"], F.ceil(F.col("shingles") / chunk_shingles))
    # Few members are sent to the sets, which then aren't exchanged by id first.
    shipped = maybe_broadcast(pairs, 48).join(sets.select("rep", "tokens"), "rep")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending")])
        side, weight = table["side"].to_numpy(), table["weight"].to_numpy()
        one = table["lo"][0] == table["hi"][0]
        links = np.zeros(table.num_rows, np.int64)
        for a, b, hits in Chunk(table["tokens"].to_pylist(), percent).linked():
            x, y = slice(a, a + hits.shape[0]), slice(b, b + hits.shape[1])
            if not one:  # pairs within a chunk are counted where it meets itself
                hits = hits & (side[x, None] != side[None, y])
            elif a == b:
                hits = hits & ~np.eye(len(hits), dtype=bool)
            links[x] += hits @ weight[y]
            if a != b:
                links[y] += hits.T @ weight[x]
        return pa.table({"rep": table["rep"], "links": pa.array(links)})

    return shipped.groupBy("component", "lo", "hi").applyInArrow(lean(run), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20, bucket_rows: int = 1_000_000, chunk: int = 1_500, chunk_shingles: int = 2_500_000, count_links: bool = True) -> DataFrame:
    """Of each document: doc_id, n_shingles (long), component_id (long, the smallest id reachable by links), n_links (long).

    Documents are counted by rows: n_links is the number of other rows with an id that link directly
    (null where ``count_links`` is off, which spares the products).
    """
    all_sets = cut(candidate_sets(docs, n, percent, id_col, text_col, block_bytes, bucket_rows), "sets")
    found = all_sets.where("prefix IS NOT NULL")
    same = ["size", "s1", "s2"]
    # Classes, groups and buckets are found without the shingles; only sets that are compared are exchanged, by id and once.
    classes = cut(found.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("prefix").alias("prefix")), "classes")
    groups = cut(classes.groupBy("size", "prefix").agg(F.min("rep").alias("gid")), "groups")
    homes = cut(classes.join(groups, ["size", "prefix"]).drop("prefix"), "homes")

    if percent == 100:
        class_of = F.col("size").cast("int")
    else:
        bounds = length_bounds(classes.agg(F.max("size")).first()[0] or 0, percent)
        class_of = F.size(F.filter(F.lit(bounds).cast("array<long>"), lambda b: b <= F.col("size")))
    leaders = groups.select("gid", "size", F.explode(F.array_distinct("prefix")).alias("token"))
    placed = leaders.select("token", "gid", F.explode(F.array(class_of, class_of + 1)).alias("length"))
    mark = F.xxhash64("gid")
    buckets = placed.groupBy("token", "length").agg(F.count("*").alias("groups"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "gid")).alias("y"), F.min(F.struct(mark.alias("h"), F.col("gid").alias("leader"))).alias("first")).where("groups > 1")
    buckets = buckets.groupBy("groups", "x", "y", "first.leader").agg(F.min(F.struct("token", "length")).alias("key")).select("key.token", "key.length", "groups", "leader")
    met = cut(placed.join(buckets, ["token", "length"]), "buckets")

    stars = met.where("gid <> leader").select(F.col("gid").alias("a"), F.col("leader").alias("b")).union(homes.where("rep <> gid").select(F.col("rep").alias("a"), F.col("gid").alias("b")))
    stars = cut(stars.distinct(), "stars")
    # All that is compared below is in a star: a bucket's groups and a group's members have one with their leader.
    compared = stars.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    wanted = homes.join(compared, "rep", "left_semi").select(F.col("rep").alias("doc_id"), *same, "gid")
    keys = ["doc_id", *same]
    sets = cut(found.join(wanted, keys).groupBy(*keys).agg(F.first("gid").alias("gid"), F.first("tokens").alias("tokens")).withColumnRenamed("doc_id", "rep"), "reps")
    links = cut(_verify(stars, sets, percent), "links")
    joined = components(links)
    node = lambda df, col: df.join(joined.withColumnRenamed("node", col), col, "left").withColumn("component", F.coalesce("component", F.col(col)))

    # What is left: groups, and buckets, with more than one component.
    members = cut(node(homes.select("rep", "gid"), "rep"), "members")
    span = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    keyed = met.join(span, "gid")
    open_buckets = keyed.groupBy("token", "length").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("members").alias("members")).where("lo <> hi").select("token", "length", "members")
    open_groups = span.where("lo <> hi AND members > 1").select("gid", F.col("gid").alias("token"), F.lit(-1).alias("length"), "members")
    rows = met.select("token", "length", "gid").join(open_buckets, ["token", "length"]).select("gid", "token", "length", "members").union(open_groups)
    # A bucket of more than ``chunk`` members is taken in pairs of chunks, so a task's memory is bounded.
    rows = _chunk_pairs(rows.join(members, "gid"), ["token", "length"], F.ceil(F.col("members") / chunk))
    rows = cut(rows, "pairs")
    shipped = maybe_broadcast(rows, 60).join(sets.select("rep", "tokens"), "rep")
    more = shipped.groupBy("token", "length", "lo", "hi").applyInArrow(lean(_members_links(percent)), "a long, b long")
    more = cut(more, "links")
    joined = components(links.union(more))

    placed_homes = cut(node(homes.select("rep", "weight", *same), "rep"), "homes")
    counts = _link_counts(placed_homes.select("rep", "size", "component", "weight"), sets, percent, chunk_shingles) if count_links else None
    homes_links = cut((placed_homes.withColumn("links", F.lit(None).cast("long")) if counts is None else placed_homes.join(counts, "rep", "left")).select(*same, "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "links")
    out = all_sets.select("doc_id", *same).join(maybe_broadcast(homes_links, 48), same, "left")
    out = out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.when(F.col("doc_id").isNotNull() & F.lit(count_links), F.coalesce("n_links", F.lit(0))).alias("n_links"))
    result = cut(out, "components")
    for table in (all_sets, classes, groups, homes, met, stars, sets, links, members, rows, more, placed_homes, homes_links):
        drop_cut(table)
    return result


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all ``documents``, 3-word shingles, 90 per cent."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2])) END) AS x
  FROM w WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), p AS (
  SELECT i.a, i.b FROM i JOIN n AS na ON i.a = na.doc_id JOIN n AS nb ON i.b = nb.doc_id WHERE 100 * i.m >= 90 * (na.n + nb.n - i.m)
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, least(documents.doc_id, coalesce(m, documents.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) AS k ON documents.doc_id = k.a
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) AS c ON documents.doc_id = c.a
"""
