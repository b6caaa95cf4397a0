r"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of ``window`` words (a shorter item is one window).  A window is the
set of its shingles of up to three words; it occurs in a document only if all of its shingles
stand there at the right places, so its rarest shingle is a prefix that must be found.  The steps:

1. document shingles that occur in any item are kept with their positions (one pass over the texts,
   which splits each text once);
2. their counts order shingles by rarity; a window's prefix is its rarest shingle, and a window with
   a shingle that no document has is dropped;
3. prefixes are joined with the documents' shingles; bounds on the window's place and the document's
   length leave candidate alignments of a document and an item;
4. only for those, the item's shingles are looked up at the places where they would have to stand, and a
   run of as many consecutive ones as a window has is an exact occurrence of that window.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` with A-Z lower-cased.  They are compared by an image that
two words share only if they are equal: UTF-8 bytes read as Latin-1 and lower-cased.  Images are compared by
64-bit hashes, and shingles by 96 bits of those; a false hit needs every shingle of a window to collide.

What is defined for odd input: null or empty text has no words, no hits and isn't contaminated; an
item without words has no windows; items of one id count as one, and a null item id is "";
each document row is judged by its own id and text; an empty benchmark hits nothing; other columns
pass through, and the operator raises if one is named like a column that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, maybe_broadcast, row_key, spread, text_of

ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")
SHINGLE = 3


def words(text: Column) -> Column:
    image = F.lower(F.decode(text.cast("binary"), "ISO-8859-1"))
    return F.array_remove(F.split(image, "[\\x00-/:-`{-\\x7F]+", -1), "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _shingles(w: Column, k: int) -> Column:
    """Of each position that starts a shingle of k words: the position and the shingle's hash."""
    n = F.size(w) - k + 1
    mark = lambda i: F.xxhash64(F.lit(k), *[F.get(w, i + d) for d in range(k)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("p"), mark(i).alias("h1")))).otherwise(F.array())


def _second(w: str, k: str, at: str) -> Column:
    """More bits of the shingle of k words at a position."""
    return F.hash(F.slice(F.col(w), F.col(at) + 1, F.col(k)))


def _items(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each item's shingle: iid, item, len (words in a window), k, per (shingles in a window), q, h1, h2."""
    item = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, F.xxhash64(item, text_col).alias("iid"), word_hashes(text_of(text_col)).alias("w")).distinct()
    rows = rows.withColumn("len", F.least(F.size("w"), F.lit(window))).where("len > 0").withColumn("k", F.least("len", F.lit(SHINGLE)))
    by_k = [rows.where(F.col("k") == k).select("iid", "item", "len", "k", (F.col("len") - k + 1).alias("per"), "w", F.explode(_shingles(F.col("w"), k)).alias("s")) for k in range(1, SHINGLE + 1)]
    return by_k[0].union(by_k[1]).union(by_k[2]).select("iid", "item", "len", "k", "per", F.col("s.p").alias("q"), F.col("s.h1").alias("h1"), _second("w", "k", "s.p").alias("h2"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (sorted array<string>) and contaminated (a twentieth of its words hit)."""
    if clash := [c for c in docs.columns if c in ADDED or c.startswith("__")]:
        raise ValueError(f"columns named like added ones: {clash}")
    hash_cols, doc = ["h1", "h2"], ["__id", "__key"]
    items = cut(_items(benchmark, window, item_id, item_text), "items")
    lookup = maybe_broadcast(items.select("h1", "k").distinct(), 16)
    sizes = [r[0] for r in items.select("k").distinct().collect()]  # 3 at most

    keyed = spread(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    keyed = keyed.select("__id", row_key("__id", "__text").alias("__key"), word_hashes(text_of("__text")).alias("w"))
    marks = F.concat(*[_shingles(F.col("w"), k) for k in sizes]) if sizes else F.array().cast("array<struct<p:int,h1:bigint>>")
    found = keyed.select(*doc, F.size("w").alias("n"), "w", F.explode(marks).alias("s")).select(*doc, "n", "w", "s.p", "s.h1")
    found = found.join(lookup, "h1").select(*doc, "n", "p", "h1", _second("w", "k", "p").alias("h2"))
    found = cut(found.distinct(), "shingles")

    rarity = found.groupBy(*hash_cols).agg(F.count("*").alias("count"))
    ranked = items.join(rarity, hash_cols, "left").fillna(0, ["count"])
    # An item's own shingles: bounded by its text.
    listed = ranked.groupBy("iid", "len", "k", "per").agg(F.sort_array(F.collect_list(F.struct("q", "count", "h1", "h2"))).alias("s"))
    rarest = lambda j: F.array_min(F.transform(F.slice("s", j + 1, F.col("per")), lambda x: F.struct(x["count"], x["h1"], x["h2"], x["q"])))
    windows = listed.select("iid", "len", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("s") - F.col("per")), rarest)).alias("j", "r")).where("r.count > 0")
    prefixes = cut(windows.select("iid", "len", "j", "r.q", "r.h1", "r.h2"), "prefixes")

    start = F.col("p") - F.col("q") + F.col("j")
    in_bounds = (start >= 0) & (start + F.col("len") <= F.col("n"))
    candidates = found.join(maybe_broadcast(prefixes, 48), hash_cols).where(in_bounds).select(*doc, "iid", (F.col("p") - F.col("q")).alias("diag")).distinct()

    # Of each candidate: the item's shingles where they would stand, and which of them do.
    wanted = candidates.join(maybe_broadcast(items, 64), "iid").select(*doc, "iid", "item", "k", "per", "diag", "q", (F.col("q") + F.col("diag")).alias("p"), *hash_cols).where("p >= 0")
    same = F.col("a.__id").eqNullSafe(F.col("f.__id"))
    for c in ("__key", "p", *hash_cols):
        same &= F.col(f"a.{c}") == F.col(f"f.{c}")
    aligned = wanted.alias("a").join(found.alias("f"), same, "left_semi")
    run = [*doc, "iid", "diag"]
    runs = aligned.withColumn("g", F.col("q") - F.row_number().over(Window.partitionBy(*run).orderBy("q")))
    runs = runs.groupBy(*run, "g", "item", "k", "per").agg(F.min("q").alias("a"), F.count("*").alias("c")).where("c >= per")
    hits = cut(runs.selectExpr(*doc, "item", "int(diag + a) AS a", "int(diag + a + c + k - 2) AS b"), "hits")
    for table in (items, found, prefixes):
        drop_cut(table)

    positions = hits.select(*doc, F.explode(F.sequence("a", "b")).alias("p")).distinct().groupBy(*doc).agg(F.count("*").alias("n_hit"))
    which = hits.groupBy(*doc).agg(F.sort_array(F.collect_set("item")).alias("items"))
    judged = positions.alias("x").join(which.alias("y"), F.col("x.__id").eqNullSafe(F.col("y.__id")) & (F.col("x.__key") == F.col("y.__key"))).select("x.__id", "x.__key", "n_hit", "items")

    left = docs.withColumns({"__key": row_key(id_col, text_col), "n_words": F.size(words(text_of(text_col))).cast("long")})
    out = left.join(judged, left[id_col].eqNullSafe(judged["__id"]) & (left["__key"] == judged["__key"]), "left")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    out = out.withColumns({"n_items": F.size("items").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
    return out.select(*[left[c] for c in docs.columns], *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all ``documents`` against all of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, j + 1, j + l), ' ') AS s
        FROM (SELECT item_id, w, least(len(w), 13) AS l, unnest(range(len(w) - least(len(w), 13) + 1)) AS j FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
occ AS (SELECT doc_id, p, l, array_to_string(list_slice(w, p + 1, p + l), ' ') AS s
        FROM (SELECT doc_id, w, l, unnest(range(greatest(len(w) - l + 1, 0))) AS p FROM d, lens)),
hit AS (SELECT doc_id, p, occ.l, item_id FROM occ JOIN win ON occ.l = win.l AND occ.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS x FROM (SELECT DISTINCT doc_id, p, l FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
