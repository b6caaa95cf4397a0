"""Line deduplication with DataFrame functions only.

Normalised lines are exploded and hashed to 128 bits; distinct documents are counted for each
hash; lines of hashes found in ``min_docs`` documents or more are dropped everywhere, and each
document is put together again from its other lines by position.

What is defined for odd input: null text is one empty line (the result's text is ""); each row
is a document of its own, also where ids are null or repeat, and equal rows get equal results;
an empty table gives an empty table; other columns pass through untouched, and the operator
raises if one is named like a column that it adds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, row_key, text_of

ADDED = ("n_lines", "n_dropped")


SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    r"""A string that two lines share if they are equal without [\x20\x09-\x0D] at both ends and with A-Z lower-cased.

    The line's UTF-8 bytes are read as Latin-1 and lower-cased.  Besides A-Z that only changes lead
    bytes C0-DE, and the number of continuation bytes behind a lead byte still tells them from those
    they become, so other letters keep their case.  All steps have fast paths in the JVM; replacing
    A-Z by translate() takes about ten times as long.
    """
    ends = [f(line, F.lit(c)) for f in (F.startswith, F.endswith) for c in SPACE]
    stripped = F.when(reduce(Column.__or__, ends), F.btrim(line, F.lit(SPACE))).otherwise(line)
    return F.lower(F.decode(stripped.cast("binary"), "ISO-8859-1"))


def _hashed(line: Column) -> Column:
    # A lambda of one step keeps the key from being worked out once for each of its uses.
    return F.transform(F.array(line_key(line)), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), (F.octet_length(k) > 0).alias("full")))[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and n_lines, n_dropped (long)."""
    if clash := [c for c in docs.columns if c in ADDED or c.startswith("__")]:
        raise ValueError(f"columns named like added ones: {clash}")
    keyed = docs.select(F.col(id_col).alias("__id"), row_key(id_col, text_col).alias("__key"), _lines(text_of(text_col)).alias("__lines"))
    hashed = keyed.select("__id", "__key", F.transform("__lines", _hashed).alias("__h"))

    per_doc = hashed.select(F.explode(F.array_distinct("__h")).alias("h")).where("h.full")
    counts = per_doc.groupBy("h.h1", "h.h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    frequent = cut(counts.select("h1", "h2"), "frequent-lines")

    rows = hashed.select("__id", "__key", F.posexplode("__h").alias("pos", "h")).where("h.full").select("__id", "__key", "pos", "h.h1", "h.h2")
    hits = rows.join(maybe_broadcast(frequent, 16), ["h1", "h2"], "left_semi")
    # One document's positions only; equal rows share a key, so positions are a set.
    drops = hits.groupBy("__id", "__key").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))

    left = docs.withColumn("__key", row_key(id_col, text_col))
    on = left[id_col].eqNullSafe(drops["__id"]) & (left["__key"] == drops["__key"])
    joined = left.join(drops, on, "left").select(left["*"], drops["__drop"]).withColumn("__lines", _lines(text_of(text_col)))
    n = F.size("__lines")
    drop = F.coalesce(F.col("__drop"), F.array().cast("array<int>"))
    # Kept lines are the slices between dropped positions: one copy of each line, however many are dropped.
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), drop).alias("a"), F.concat(drop, F.array(n)).alias("b"))
    kept = F.flatten(F.transform(bounds, lambda x: F.slice(F.col("__lines"), x["a"] + 2, x["b"] - x["a"] - 1)))
    out = joined.withColumns({text_col: F.array_join(kept, "\n"), "n_lines": n.cast("long"), "n_dropped": F.size(drop).cast("long")})
    return out.select(*docs.columns, *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: line dedup of the whole of ``documents``, keys of 10 documents or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
