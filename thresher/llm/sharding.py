"""Uniform sharding with exact sizes by a hypergeometric communication matrix.

Rows lie in source parts.  How many rows each part sends to each shard is drawn without
replacement (multivariate hypergeometric), so that every shard gets exactly its size.  Each part
permutes its rows and deals them out by its row of the matrix; after the exchange the rows of
each shard are permuted again: by a seeded hash, in bins that are equal slices of the hash's
range and small enough for one task however large a shard is.  A row's slot is the number of
rows in the bins before its own, plus its place in the bin.

The matrix is never built in one place: a part finds its own row by going down a binary tree
over the parts, drawing at each node, from the node's own seed, how many rows of each shard go to
the left half.  The driver holds one count for each part only.

A part is a hash bucket of the rows, and a permutation is a sort by a seeded hash, so a task that
runs again after an executor is lost deals its rows out as before.  Rows equal in id and text share a hash; a
group of more than ``part_rows`` of them is spread by numbers that are written to the shared folder first, so
that they stay the same.  There are ``MOST_PARTS`` parts at most, larger ones in a larger table.

What is defined for odd input: null text has size 1; null and repeated ids are rows like any
other; equal rows are interchangeable; an empty table gives no rows; other columns pass through,
and the operator raises if one is named like a column that it adds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, maybe_broadcast, row_key, text_of

ADDED = ("shard", "slot")
MOST_PARTS = 200_000

#: Each part and each bin is a task of its own, whatever spark.sql.shuffle.partitions is, up to this many tasks or that
#: setting, if it is larger; beyond that they share tasks.
MOST_TASKS = 20_000


#: numpy draws hypergeometric numbers of populations below this.
NUMPY_POPULATION = 10**9


def capacities(rows: int, shards: int) -> np.ndarray:
    """The size of each shard; sizes differ by one at most."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, numpy_population: int = NUMPY_POPULATION) -> int:
    """How many of ``draws`` rows taken without replacement are among the ``good`` ones.

    Above numpy's limit the distribution is summed around its mode by the ratio of neighbouring
    terms, over 12 standard deviations to both sides: what lies beyond is less than double precision.
    """
    total = good + bad
    if total < numpy_population:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(12 * (draws * share * (1 - share) * (total - draws) / max(1, total - 1)) ** 0.5) + 60
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)  # the step from k to k + 1
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.exp(weight - weight.max())
    return low + int(np.searchsorted(np.cumsum(weight), rng.random() * weight.sum(), side="right").clip(0, high - low))


def split(left: np.ndarray, draws: int, rng: np.random.Generator, numpy_population: int = NUMPY_POPULATION) -> np.ndarray:
    """How many of ``draws`` rows taken without replacement are of each shard."""
    out, rest = np.zeros_like(left), int(left.sum())
    for s, n in enumerate(left.tolist()):
        rest -= n
        out[s] = hypergeometric(rng, n, rest, draws, numpy_population) if n and draws else 0
        draws -= int(out[s])
    return out


def matrix_row(part: int, total: np.ndarray, sizes: np.ndarray, seed: int, known: dict | None = None) -> np.ndarray:
    """How many rows of ``part`` go to each shard; over all parts the columns sum to ``sizes``.

    ``total`` has the number of rows before each part, and of all.  ``known`` keeps nodes drawn before.
    """
    known = {} if known is None else known
    lo, hi, left = 0, len(total) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if (lo, hi) not in known:
            known[lo, hi] = split(left, int(total[mid] - total[lo]), np.random.default_rng([seed, lo, hi]))
        left, lo, hi = (known[lo, hi], lo, mid) if part < mid else (left - known[lo, hi], mid, hi)
    return left


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", part_rows: int = 20_000, bin_rows: int = 20_000) -> DataFrame:
    """``docs`` with shard (int) and slot (long, gapless from 0 in each shard), uniformly at random."""
    if clash := [c for c in docs.columns if c in ADDED or c.startswith("__")]:
        raise ValueError(f"columns named like added ones: {clash}")
    spark = docs.sparkSession
    rows = docs.count()
    part_rows = max(part_rows, -(-rows // MOST_PARTS))
    parts, bins = max(1, -(-rows // part_rows)), max(1, -(-rows // (shards * bin_rows)))
    # Also rows whose id is null or repeats are spread by their text.
    order = F.xxhash64(F.lit(seed), row_key(id_col, text_col))
    keyed = docs.withColumn("__order", order)
    hot = [r[0] for r in keyed.groupBy("__order").count().where(F.col("count") > part_rows).select("__order").collect()]  # fewer than parts
    if hot:
        equal = F.col("__order").isin(hot)
        salted = cut(keyed.where(equal).withColumn("__salt", F.monotonically_increasing_id()), "spread")  # no other row's text
        keyed = keyed.where(~equal).union(salted.withColumn("__order", F.xxhash64("__order", "__salt")).drop("__salt"))
    keyed = keyed.withColumn("__part", F.pmod(F.col("__order"), F.lit(parts)).cast("int"))
    found = {r[0]: r[1] for r in keyed.groupBy("__part").count().collect()}  # one count for each part
    total = np.concatenate([[0], np.cumsum([found.get(p, 0) for p in range(parts)])]).astype(np.int64)
    sizes = capacities(int(total[-1]), shards)

    schema = T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))])

    def draw(batches):
        known = {}
        for pdf in batches:
            ends = [np.cumsum(matrix_row(p, total, sizes, seed, known)) for p in pdf["__part"]]
            yield pd.DataFrame({"__part": pdf["__part"], "__ends": ends})

    most = max(MOST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_part, by_box = (min(parts, most), "__part"), (min(shards * bins, most), "__box")
    matrix = cut(spark.range(parts).select(F.col("id").cast("int").alias("__part")).mapInPandas(draw, schema), "matrix")
    # Laid out like the rows, so that a join which isn't broadcast doesn't move these again.
    sent = maybe_broadcast(matrix.repartitionById(*by_part), 8 * shards + 16)

    def deal(frame: DataFrame) -> DataFrame:
        local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(seed + 1), "__order"), "__order")
        dealt = frame.repartitionById(*by_part).withColumn("__rank", F.row_number().over(local)).join(sent, "__part")
        # The shard is the number of shards whose rows are all dealt before this rank.
        dealt = dealt.withColumn("shard", F.size(F.filter("__ends", lambda e: e < F.col("__rank"))))
        dealt = dealt.withColumn("__again", F.xxhash64(F.lit(seed + 2), "__order"))
        slice_of = F.shiftrightunsigned("__again", 33) * F.lit(bins).cast("long")
        # A box is a bin of a shard.
        return dealt.withColumn("__box", (F.col("shard") * bins + F.shiftright(slice_of, 31)).cast("int")).drop("__ends", "__rank", "__part")

    # Rows equal in __order share a bin, so their ties don't change the counts.
    sized = deal(keyed.select("__order", "__part")).groupBy("shard", "__box").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__box").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sized.select("__box", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")), "bins")
    again = Window.partitionBy("__box").orderBy("__again", "__order")
    placed = deal(keyed).repartitionById(*by_box).withColumn("__place", F.row_number().over(again) - 1).join(maybe_broadcast(starts.repartitionById(*by_box), 24), "__box")
    return placed.withColumn("slot", F.col("__first") + F.col("__place")).select(*docs.columns, "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: all ``documents`` into 16 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    utf8 = text_of().cast("binary")
    # The digests are of the texts that came into the shards: the exchanges carry whole documents.
    size, crc = (F.octet_length(utf8) + 1).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32")
    return shard_rows(docs).select("doc_id", size, crc, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
