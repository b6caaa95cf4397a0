"""Helpers the operators share: lineage cuts, row keys, packing, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or an own one where it is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="thresher-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that takes far longer than reading: a table of fewer splits than cores is dealt out to all of them.

    Rows go by a hash of all columns, so a task that runs again deals them out as before; a table of more splits,
    as any large one is, stays as it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, F.xxhash64(*df.columns)) if df.rdd.getNumPartitions() < cores else df


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def long_id(df: DataFrame, col: str) -> Column:
    """An id column as long; other columns than whole numbers are refused before anything runs."""
    kind = df.schema[col].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"{col} must hold whole numbers, not {kind.simpleString()}")
    return F.col(col).cast("long")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A 64-bit key of a document's content, joined on together with its id.

    It depends on the row alone, so a recomputed task gives the same key.  Rows equal in id and
    text share it, and every operator gives such rows equal results.
    """
    return F.xxhash64(F.col(id_col), F.col(text_col))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table has so few rows that it may be broadcast; they are counted, so it should be cut or cheap to read."""
    return df.count() * row_bytes <= limit


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows; else as it is, for a shuffle join."""
    return F.broadcast(df) if small_enough(df, row_bytes, limit) else df


def grown(total: int, *bounds: int, beyond: int = 32 << 30, most: int = 16) -> list[int]:
    """Bounds of blocks and buckets: beyond so many bytes they grow with the square root of the total, up to ``most`` times."""
    return [int(b * min(most, max(1.0, (total / beyond) ** 0.5))) for b in bounds]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def text_slices(batch, text_col: str, batch_chars: int):
    """An Arrow batch in slices of about so many characters, each with its texts (null: empty)."""
    column, at = batch.column(batch.schema.names.index(text_col)), 0
    while at < batch.num_rows:
        end, chars, texts = at, 0, []
        while end < batch.num_rows and (end == at or chars < batch_chars):
            texts.append(column[end].as_py() or "")
            chars += len(texts[-1])
            end += 1
        yield batch.slice(at, end - at), texts
        at = end


def squeezed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with their text as compressed bytes, for an exchange that carries texts to Python."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in rows.schema.fields])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            i = batch.schema.names.index(text_col)
            packed = pa.array([packer.compress((t or "").encode()) for t in batch.column(i).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], packed, *batch.columns[i + 1 :]], names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def unsqueezed(column) -> list[bytes]:
    """The texts of :func:`squeezed` as UTF-8."""
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(t) for t in column.to_pylist()]


def bound_batches(spark: SparkSession, size: int = 32 << 20) -> None:
    """Arrow batches to Python are bounded by bytes too, as a few texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def give_back() -> None:
    """Give freed memory back to the system, which a worker would else hold while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(function, least: int = 1 << 20):
    """``function`` of Arrow tables to one, which gives memory back after groups of so many bytes."""

    def run(*tables):
        out = function(*tables)
        if sum(t.nbytes for t in tables) >= least:
            give_back()
        return out

    # Spark tells by the number of parameters whether a group's key is wanted.
    return (lambda left, right: run(left, right)) if function.__code__.co_argcount == 2 else (lambda table: run(table))


def components(nodes_edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components: edges (a, b) of longs -> (node, component), component the smallest node.

    Alternating large-star and small-star steps; each is a map-side combined minimum and a join, so
    a node with many links never sits in one task.  Nodes without an edge aren't in the result.
    """
    edges = cut(nodes_edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low2.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "edges")
        after = tuple(new.agg(F.count("*"), F.sum("u"), F.sum("v"), F.countDistinct("u")).first())
        drop_cut(edges)
        edges = new
        if after == state and after[0] == after[3]:
            break
        state = after
    else:
        raise RuntimeError("components did not converge")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
