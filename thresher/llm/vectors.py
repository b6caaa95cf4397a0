"""Near-duplicate vectors by NN-descent.

Vectors are compared by cosine, in double precision, where their labels are equal.  The steps:

1. equal vectors of a label are one node with a weight;
2. a first neighbour graph comes from random hyperplane trees: each tree cuts a label's vectors
   into leaves, and each leaf (in chunks of bounded size) gives its members' best ``k`` neighbours.
   A label has as many trees as keep a pair at the threshold in one leaf with ``pair_recall``, so
   that pairs with no other neighbours, which the descent can't reach, are found at any size;
3. NN-descent: the neighbours of each node, forwards and backwards, are tried as neighbours of
   one another, and better ones replace those in the lists, until hardly any list changes.
   Neighbours below cos(2 arccos threshold) lie between no two that should link and aren't kept;
4. edges at the threshold join nodes to components: of each leaf a spanning forest of all its links,
   then those of the lists.  A list holds ``k`` neighbours of the node's own component and, besides,
   the best of each of ``k`` other components, so a close family fills no place of another's.  While
   a link to another component turns up, the components join and step 3 goes on; at the end no list
   has one.  Links within components are counted by matrix products in chunks of bounded size, so no
   pairs are written;
5. recall is audited: a sample of vectors, enlarged until ``enough`` of them have links, is compared with
   all.  Vectors count alike, however many links they have, and those with fewer than ``k`` links are
   judged apart.  While either share is below ``recall``, steps 2 to 4 go on with more trees; if it
   still is after ``more`` turns, the job fails with the figure.

What is defined for odd input: a vector that is null, empty, zero or has a null or non-finite component,
or whose label is null, links with nothing and is its own component; so does one whose length differs
from the others; a null id has a null component and takes no part; rows of one id are vectors each;
an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, long_id, maybe_broadcast

EDGE = "a long, b long, cos double"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _edges(a, b, cos) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cos": pa.array(cos, pa.float64())})


def _unit(column, norm) -> np.ndarray:
    return _matrix(column).astype(float) / norm.to_numpy()[:, None]


def tree_count(depth: np.ndarray, threshold: float, pair_recall: float, least: int) -> np.ndarray:
    """How many trees of a depth keep a pair at the threshold in one leaf at least once, with ``pair_recall``."""
    apart = np.maximum(1 - (1 - np.arccos(threshold) / np.pi) ** depth, 1e-300)
    return np.maximum(least, np.ceil(np.log(1 - pair_recall) / np.minimum(np.log(apart), -1e-300))).astype(int)


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    new, left, right = linked.any(1), [], []
    while new.any():
        level = np.array([np.argmax(new)])
        new[level] = False
        while len(level):
            reached = np.flatnonzero(linked[level].any(0) & new)
            left.append(level[np.argmax(linked[level][:, reached], axis=0)])
            right.append(reached)
            new[reached] = False
            level = reached
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def _best(edges: DataFrame, joined: DataFrame, own: int, other: int) -> DataFrame:
    """Of each node its best neighbours, in both directions' edges: of its component, and one of each other component."""
    both = edges.select("a", "b", "cos").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    for c in "ab":
        both = both.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    both = both.select("a", F.struct("cos", "b").alias("e"), F.coalesce("cb", "b").alias("to"), (F.coalesce("ca", "a") != F.coalesce("cb", "b")).alias("foreign"))
    both = both.groupBy("a", "foreign", F.when(F.col("foreign"), F.col("to")).otherwise(F.col("e.b")).alias("to")).agg(F.max("e").alias("e"))
    # Each node has k edges for each tree and candidate list at most.
    pick = lambda foreign, k: F.slice(F.sort_array(F.collect_list(F.when(F.col("foreign") == foreign, F.col("e"))), asc=False), 1, k)
    return both.groupBy("a").agg(pick(False, own).alias("own"), pick(True, other).alias("other")).select("a", F.concat("own", "other").alias("list"))


def _trees(nodes: DataFrame, counts: DataFrame, trees: int, pair_recall: float, turn: int, leaf: int, k: int, floor: float, threshold: float, seed: int) -> DataFrame:
    """Edges between neighbours in the leaves of random hyperplane trees, and those that join all links of a leaf."""

    def place(batches):
        for batch in batches:
            x, depth = _matrix(batch.column(2)).astype(float), batch.column(4).to_numpy()
            need = tree_count(depth, threshold, pair_recall, trees)
            for t in range(need.max(initial=0)):
                planes = np.random.default_rng([seed, turn, t]).standard_normal((x.shape[1], 40))
                at = np.flatnonzero(need > t)
                bits = (x[at] @ planes > 0).astype(np.int64)
                code = (bits * (1 << np.arange(40)) * (np.arange(40) < depth[at][:, None])).sum(1)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(code), *part.columns[:4]], names=["tree", "code", "node", "label", "vec", "norm"])

    depth = F.greatest(F.lit(0), F.least(F.lit(40), F.ceil(F.log2(F.col("n") / leaf)))).cast("int").alias("depth")
    placed = nodes.join(counts, ["label", "dim"]).select("node", "label", "vec", "norm", depth)
    placed = placed.mapInArrow(place, f"tree int, code long, node long, label int, vec {nodes.schema['vec'].dataType.simpleString()}, norm double")
    # A leaf may still be large where many vectors are close: its chunks meet in the other trees and in the descent.
    crowd = placed.groupBy("tree", "label", "code").agg(F.count("*").alias("n"))
    chunk = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("n") / (2 * leaf))).cast("int").alias("chunk")
    placed = placed.join(maybe_broadcast(crowd, 32), ["tree", "label", "code"]).select("tree", "label", "code", chunk, "node", "vec", "norm")

    def leaves(table: pa.Table) -> pa.Table:
        node, x = table["node"].to_numpy(), _unit(table["vec"], table["norm"])
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        best = np.argsort(-cos, axis=1, kind="stable")[:, :k]
        a = np.repeat(np.arange(len(node)), best.shape[1])
        b, keep = best.ravel(), cos[a, best.ravel()] >= floor
        left, right = _forest(cos >= threshold)
        a, b = np.concatenate([a[keep], left]), np.concatenate([b[keep], right])
        return _edges(node[a], node[b], cos[a, b])

    return placed.groupBy("tree", "label", "code", "chunk").applyInArrow(leaves, EDGE)


def _cosines(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) of at least ``floor``, with their cosine."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("vec").alias(f"u{c}"), F.col("norm").alias(f"n{c}")) for c in "ab")

    def run(batches):
        for batch in batches:
            cos = np.einsum("ij,ij->i", _unit(batch.column(2), batch.column(4)), _unit(batch.column(3), batch.column(5)))
            keep = pa.array(cos >= floor)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(cos).filter(keep)], names=["a", "b", "cos"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub", "na", "nb").mapInArrow(run, EDGE)


def _entries(lists: DataFrame) -> DataFrame:
    return lists.select("a", F.explode("list").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.cos").alias("cos"))


def _descend(lists: DataFrame, nodes: DataFrame, joined: DataFrame, k: int, floor: float, rounds: int, least_change: float) -> DataFrame:
    for _ in range(rounds):
        edges = _entries(lists)
        # Neighbours forwards and backwards, 3 k of each node, are tried with one another.
        around = _best(edges, joined, k, 2 * k).select(F.transform("list", lambda e: e["b"]).alias("near"))
        pairs = around.select(F.explode("near").alias("a"), "near").select("a", F.explode("near").alias("b")).where("a < b").distinct()
        tried = pairs.join(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
        new = cut(_best(edges.union(_cosines(tried, nodes, floor)), joined, k, k), "lists")
        same = new.join(lists.withColumnRenamed("list", "old"), "a", "left")
        change = same.agg(F.sum(F.size(F.array_except("list", F.coalesce("old", F.array().cast("array<struct<cos:double,b:bigint>>"))))), F.sum(F.size("list"))).first()
        drop_cut(lists)
        lists = new
        if not change[1] or change[0] <= least_change * change[1]:
            break
    return lists


def _join_all(found: DataFrame, nodes: DataFrame, k: int, floor: float, threshold: float, rounds: int, least_change: float) -> tuple[DataFrame, DataFrame]:
    """From the edges found: (lists, components), where no list has a link to another component."""
    joined = components(found.where(F.col("cos") >= threshold))
    lists = cut(_best(found, joined, k, k), "lists")
    while True:
        lists = _descend(lists, nodes, joined, k, floor, rounds, least_change)
        fresh = _entries(lists).where(F.col("cos") >= threshold)
        for c in "ab":
            fresh = fresh.join(joined.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
        fresh = fresh.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        if fresh.isEmpty():
            return lists, joined
        # Each turn joins two components at least, so this ends.
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(fresh))
        old, lists = lists, cut(_best(_entries(lists), joined, k, k), "lists")
        drop_cut(old)


def _component_links(members: DataFrame, threshold: float, chunk: int) -> DataFrame:
    """Links of each node within its component: (node, links), the sum of linked nodes' weights."""
    size = members.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    rows = members.join(size, "component").withColumn("n", F.ceil(F.col("m") / chunk).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"), "node", "weight", "vec", "norm")

    def run(table: pa.Table) -> pa.Table:
        node, side, weight, x = table["node"].to_numpy(), table["side"].to_numpy(), table["weight"].to_numpy(), _unit(table["vec"], table["norm"])
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        at, to = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        linked = x[at] @ x[to].T >= threshold
        if lo == hi:
            np.fill_diagonal(linked, False)
            found = [(node[at], linked @ weight[to])]
        else:
            found = [(node[at], linked @ weight[to]), (node[to], linked.T @ weight[at])]
        return pa.table({"node": pa.array(np.concatenate([f[0] for f in found])), "links": pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))})

    return rows.groupBy("component", "lo", "hi").applyInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, few: int, sample: int, enough: int, most: int) -> float:
    """The mean share of links found of a sample's vectors that have some, which are compared with all nodes.

    The sample grows up to ``most`` until ``enough`` of them have links.  Of vectors with fewer than ``few`` links
    and of the others, it is the smaller share.
    """
    total = nodes.count()
    while True:
        probes = nodes.select("node", "label", "dim", "vec", "norm").orderBy(F.xxhash64("node", F.lit(3)), "node").limit(sample).toArrow()  # bounded by most
        kinds = {}
        for kind in set(zip(probes["label"].to_pylist(), probes["dim"].to_pylist())):
            at = np.flatnonzero((probes["label"].to_numpy() == kind[0]) & (probes["dim"].to_numpy() == kind[1]))
            part = probes.take(pa.array(at))
            kinds[kind] = part["node"].to_numpy(), _unit(part["vec"], part["norm"])

        def run(batches, kinds=kinds):
            sums = {kind: np.zeros(len(ids), np.int64) for kind, (ids, _) in kinds.items()}
            for batch in batches:
                node, label, dim, weight = (batch.column(i).to_numpy() for i in range(4))
                for kind, (ids, x) in kinds.items():
                    mine = np.flatnonzero((label == kind[0]) & (dim == kind[1]))
                    step = max(1, 4_000_000 // len(ids))
                    for s in range(0, len(mine), step):
                        at = mine[s : s + step]
                        hit = (x @ _unit(batch.column(4).take(pa.array(at)), batch.column(5).take(pa.array(at))).T >= threshold) & (ids[:, None] != node[at])
                        sums[kind] += hit @ weight[at]
            for kind, (ids, _) in kinds.items():
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[kind])], names=["node", "n"])

        truth = nodes.select("node", "label", "dim", "weight", "vec", "norm").mapInArrow(run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).where("n > 0")
        share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
        found = truth.join(links, "node", "left").groupBy((F.col("n") < few).alias("few")).agg(F.count("*").alias("n"), F.avg(share).alias("share")).collect()
        if sum(r["n"] for r in found) >= enough or sample >= min(total, most):
            return min((r["share"] for r in found), default=1.0)
        sample = min(4 * sample, most)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k: int = 8, trees: int = 8, leaf: int = 128, rounds: int = 4, least_change: float = 0.002, chunk: int = 1_000, sample: int = 256, enough: int = 100, most: int = 16_384, recall: float = 0.98, pair_recall: float = 0.999, more: int = 3, seed: int = 1) -> DataFrame:
    """Of each vector: vec_id, n_links, component_id (long), kept (boolean: it is its component's smallest id)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(long_id(vectors, id_col).alias("vec_id"), F.col(label_col).cast("int").alias("label"), v.alias("v"), F.coalesce(finite, F.lit(False)).alias("finite"))
    rows = rows.withColumn("norm", F.when(F.col("finite"), F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))))
    valid = F.coalesce(F.col("finite") & (F.col("norm") > 0) & (F.col("norm") < float("inf")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.select("vec_id", "label", "v", "norm", F.when(valid, F.xxhash64("label", "v")).alias("h1"), F.when(valid, F.xxhash64(F.lit(7), "v")).alias("h2"))
    usable = rows.where("h1 IS NOT NULL")
    # Equal vectors share a class; partial sums come before the exchange, so copies are few rows.
    nodes = usable.groupBy("h1", "h2", "label", "norm", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"))
    # Single-precision input is kept so, and made double where it is compared.
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    vec = F.col("v").cast("array<float>" if single else "array<double>").alias("vec")
    nodes = cut(nodes.select("node", "label", "weight", F.size("v").alias("dim"), "h1", "h2", vec, "norm"), "nodes")
    counts = maybe_broadcast(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")), 24)
    floor = 2 * threshold * threshold - 1

    edges, links, joined, share, tables = None, None, None, 1.0, []
    for turn in range(more):
        grown = None
        for dim in [r[0] for r in nodes.select("dim").distinct().collect()]:  # lengths of vectors, one as a rule
            own = _trees(nodes.where(F.col("dim") == dim), counts, trees, pair_recall, turn, leaf, k, floor, threshold, seed)
            grown = own if grown is None else grown.union(own)
        if grown is None:
            break
        found = cut(grown if edges is None else grown.union(edges), "found")
        lists, joined = _join_all(found, nodes, k, floor, threshold, rounds, least_change)
        # What joined components stays joined in the next turn.
        edges = _entries(lists).union(joined.select(F.col("node").alias("a"), F.col("component").alias("b"), F.lit(threshold).alias("cos")).where("a <> b"))
        members = nodes.join(joined, "node").select("node", "component", "weight", "vec", "norm")
        links = cut(_component_links(members, threshold, chunk), "links")
        tables += [found, lists, links]
        share = _audit(nodes, links, threshold, k, sample, enough, most)
        if share >= recall:
            break
    if share < recall:
        raise RuntimeError(f"vectors: the audit found {share:.4f} of the links after {more} turns, not {recall}")

    found = nodes.select("node", "weight", "h1", "h2")
    if links is None:
        found = found.withColumns({"links": F.lit(0).cast("long"), "component": F.col("node")})
    else:
        found = found.join(links, "node", "left").join(joined, "node", "left")
    found = found.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(maybe_broadcast(found, 40), ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = cut(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vectors")
    for table in [nodes, *tables]:
        drop_cut(table)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all ``embeddings``, cosine 0.93 between vectors of one label."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT * FROM v WHERE list_dot_product(e, e) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) AS l ON vec_id = l.a
LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) AS c ON vec_id = c.a
"""
