"""Splits that keep related records together: Borůvka contraction, size bands, systematic dealing.

``spanning_forest`` contracts, in every round, each component along its least outgoing edge; edges are ordered by a
hash and then by their ends, so the order is strict, the only cycles are mutual choices, and the chosen edges form a
forest. Component count at least halves per round. Forest and labels are written to the shared folder after each
round, so lost executors cost one round at most. All per-component work is a partial aggregation (``min``, ``sum``),
so a component that holds a third of all rows moves one partial row per task; joins have one row per component on
one side, and adaptive execution splits the other side where a key is hot.

``deal`` puts the components (families) into bands by the power of two of their size. The largest are dealt one by
one to the split that lacks most, the bands below by a low-discrepancy sequence over a seeded order.

Defined results: null or blank ends give no edge, a node without edges is a family of its own, repeated edges and
records count once, empty tables give empty results, further columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.runtime import written

SHARES = (("train", 0.8), ("val", 0.1), ("test", 0.1))
TOP = 1000
_BUCKETS = 1024
_GOLDEN = (math.sqrt(5) - 1) / 2


def _roots(best: DataFrame) -> DataFrame:
    """(c, root) for components that chose (c -> to): mutual choices end in the smaller one, others are followed."""
    a, b = best.select("c", "to"), best.select(F.col("c").alias("to"), F.col("to").alias("back"))
    parent = written(
        a.join(b, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")),
        "parents",
    )
    while True:
        above = parent.select(F.col("c").alias("root"), F.col("root").alias("top"))
        jumped = written(parent.join(above, "root", "left").select("c", F.coalesce("top", "root").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
        parent = jumped.select("c", "root")
        if not jumped.where("moved").limit(1).count():
            return parent


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, DataFrame]:
    """((a, b) edges of a spanning forest, (node, root) labels of all nodes that have an edge)."""
    ends = edges.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a is not null and b is not null and a <> b")
    live = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    labels, forest, spark = None, None, edges.sparkSession
    while live.limit(1).count():
        order = F.struct(F.xxhash64("a", "b").alias("w"), "a", "b")
        both = live.select(F.col("ca").alias("c"), F.col("cb").alias("to"), order.alias("e")).union(live.select(F.col("cb"), F.col("ca"), order))
        best = written(both.groupBy("c").agg(F.min(F.struct("e", "to")).alias("m")).select("c", "m.to", "m.e.a", "m.e.b"), "best")
        picked = best.select("a", "b").distinct()
        forest = picked if forest is None else forest.union(picked)
        roots = _roots(best)
        labels = roots.withColumnRenamed("c", "node") if labels is None else written(
            labels.join(roots.withColumnRenamed("c", "old"), labels["root"] == F.col("old"), "left").select("node", F.coalesce(roots["root"], labels["root"]).alias("root")), "labels")
        left = live.join(roots.select(F.col("c").alias("ca"), F.col("root").alias("ra")), "ca").join(roots.select(F.col("c").alias("cb"), F.col("root").alias("rb")), "cb")
        live = written(left.where("ra <> rb").select("a", "b", F.col("ra").alias("ca"), F.col("rb").alias("cb")), "edges")
    if labels is None:
        return spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "node string, root string")
    return forest, labels


def components(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, root) for all nodes; one without an edge is its own root."""
    return nodes.select("node").distinct().join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def deal(families: DataFrame, shares: tuple[tuple[str, float], ...] = SHARES, seed: int = 17, top: int = TOP) -> DataFrame:
    """(root, size, band, split) from (root, size).

    The bands that together hold at most ``top`` families are dealt family by family, largest first, each to the
    split that lacks most; the other bands are dealt by the shares that are then still missing. Their ranking is
    distributed: counts of hash buckets give each bucket its offset, ranks are taken within a bucket.
    """
    spark, names = families.sparkSession, [name for name, _ in shares]
    band = F.floor(F.log2(F.greatest("size", F.lit(1)))).cast("int")
    f = written(families.select("root", "size", band.alias("band"), F.xxhash64(F.lit(seed), "root").alias("h")).withColumn("bucket", F.pmod("h", F.lit(_BUCKETS)).cast("int")), "families")
    bands = f.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("rows")).orderBy(F.desc("band")).collect()  # at most 64
    total, head, k = sum(r["rows"] for r in bands), [], 0
    for r in bands:
        if (k := k + r["n"]) > top:
            break
        head.append(r["band"])
    missing = {name: share * total for name, share in shares}
    placed = []
    for r in f.where(F.col("band").isin(head)).orderBy(F.desc("size"), "h", "root").collect() if head else []:  # at most top
        split = max(names, key=lambda x: missing[x])
        missing[split] -= r["size"]
        placed.append((r["root"], r["size"], r["band"], split))
    rest = {name: max(0.0, m) for name, m in missing.items()}
    scale = sum(rest.values()) or 1.0
    edges = [sum(rest[x] for x in names[: k + 1]) / scale for k in range(len(names))]

    others = f.where(~F.col("band").isin(head)) if head else f
    counts = others.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    shift = counts.select("band", "bucket", (F.sum("n").over(W.partitionBy("band").orderBy("bucket")) - F.col("n")).alias("before"))  # at most 64 x _BUCKETS rows
    ranked = others.withColumn("k", F.row_number().over(W.partitionBy("band", "bucket").orderBy("h", "root"))).join(F.broadcast(shift), ["band", "bucket"])
    place = (F.col("before") + F.col("k") - 0.5) * F.lit(_GOLDEN)
    u = place - F.floor(place)
    split = F.lit(names[-1])
    for name, edge in reversed(list(zip(names[:-1], edges))):
        split = F.when(u < edge, name).otherwise(split)
    dealt = ranked.select("root", "size", "band", split.alias("split"))
    return dealt.union(spark.createDataFrame(placed, "root string, size long, band int, split string")) if placed else dealt
