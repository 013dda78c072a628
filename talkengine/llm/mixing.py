"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

The mixture is as large as the scarcest source allows: total = min over sources of tokens x max_repeats / share.
It is counted in blocks of equal token numbers; the blocks go to sources, and a source's blocks to its shards, by
highest quotients weight / (2k + 1). A shard lays its documents end to end and cuts that into blocks, a document
being of the block that its middle is in; whole rounds are used first, then blocks in a seeded order until the quota
is met as nearly as whole documents allow.

Scale: each source is dealt by hash to as many shards of about ``shard_tokens`` as it has tokens for, so a source that
holds a third of all rows is many shards, and a small one few. Shards are apportioned in bundles of ``bundle``: the
driver gives blocks to sources and their bundles (one row for 16 billion tokens), tasks give a bundle's to its
shards. Each shard's running sums are bounded windows over one shuffle.

Defined results: sources without target or without tokens take no part (the others' shares are scaled up), shares or
caps that are null, zero or negative count as no target, documents without id, source or tokens are never used, a
repeated id counts once, empty tables give empty results, further columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..plans.runtime import written

SHARD_TOKENS = 4_000_000
BLOCK_TOKENS = 1024
LEAST_BLOCKS = 4096
BUNDLE = 4096


def apportion(weights: Mapping[str, float], seats: int) -> dict[str, int]:
    """Sainte-Laguë: each seat to the highest quotient weight / (2k + 1), ties to the smaller name.

    The bulk is found by bisection on the divisor (a share of w * x rounds to its seats), the rest by quotients.
    """
    keys = sorted(k for k, w in weights.items() if w > 0)
    if not keys or seats <= 0:
        return {k: 0 for k in weights}
    total = sum(weights[k] for k in keys)
    low, high = 0.0, 2.0 * (seats + len(keys)) / total
    for _ in range(200):
        middle = (low + high) / 2
        if sum(int(weights[k] * middle + 0.5) for k in keys) <= seats:
            low = middle
        else:
            high = middle
    out = {k: int(weights[k] * low + 0.5) for k in keys}
    queue = [(-weights[k] / (2 * out[k] + 1), k) for k in keys]
    heapq.heapify(queue)
    for _ in range(seats - sum(out.values())):
        _, k = heapq.heappop(queue)
        out[k] += 1
        heapq.heappush(queue, (-weights[k] / (2 * out[k] + 1), k))
    return {k: 0 for k in weights} | out


def quotas(held: Mapping[str, Mapping[int, int]], targets: Mapping[str, tuple[float, int]], block_tokens: int = BLOCK_TOKENS) -> tuple[int, list[tuple[str, int, int]]]:
    """(block, (source, bundle, blocks to draw)) from source -> bundle -> tokens and source -> (share, max_repeats)."""
    have = {s: sum(b.values()) for s, b in held.items()}
    live = {s: t for s, t in targets.items() if have.get(s, 0) > 0}
    if not live:
        return 1, []
    scale = sum(share for share, _ in live.values())
    total = min(have[s] * repeats * scale / share for s, (share, repeats) in live.items())
    block = max(1, min(block_tokens, int(total) // LEAST_BLOCKS))
    blocks = apportion({s: share for s, (share, _) in live.items()}, int(total) // block)
    return block, [(s, int(k), n) for s in live for k, n in apportion({f"{k:012d}": n for k, n in held[s].items()}, blocks[s]).items()]


def _shard_quotas(block: int):
    """The blocks of one bundle to its shards, (source, shard, tokens, quota)."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        seats = apportion({f"{k:012d}": int(n) for k, n in zip(b["shard"], b["tokens"])}, int(b["blocks"].iloc[0]))
        return b.assign(quota=[seats[f"{k:012d}"] * block for k in b["shard"]])[["source", "shard", "tokens", "quota"]]

    return run


def mix(documents: DataFrame, targets: DataFrame, seed: int = 23, shard_tokens: int = SHARD_TOKENS, block_tokens: int = BLOCK_TOKENS, bundle: int = BUNDLE) -> DataFrame:
    """(id, source, n_tokens, uses) of every document drawn at least once, from (id, source, n_tokens) and
    (source, target_share, max_repeats), one row per source and few enough for the driver."""
    spark = documents.sparkSession
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()
    goal = {r[0]: (float(r[1]), int(r[2])) for r in wanted}
    names = spark.createDataFrame([(s, m) for s, (_, m) in sorted(goal.items())], "source string, max_repeats long")
    rows = documents.select("id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("id is not null and n_tokens > 0").join(F.broadcast(names), "source")
    rows = written(rows.dropDuplicates(["id"]), "mixed")
    counts = rows.groupBy("source").agg(F.ceil(F.sum("n_tokens") / shard_tokens).cast("int").alias("n_shards"))  # each source by its own tokens
    dealt = rows.join(F.broadcast(counts), "source").withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("n_shards")).cast("int")).drop("n_shards")
    shards = written(dealt.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens")).withColumn("bundle", F.floor(F.col("shard") / bundle).cast("int")), "shards")
    held: dict[str, dict[int, int]] = {}
    for r in shards.groupBy("source", "bundle").agg(F.sum("tokens").alias("tokens")).collect():  # tokens / (bundle * shard_tokens) rows and one more per source
        held.setdefault(r["source"], {})[r["bundle"]] = r["tokens"]
    block, drawn = quotas(held, goal, block_tokens)
    blocks = spark.createDataFrame(drawn, "source string, bundle int, blocks long")
    plan = shards.join(blocks, ["source", "bundle"]).groupBy("source", "bundle").applyInPandas(_shard_quotas(block), "source string, shard int, tokens long, quota long")
    laid = W.partitionBy("source", "shard").orderBy("id")
    place = F.sum("n_tokens").over(laid.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens") / 2
    cut = dealt.join(plan, ["source", "shard"]).withColumn("block", F.floor(place / block))
    order = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "source", "shard", "block"), "block", "id")
    cut = cut.withColumn("to", F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rounds = F.least(F.floor(F.col("quota") / F.col("tokens")), F.col("max_repeats"))
    rest = F.col("quota") - rounds * F.col("tokens")
    once = (F.col("to") - F.col("n_tokens") / 2 < rest) & (rounds < F.col("max_repeats"))
    uses = (rounds + F.when(once, 1).otherwise(0)).cast("int")
    return cut.select("id", "source", "n_tokens", uses.alias("uses")).where("uses > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_documents, n_tokens, most_uses); targets that got nothing have 0."""
    by = drawn.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    total = by.agg(F.sum("n_tokens").alias("total"))
    rows = targets.select("source", "target_share").join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
    actual = F.coalesce(F.round(F.col("n_tokens") / F.col("total"), 6), F.lit(0.0))
    return rows.select("source", "target_share", actual.alias("actual_share"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_documents", "n_tokens", "most_uses")])
