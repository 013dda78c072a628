"""Seeded samples, stratified splits and family hold-outs, ordered by md5(seed | id) so that they are repeatable.

Ranks are windows over strata. Where one stratum may hold most rows, ``stratified_split`` ranks by hash buckets of
the order key first (counts of buckets, then ranks within), so no task sorts a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

RATIOS = (0.8, 0.1, 0.1)
SPOT_RATE = 0.12


def order_key(seed: int | str, id_: str | Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(id_) if isinstance(id_, str) else id_).cast("string")))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the keys are kept once."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, on).drop(*[f"_r_{c}" for c in keys])


def ranked(df: DataFrame, stratum: list[str], key: Column, rank: str = "_rank", size: str = "_size") -> DataFrame:
    """Adds the 1-based rank of each row by ``key`` within its stratum and the stratum's size, bucket by bucket."""
    rows = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))  # 4096 buckets of each stratum
    counts = rows.groupBy(*stratum, "_bucket").agg(F.count("*").alias("_n"))
    all_ = W.partitionBy(*stratum)
    shift = counts.select(*stratum, "_bucket", (F.sum("_n").over(all_.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(all_).alias(size))
    joined = join_null_safe(rows, shift, [*stratum, "_bucket"])
    within = F.row_number().over(W.partitionBy(*stratum, "_bucket").orderBy("_key"))
    return joined.withColumn(rank, (F.col("_before") + within).cast("long")).drop("_key", "_bucket", "_before")


def stratified_split(df: DataFrame, stratum: str, id_: str, ratios: tuple[float, float, float] = RATIOS, seed: int = 17) -> DataFrame:
    """Adds ``split``: per stratum round(n r0) train, round(n r1) val, the rest test; half rounds to even."""
    if abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError("ratios must be non-negative and sum to 1")
    r = ranked(df, [stratum], order_key(seed, id_))
    train = F.bround(F.col("_size") * ratios[0])
    val = F.bround(F.col("_size") * ratios[1])
    train = F.least(train, F.col("_size") - val)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test")
    return r.withColumn("split", split).drop("_rank", "_size")


def inherited_split(members: DataFrame, anchors: DataFrame, anchor: str, anchor_id: str, default: str = "train") -> DataFrame:
    """Members take their anchor's split, or the default if it has none."""
    table = anchors.select(F.col(anchor_id).alias(anchor), F.col("split")).dropDuplicates([anchor])
    return members.join(table, anchor, "left").withColumn("split", F.coalesce("split", F.lit(default)))


def make_splits(corpus: DataFrame, negatives: DataFrame, pairs: DataFrame, ratios: tuple[float, float, float] = RATIOS, seed: int = 17) -> DataFrame:
    """(id, kind, stratify_key, anchor_id, split): positives by sub-type, negatives by source and sub-type, pairs with
    their anchors. Inputs: (id, stratify_key), (id, stratify_key), (id, anchor_id, stratify_key)."""
    pos = stratified_split(corpus, "stratify_key", "id", ratios, seed)
    neg = stratified_split(negatives, "stratify_key", "id", ratios, seed + 1)
    var = inherited_split(pairs, pos, "anchor_id", "id_") if "id_" in pos.columns else inherited_split(pairs, pos.withColumnRenamed("id", "id_"), "anchor_id", "id_")
    columns = ("id", "kind", "stratify_key", "anchor_id", "split")
    none = F.lit(None).cast("string")
    parts = [pos.withColumns({"kind": F.lit("positive"), "anchor_id": none}), neg.withColumns({"kind": F.lit("negative"), "anchor_id": none}), var.withColumn("kind", F.lit("pair"))]
    return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))


def held_out_families(anchors: DataFrame, informal: Column, variants: DataFrame, extra: int = 30, seed: int = 17) -> DataFrame:
    """(id, slice_reason): anchors in informal settings and ``extra`` other ones with an informal variant, by seed."""
    own = anchors.where(informal).select("id", F.lit("informal_positive").alias("slice_reason")).distinct()
    other = anchors.where(~informal).join(variants.select(F.col("anchor_id").alias("id")).distinct(), "id", "left_semi").select("id").distinct()
    drawn = other.orderBy(order_key(seed, "id")).limit(extra).withColumn("slice_reason", F.lit("informal_variant_family"))
    return own.unionByName(drawn)


def stratified_sample(df: DataFrame, strata: list[str], id_: str, n: int = 50, seed: int = 42) -> DataFrame:
    """n rows: n // strata from each stratum by seed, topped up from the rest by seed; ids never repeat."""
    k = F.greatest(F.lit(1), F.floor(F.lit(n) / F.greatest(F.lit(1), F.col("_strata"))))
    strata_n = df.select(*strata).distinct().agg(F.count("*").alias("_strata"))
    r = ranked(df, strata, order_key(seed, id_)).crossJoin(F.broadcast(strata_n))  # one row
    first = F.when(F.col("_rank") <= k, 0).otherwise(1)
    return r.orderBy(first, order_key(seed, id_)).limit(n).drop("_rank", "_size", "_strata")


def spot_sample(df: DataFrame, strata: list[str], id_: str, rate: float = SPOT_RATE, seed: int = 42) -> DataFrame:
    """At least one and else round(rate n) rows of each stratum; half rounds to even."""
    r = ranked(df, strata, order_key(seed, id_))
    return r.where(F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.col("_size") * rate))).drop("_rank", "_size")


def round_robin(rows: DataFrame, id_: str, anchors: DataFrame, anchor_id: str, seed: int = 42) -> DataFrame:
    """Each row with the anchor whose place in the seeded order is the row's place modulo the number of anchors."""
    a = ranked(anchors.withColumn("_all", F.lit(0)), ["_all"], order_key(seed, anchor_id)).select(anchor_id, (F.col("_rank") - 1).alias("_slot"), F.col("_size").alias("_n"))
    n = a.agg(F.max("_n").alias("_n"))
    r = ranked(rows.withColumn("_all", F.lit(0)), ["_all"], order_key(seed, id_)).drop("_all", "_size").crossJoin(F.broadcast(n))  # one row
    return r.withColumn("_slot", F.pmod(F.col("_rank") - 1, F.col("_n"))).join(a.drop("_n"), "_slot").drop("_slot", "_rank", "_n")
