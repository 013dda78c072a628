"""Key lookups, anti and semi joins, updates and de-duplication with a defined survivor.

Ties are broken by the order columns given, so results do not depend on partitioning. The deduplications aggregate
(``min_by``) rather than rank, so a key that holds a third of all rows is combined in the tasks that read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import written


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``; null keys are keys like any other."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_kept"))
    return kept.select(*[F.col(c) if c in keys else F.col("_kept")[c].alias(c) for c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order`` (an upsert of appended versions)."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_kept"))
    return kept.select(*[F.col(c) if c in keys else F.col("_kept")[c].alias(c) for c in df.columns])


def net_new(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    """Rows whose key is not among the known ones."""
    return df.withColumn("_key", key).join(known.select(known_key.alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def already_known(df: DataFrame, known: DataFrame, key: Column, known_key: Column) -> DataFrame:
    return df.withColumn("_key", key).join(known.select(known_key.alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``columns`` overwritten where the key has a change (one per key), added where they are absent."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    out = df.join(new, key, "left")
    for c in columns:
        old = F.col(c) if c in df.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(old))
    return out.drop("_matched", *[f"_new_{c}" for c in columns])


def with_columns_present(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Absent columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in df.columns})


def next_number(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the number after the highest ``prefix``NNN id, 0 if there is none."""
    n = F.regexp_extract(column, f"^{prefix}(\\d+)$", 1).try_cast("int")
    return df.agg((F.coalesce(F.max(n), F.lit(-1)) + 1).alias("next"))


def numbered(df: DataFrame, order: list[str], name: str, pattern: str, start: int = 0, buckets: int | None = None) -> DataFrame:
    """Consecutive ids in the order given, without gathering all rows in one task: range buckets, counts, ranks within."""
    spark = df.sparkSession
    rows = df.repartitionByRange(*([buckets] if buckets else []), *order).sortWithinPartitions(*order)
    # the low 33 bits of this id count the rows of a partition, the high ones are the partition
    ranks = written(rows.withColumn("_i", F.monotonically_increasing_id()).withColumns({"_b": F.shiftright("_i", 33).cast("int"), "_n": F.col("_i").bitwiseAND(F.lit(2**33 - 1))}).drop("_i"), "numbered")
    counts = {r["_b"]: r["n"] for r in ranks.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # one row per bucket
    before, total = [], 0
    for b in sorted(counts):
        before.append((b, total))
        total += counts[b]
    shift = spark.createDataFrame(before, "_b int, _before long")
    at = F.col("_before") + F.col("_n") + start
    return ranks.join(F.broadcast(shift), "_b").withColumn(name, F.format_string(pattern, at)).drop("_b", "_n", "_before")


def cumulative(df: DataFrame, order: str, value: str, out: str, ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` up to each row in the order of a column without ties: sums per range give each range its
    offset, the rest is summed within ranges, so no task sees all rows."""
    from pyspark.sql import Window as W

    r = written(df.repartitionByRange(*([ranges] if ranges else []), order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = r.groupBy("_p").agg(F.sum(value).alias("_n"))  # one row per range
    before = sums.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum(value).over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return r.join(F.broadcast(before), "_p").withColumn(out, F.col("_before") + within).drop("_p", "_before")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A lookup table in which later rows overwrite earlier ones."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))
