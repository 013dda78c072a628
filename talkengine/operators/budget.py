"""Spending a call budget in order of score, and carrying over between folders what is left.

The order is global, by the exact score and then the id, so the running cost is too. Rows are range-partitioned in that
order; sums per range give each range its offset, and the running cost is taken within ranges, so equal scores and large
folders are spread over tasks.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..plans.runtime import written
from .sampling import join_null_safe

def max_calls(dollars: float, cost: float) -> int:
    """floor(dollars / cost) in decimals: 0.3 / 0.0001 is 3000."""
    return int(Decimal(str(dollars)) // Decimal(str(cost)))


def running_cost(rows: DataFrame, score: Column, calls: Column, id_: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``calls_before``: the calls of the rows with a higher score (ties: a smaller id), of the same ``by`` if given.
    Null scores come last. The number of ranges is the session's number of shuffle partitions, unless given."""
    by = by or []
    order = [*by, F.col("_s").desc_nulls_last(), id_]
    r = rows.withColumns({"_s": score, "_c": calls.cast("long")}).repartitionByRange(*([ranges] if ranges else []), *order)
    r = written(r.withColumn("_p", F.spark_partition_id()), "ranges")
    sums = r.groupBy(*by, "_p").agg(F.sum("_c").alias("_n"))  # a row per range and folder in it
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = join_null_safe(r, sums.withColumn("_before", before).drop("_n"), [*by, "_p"])
    within = F.sum("_c").over(W.partitionBy(*by, "_p").orderBy(F.col("_s").desc_nulls_last(), id_).rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")
    return joined.withColumn("calls_before", F.col("_before") + within).drop("_s", "_c", "_p", "_before")


def spend(rows: DataFrame, score: Column, calls: Column, id_: str, allowed: int, reserve: int = 0, by: list[str] | None = None) -> DataFrame:
    """Adds ``taken``: rows by falling score (ties by id) as long as the calls before them plus
    ``reserve`` (their own calls where it is 0) fit ``allowed``. Rows of 0 calls (cached answers) cost nothing."""
    r = running_cost(rows.withColumn("_calls", calls.cast("long")), score, F.col("_calls"), id_, by)
    need = F.lit(reserve) if reserve else F.col("_calls")
    return r.withColumn("taken", F.col("calls_before") + need <= allowed).drop("_calls", "calls_before")


def carried_over(demand: list[tuple[str, int]], calls_per_row: int, dollars: float, cost: float, done: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(folder, calls allowed, calls spent) folder by folder, from (folder, rows that need calls) in order.

    The allowance of all folders so far grows by an equal share of the cap per folder; a row is taken if its calls still
    fit, so what a folder leaves goes to those after it. Folders that are ``done`` keep their place and spend nothing.
    """
    spent, out = 0, []
    for k, (folder, rows) in enumerate(demand):
        if folder in done:
            continue
        allowed = int(min(Decimal(str(dollars)), (k + 1) * Decimal(str(dollars)) / len(demand)) // Decimal(str(cost))) - spent
        used = min(rows, max(0, allowed) // calls_per_row if calls_per_row else rows) * calls_per_row
        spent += used
        out.append((folder, allowed, used))
    return out


def spend_rolling(rows: DataFrame, folder: str, score: Column, cached: Column, id_: str, calls_per_row: int, dollars: float, cost: float, done: frozenset[str] = frozenset()) -> DataFrame:
    """The rows of the folders that are not done, with ``allowed`` calls of their folder and ``taken``: by falling score
    within the folder as long as the calls before plus those of a whole row fit; cached rows before that cost nothing.
    """
    spark: SparkSession = rows.sparkSession
    all_ = rows.withColumn("_calls", F.when(F.coalesce(cached, F.lit(False)), 0).otherwise(calls_per_row))
    demand = sorted((r[folder], r["n"]) for r in all_.groupBy(folder).agg(F.count_if(F.col("_calls") > 0).alias("n")).collect() if r[folder] is not None)  # one row per folder
    live = all_.where(~F.col(folder).isin(*done)) if done else all_
    plan = spark.createDataFrame([(f, a) for f, a, _ in carried_over(demand, calls_per_row, dollars, cost, done)], f"`{folder}` string, allowed long")
    r = running_cost(live, score, F.col("_calls"), id_, [folder]).join(F.broadcast(plan), folder)  # one row per folder
    return r.withColumn("taken", F.col("calls_before") + calls_per_row <= F.col("allowed")).drop("_calls", "calls_before")


def rolling_allowance(folders: DataFrame, folder: str, spent: str, dollars: float) -> DataFrame:
    """(folder, allowance, spent, left): each folder may use its share of the cap and what earlier ones left.

    One row per folder in order of its name; the folders are few, the rows in them were summed before.
    """
    w = W.orderBy(folder)
    n = F.count("*").over(W.partitionBy())
    k = F.row_number().over(w)
    used = F.coalesce(F.sum(spent).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    allowance = F.least(F.lit(dollars), k * F.lit(dollars) / n) - used
    return folders.select(folder, F.round(allowance, 6).alias("allowance"), spent, F.round(allowance - F.col(spent), 6).alias("left"))
