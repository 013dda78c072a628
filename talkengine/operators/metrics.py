"""Metrics as aggregates: confusion, AUROC, rank correlation, ranking metrics, threshold tuning, agreement, crosstabs.

AUROC and Spearman need ranks over all rows. They come from counts per distinct score, summed up range by range, so
no task sees all of them, whatever the scores are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .relate import cumulative


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def confusion(df: DataFrame, truth: Column, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f1), 0 where undefined."""
    y, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    out = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def auroc(df: DataFrame, truth: Column, score: Column) -> DataFrame:
    """One row (n_pos, n_neg, auroc): Mann-Whitney with mid-ranks for ties; null if one class is missing."""
    by = df.where(score.isNotNull() & truth.isNotNull()).groupBy(score.alias("s")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    wins = cumulative(by, "s", "n", "upto").withColumn("w", F.col("p") * (F.col("upto") - F.col("n") / 2))
    total = wins.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_neg"), F.sum("w").alias("w"))
    return total.select("n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def mid_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the average 1-based rank of each value."""
    by = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = cumulative(by, "_v", "_c", "_upto").select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, spearman): Pearson of mid-ranks; null for fewer than two rows or no variance."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    r = mid_ranks(mid_ranks(both, x, "_rx"), y, "_ry")
    s = r.agg(F.count("*").alias("n"), F.covar_pop("_rx", "_ry").alias("c"), F.stddev_pop("_rx").alias("a"), F.stddev_pop("_ry").alias("b"))
    return s.select("n", F.when((F.col("n") > 1) & (F.col("a") > 0) & (F.col("b") > 0), F.try_divide(F.col("c"), F.col("a") * F.col("b"))).alias("spearman"))


def threshold_grid(start: float = 0.05, stop: float = 0.96, step: float = 0.05) -> list[float]:
    """start, start + step, ... below stop, rounded to 4 places."""
    out, k = [], 0
    while start + k * step < stop - 1e-12:
        out.append(round(start + k * step, 4))
        k += 1
    return out


def tune_threshold(dev: DataFrame, slice_: DataFrame, grid: list[float] | None = None, floor: float = 0.80) -> DataFrame:
    """One row (threshold, f1, recall, slice_recall): the best F1 on dev (score, truth) among thresholds whose recall on
    the slice (score) reaches the floor, or among all if none does; ties by recall, then the lower threshold.

    Each score is compared with the short grid in place; rows are never multiplied before they are summed.
    """
    grid = grid or threshold_grid()
    spark = dev.sparkSession
    flat = [F.count_if((F.col("score") >= t) & F.col("truth")).alias(f"tp{k}") for k, t in enumerate(grid)] + [F.count_if((F.col("score") >= t) & ~F.col("truth")).alias(f"fp{k}") for k, t in enumerate(grid)]
    d = dev.agg(F.count_if("truth").alias("pos"), *flat)
    s = slice_.agg(F.count("*").alias("n"), *[F.count_if(F.col("score") >= t).alias(f"hit{k}") for k, t in enumerate(grid)])
    cells = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"hit{k}").alias("hit")) for k, t in enumerate(grid)]
    rows = d.crossJoin(s).select("pos", "n", F.explode(F.array(*cells)).alias("c")).select("pos", "n", "c.*")  # one row by one row
    scored = rows.select("threshold", share(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos")).alias("f1"), share(F.col("tp"), F.col("pos")).alias("recall"), share(F.col("hit"), F.col("n")).alias("slice_recall"))
    best = F.struct((F.col("slice_recall") >= floor).cast("int").alias("ok"), F.round("f1", 9).alias("a"), F.round("recall", 9).alias("b"), (-F.col("threshold")).alias("c"))
    return scored.agg(F.max_by(F.struct("threshold", "f1", "recall", "slice_recall"), best).alias("m")).select("m.*")


def ranking_metrics(ranked: DataFrame, k: int = 10) -> DataFrame:
    """One row (n_queries, precision_at_1, mrr, mrr_at_k, recall_at_k, ndcg_at_k) over (query_id, rank, relevant);
    queries without a relevant row do not count."""
    r, gain = F.col("rank"), 1 / F.log2(F.col("rank") + 1)
    per = ranked.groupBy("query_id").agg(
        F.min(F.when(F.col("relevant"), r)).alias("first"), F.count_if("relevant").alias("n"), F.sum(F.when(F.col("relevant") & (r <= k), gain).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = per.where("n > 0").withColumn("ndcg", F.col("dcg") / ideal)
    first = F.col("first")
    return per.agg(
        F.count("*").alias("n_queries"), F.avg((first == 1).cast("double")).alias("precision_at_1"), F.avg(1 / first).alias("mrr"),
        F.avg(F.when(first <= k, 1 / first).otherwise(0.0)).alias("mrr_at_k"), F.avg((first <= k).cast("double")).alias("recall_at_k"), F.avg("ndcg").alias("ndcg_at_k"))


def strict_improvement(base: Column, fine: Column, ceiling: float = 1.0) -> dict[str, Column]:
    """delta, improved, saturated and met of two metric columns."""
    improved, saturated = fine > base, fine >= ceiling - 1e-9
    return {"delta": fine - base, "improved": improved, "saturated": saturated, "met": improved | saturated}


def agreement(df: DataFrame, agree: Column) -> DataFrame:
    """(kind, routing, n, agreement) by grouping sets: overall, by routing and by kind; rows without a verdict drop."""
    rows = df.select("kind", "routing", agree.cast("int").alias("agree")).where("agree is not null")
    sets = rows.groupingSets([[], [F.col("kind")], [F.col("routing")]], F.col("kind"), F.col("routing"))
    return sets.agg(F.count("*").alias("n"), F.avg("agree").alias("agreement"))


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` values per ``row``, 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share) over non-null values; the total is taken over the groups."""
    by = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def largest_errors(df: DataFrame, truth: Column, score: Column, threshold: float, id_: str, n: int = 20) -> DataFrame:
    """The n wrong predictions furthest from the threshold: (id, error, margin)."""
    wrong = df.where((score >= threshold) != truth)
    margin = F.round(F.abs(score - threshold), 6)
    out = wrong.select(F.col(id_).alias("id"), F.when(truth, "false_negative").otherwise("false_positive").alias("error"), margin.alias("margin"))
    return out.orderBy(F.desc("margin"), "id").limit(n)
