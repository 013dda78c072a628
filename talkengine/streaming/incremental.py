"""Incremental scoring of transcript files: a file stream, micro-batches, a budget that rolls on, exactly-once output.

Each micro-batch is labelled by the batch plan of ``operators`` and written under its batch id, so a batch that is
run again after a failure overwrites its own output. What a batch took is written as one row beside the output; the next
batch adds these rows up, so its cost doesn't grow with what was scored before. There is no other state outside the
checkpoint and the output table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scores import two_threshold_label, two_threshold_score
from ..operators.budget import max_calls, spend


def budgeted(rows: DataFrame, allowed: int, top_k: int, llm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds scored_by, llm_score, score and predicted_label to (id, cosine_score): the best rows that the budget covers
    are scored by ``llm`` (DataFrame of id -> id, llm_score)."""
    taken = spend(rows, F.col("cosine_score"), F.lit(top_k), "id", allowed)
    if llm is not None:
        taken = taken.join(llm(taken.where("taken").select("id")), "id", "left")
    else:
        taken = taken.withColumn("llm_score", F.lit(None).cast("double"))
    by = F.when(F.col("taken"), "llm").otherwise("cosine")
    out = taken.withColumn("scored_by", by)
    return out.withColumns({"score": two_threshold_score(F.col("scored_by"), F.col("llm_score"), F.col("cosine_score")), "predicted_label": two_threshold_label(F.col("scored_by"), F.col("llm_score"), F.col("cosine_score"))})


def run(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str, dollars: float = 15.0, cost: float = 0.0001, top_k: int = 10,
        llm: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1) -> None:
    """Scores all files under ``source`` that are new since the last run, then ends; (id, cosine_score, ...) in Parquet."""
    allowed = max_calls(dollars, cost)

    ledger = output.rstrip("/") + "-ledger"

    def one(batch: DataFrame, number: int) -> None:
        done = spark.read.schema("taken long, batch long").parquet(ledger).where(F.col("batch") != number) if _exists(spark, ledger) else None
        spent = (done.agg(F.sum("taken")).first()[0] or 0) * top_k if done is not None else 0  # one row per batch
        budgeted(batch, max(0, allowed - spent), top_k, llm).write.mode("overwrite").parquet(f"{output}/batch={number}")
        made = spark.read.parquet(f"{output}/batch={number}").agg(F.count_if("taken").alias("taken"))
        made.coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def decisions_by_day(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, decision, n) of a decision stream with a watermark for late rows."""
    return stream.withWatermark("decided_at", late).groupBy(F.window("decided_at", "1 day").alias("w"), "decision").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "decision", "n")
