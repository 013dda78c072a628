"""Readers and writers of transcripts and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T


def transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of text files, blank lines left out; the line number stays that of the file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "text"))
    return whole.select("file", (F.col("n") + 1).alias("line_no"), T.strip("text").alias("text")).where("text <> ''")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV, JSON or xlsx by suffix."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm"):
        from .xlsx import XlsxSource

        spark.dataSource.register(XlsxSource)
        return spark.read.format("xlsx").load(path)
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "parquet" or "." not in path.rsplit("/", 1)[-1]:
        return spark.read.parquet(path)
    raise ValueError(f"no reader for .{kind}")


def scored_segments(rows: DataFrame, speakers: tuple[str, ...] = ("adult", "child"), least: float = 0.40) -> DataFrame:
    """(file, line_no, child_id, speaker, utterance, confidence) of (file, line_no, cell, speaker): blank, '-' and unsure
    cells drop, a missing confidence does not."""
    r = rows.select("file", "line_no", T.child_of("file").alias("child_id"), F.lower(T.strip("speaker")).alias("speaker"), T.spoken("cell").alias("utterance"), T.confidence_of("cell").alias("confidence"))
    said = F.coalesce(F.col("utterance"), F.lit("")).isin("", "-", "nan")
    return r.where(~said & F.col("speaker").isin(*speakers) & (F.col("confidence").isNull() | (F.col("confidence") >= least)))


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return hadoop, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, keep_backup: bool = False) -> str:
    """Writes beside the path, then swaps by rename, so that a table can be replaced by a query over itself.

    The old version is kept as path.bak-... where asked. Returns the path of the backup, or ''.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    df.write.parquet(f"{path}.new-{mark}")
    hadoop, p, fs = _fs(spark, path)
    backup = f"{path}.bak-{mark}"
    if fs.exists(p):
        fs.rename(p, hadoop.Path(backup))
    fs.rename(hadoop.Path(f"{path}.new-{mark}"), p)
    if not keep_backup:
        fs.delete(hadoop.Path(backup), True)
        return ""
    return backup


def cached_responses(requests: DataFrame, key: str, cache: DataFrame, call, path: str | None = None) -> DataFrame:
    """(requests, response): hits from the cache (key, response), misses by ``call`` (DataFrame of distinct misses ->
    key, response, kind); only responses of kind ok are appended to the cache at ``path``."""
    known = cache.select(key, "response").dropDuplicates([key])
    misses = requests.dropDuplicates([key]).join(known, key, "left_anti")
    from ..plans.runtime import written

    fresh = written(call(misses).select(key, "response", "kind"), "responses")
    if path:
        fresh.where("kind = 'ok'").select(key, "response").write.mode("append").parquet(path)
    answers = known.unionByName(fresh.select(key, "response"))
    return requests.join(answers, key, "left")


def write_by_folder(df: DataFrame, path: str, folder: str, file: str, order: list[str]) -> None:
    """One directory per folder and source file, rows in the order given."""
    df.repartition(folder, file).sortWithinPartitions(folder, file, *order).write.mode("append").option("header", True).partitionBy(folder, file).csv(path)
