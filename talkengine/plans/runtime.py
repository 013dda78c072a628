"""Session set-up and the shared folder in which lineage is cut.

An executor may be lost at any time, so intermediate results that are read more than once are written as
compressed Parquet tables into the folder that the cluster names in ``spark.checkpoint.dir``; never into
executor-local storage. Only where that setting is absent (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

APP = "talkengine"
_shipped: set[str] = set()


def session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use.

    On a cluster the caller brings its own session; no operator here depends on these values.
    """
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TALKENGINE_DRIVER_MEMORY", "12g"),
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(APP).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and the
    session runs in one process; a cluster without the setting raises."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("talkengine.shared.dir", None)
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="talkengine-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("talkengine.shared.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority of the file system that Spark resolves it to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once, written to the shared folder and read back: later jobs restart from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application; Spark's own file server carries it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="talkengine-ship-"), f"{root.name}.zip")  # on the driver only
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
