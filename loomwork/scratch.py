"""Tables that several steps of a plan read, written once to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder of our own if the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not (found := spark.conf.get("loomwork.scratch.dir", None)):
        found = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("loomwork.scratch.dir", found)
    return found.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; what is left is only scratch
        pass


def kept(df: DataFrame, label: str) -> DataFrame:
    """Writes df and returns a reader of what was written; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)
