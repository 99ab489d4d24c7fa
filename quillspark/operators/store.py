"""Tables that are made once and read again: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder all executors share: under spark.checkpoint.dir, or a temporary one for one local process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="quillspark-")
    return f"{base.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written and read back."""
    path = folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
