"""Loops cut their lineage by tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where it is unset, a temporary one, which only a local master can share."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="graphloom-work-"))


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{work_dir(df.sparkSession)}/graphloom-plans/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
