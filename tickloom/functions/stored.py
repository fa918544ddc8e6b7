"""Steps of a long computation, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder. Without either a local session gets a temporary one;
    a cluster's executors could not read that, so there it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            return kept.get()
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tickloom-")
        context.setCheckpointDir(found)
    return found


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, computed now: all its rows are written to the shared folder and read from there.

    persist() keeps the rows, but every plan built on them still holds the whole plan below, once for each use, and a
    driver analyses all of it: plans of plans grow as the product of their uses. A settled frame is one scan.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
