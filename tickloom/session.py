"""Session factory: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "tickloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with what the operators count on; cluster settings stay the caller's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    held = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        held["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=held | conf).getOrCreate()


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they start; a cluster installs it or gets it as a file."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark
