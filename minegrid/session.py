"""Session settings every plan in this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "minegrid", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave them out and let
    spark-submit decide.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
