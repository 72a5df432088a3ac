"""Session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestat", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything else as the cluster has it. On one machine, where nothing says how many, a shuffle partition for each core."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    given = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"} | conf
    spark = builder.config(map=given).getOrCreate()
    parts = "spark.sql.shuffle.partitions"
    if spark.sparkContext.master.startswith("local") and parts not in given and not spark.sparkContext.getConf().contains(parts):
        spark.conf.set(parts, str(spark.sparkContext.defaultParallelism))
    return spark
