"""A session with the settings that the engine expects; on a cluster, set the same in its configuration."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """The running session, or a new one. In local mode shuffles have as many partitions as cores."""
    builder = SparkSession.builder.appName("oratorio").config(map=SETTINGS | more)
    if master:
        cores = master.partition("[")[2].rstrip("]")
        n = int(cores) if cores.isdigit() else os.cpu_count() or 8
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", more.get("spark.driver.memory", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
