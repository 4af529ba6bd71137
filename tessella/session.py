"""Spark sessions for local work; on a cluster the caller brings their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tessella", *, cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with adaptive execution and settings that suit small data.

    A cluster's own settings are never touched by the library: operators size
    their work from the session they are given.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", driver_memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
