"""Session defaults shared by tests, bench and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "tidemark", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution; on a cluster the submitted settings win."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.appName(name)
    if "SPARK_MASTER" not in os.environ and "spark.master" not in conf:
        builder = builder.master(f"local[{cpus}]")
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
