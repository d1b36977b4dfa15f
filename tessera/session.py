"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow; a cluster's own settings (master, memory) are left alone unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    n = cpus or os.cpu_count() or 4
    small = {"spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    return session(master=f"local[{n}]", **(small | conf))
