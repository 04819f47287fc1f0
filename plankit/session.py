"""Session factory: adaptive execution on, UTC, shuffle partitions sized to the cores at hand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_spark(app: str = "plankit", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session that spark-submit made."""
    n = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{n}]").appName(app).config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
