"""Session builder with the settings every plan in this package assumes."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "meterflow", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; shuffle partitions follow the cores in local mode.

    On a cluster pass no ``master``: spark-submit's settings hold and only unset keys are filled in.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        cores = master.removeprefix("local[").removesuffix("]")
        partitions = cores if cores.isdigit() else str(os.cpu_count() or 8)
        conf = {"spark.sql.shuffle.partitions": partitions, "spark.ui.enabled": "false", "spark.driver.memory": "8g"} | conf
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # 153 generated feature columns must still be compiled
        "spark.sql.codegen.maxFields": "300",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
