"""Sessions with the settings that the engine's plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "sparkloom", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.  On a cluster leave ``master`` and ``partitions`` to the submitter."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("SPARKLOOM_MEMORY", "8g")).config("spark.ui.enabled", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**fixed, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
