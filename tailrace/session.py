"""Session settings that every operator relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC everywhere, runtime re-planning, Arrow for the few Python stages, later map keys win.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(cores: str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | extra
    return SparkSession.builder.master(f"local[{cores}]").appName("tailrace").config(map=conf).getOrCreate()
