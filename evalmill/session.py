"""SparkSession with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Results depend on the first two; the rest lets Spark re-plan joins and skewed partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "evalmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session; ``extra``: further settings with dots written as two underscores."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()
