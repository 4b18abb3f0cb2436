"""Sessions with the settings that the engine counts on."""

from pyspark.sql import SparkSession


def session(name: str = "foliolake", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC times; ``conf`` overrides, with _ for dots."""
    own = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(name).config(map=own | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
