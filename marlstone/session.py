"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Of repeated keys in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def session(app: str = "marlstone", **more: str) -> SparkSession:
    """A session with the engine's settings; on a cluster the submit command names the master."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
