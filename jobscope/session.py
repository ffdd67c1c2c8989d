"""Sessions with the settings that the operators are meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "jobscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and the RocksDB state store; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    return builder.config(map=settings).getOrCreate()
