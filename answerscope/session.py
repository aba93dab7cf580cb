"""Session with the settings that the engine's semantics need (UTC, Arrow) and AQE on."""

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "answerscope", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.parquet.compression.codec": "zstd", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536"}.items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
