"""The SparkSession of the command line, the tests and the bench."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def get_session(cores: int | str = 8, name: str = "foliospark", **conf: str) -> SparkSession:
    """The session that is configured (spark-submit, spark-defaults), else a local one: AQE on, UTC, and locally as many
    shuffle partitions as cores."""
    builder, given = SparkSession.builder.appName(name), SparkConf()
    if given.get("spark.master") or "spark.master" in conf:
        return builder.config(map={"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf).getOrCreate()
    settings = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    spark = builder.master(f"local[{cores}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
