"""Sinks: JSON lines, per-document files, dead letters, manifests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine, one of our own where it is unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliospark-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written_once(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: what made it isn't done again for each use, nor after a lost executor."""
    at = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that path, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def json_line(*columns: str | Column) -> Column:
    """One JSON object; null fields are left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An object a line."""
    df.select(json_line(*df.columns).alias("value")).write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_by_document(df: DataFrame, path: str, content: str, document: str = "pdf_name", mode: str = "errorifexists") -> None:
    """Texts in a folder for each document."""
    df.select(document, F.col(content).alias("value")).write.mode(mode).partitionBy(document).text(path)


def write_pages(df: DataFrame, path: str, document: str = "pdf_name", mode: str = "errorifexists") -> None:
    """Page results as JSON in a folder for each document."""
    df.write.mode(mode).partitionBy(document).json(path)


def append_dead_letters(failed: DataFrame, path: str) -> None:
    """Failed pages as tab-separated lines: time, document, page, reason."""
    failed.select("ts", "pdf_name", "page", F.regexp_replace("reason", r"[\t\r\n]+", " ").alias("reason")).write.mode("append").option("sep", "\t").csv(path)


def manifest(wanted: DataFrame, present: DataFrame, key: str = "stem") -> DataFrame:
    """What a subset still has to add: wanted rows whose key isn't there. A manifest stands for links to files."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def dry_run(df: DataFrame) -> DataFrame:
    """How many rows would be written; nothing is."""
    return df.agg(F.count("*").alias("rows"))
