"""Readers: page files, JSON lines, logs. Paths are anything Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem
from ..schemas import PAGE_TEST
from .sinks import written_once


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, stem, length) of the files below a folder that match, each once; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", file_stem(F.col("path")).alias("stem"), "length").distinct()


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, stem, content) of the files below a folder that match."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return df.select("path", file_stem(F.col("path")).alias("stem"), "content")


def read_texts(spark: SparkSession, path: str, pattern: str, column: str) -> DataFrame:
    """(path, stem, column): one row for each whole file of a folder that matches. Spark leaves out files of no bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select("path", file_stem(F.col("path")).alias("stem"), F.decode("content", "UTF-8").alias(column))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path, "*.html", "html")


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    return read_texts(spark, path, "*.yaml", "yaml")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(stem, page, source, width, height) of the JSON files beside pages."""
    df = spark.read.schema("page int, source string, width int, height int").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return df.select(file_stem(F.col("_metadata.file_path")).alias("stem"), "page", "source", "width", "height")


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """Page tests from JSON lines; a broken line stops the read."""
    return spark.read.schema(PAGE_TEST).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of text files."""
    return spark.read.text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a log in its order, without empty lines; several files follow one another by path.

    Each split of a file is read by its own task. Lines are written once with the place of their split; how many lines
    the splits before it have, a row for each split, makes their numbers."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    lines = written_once(lines, "log")
    splits = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(splits, ["file", "block"]).select((F.col("place") + F.col("shift")).alias("line_no"), F.col("value").alias("line")).where("line <> ''")
