"""Progress logs and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the lines of a progress log look like.
STAMP = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\]"
START = "=== YAML SESSION START ==="


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with schemas.LOG_EVENT: kind is done, skip, fail, pdf_start, pdf_done, start, or null for other lines."""
    c = F.col(line)
    part = lambda p, i=1: F.nullif(F.regexp_extract(c, p, i), F.lit(""))
    kind = F.when(F.contains(c, F.lit("[DONE ]")), "done").when(F.contains(c, F.lit("[SKIP ]")), "skip").when(F.contains(c, F.lit("[FAIL ]")), "fail").when(F.contains(c, F.lit("[PDF START]")), "pdf_start").when(F.contains(c, F.lit("[PDF DONE ]")), "pdf_done").when(F.contains(c, F.lit(START)), "start")
    page = r"\[(?:DONE |SKIP |FAIL )\] (.+) page (\d+)"
    return lines.select(
        "*",
        F.try_to_timestamp(part(STAMP), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"),
        kind.alias("kind"),
        part(page).alias("pdf_name"),
        part(page, 2).try_cast("int").alias("page"),
        part(r"\[DONE \].*?(\d+) chars").try_cast("int").alias("chars"),
        part(r"\[DONE \].*?(\d+\.\d+)s\b").try_cast("double").alias("seconds"),
        part(r"prompt=(\d+)").try_cast("int").alias("prompt"),
        part(r"completion=(\d+)").try_cast("int").alias("completion"),
        part(r"total=(\d+)").try_cast("int").alias("total"),
        part(r"provider=(\S+)").alias("provider"),
    )


def last_session(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The lines from the last session start on."""
    start = log.where("kind = 'start'").agg(F.max(order).alias("_s"))
    return log.crossJoin(F.broadcast(start)).where(F.col(order) >= F.col("_s")).drop("_s")  # one row


def session_stats(log: DataFrame, order: str = "line_no", last: int = 10) -> DataFrame:
    """One row for the last session: done, failed, skipped, the mean seconds and (floored) tokens of the last pages, last_done."""
    rows = last_session(log, order)
    timed = F.col("seconds").isNotNull() & F.col("completion").isNotNull() & F.col("total").isNotNull() & (F.col("kind") == "done")
    recent = rows.where(timed).orderBy(F.desc(order)).limit(last).agg(F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("avg_seconds"), F.coalesce(F.floor(F.sum("total") / F.count("*")), F.lit(0)).alias("avg_tokens"))
    counts = rows.agg(F.count_if(F.col("kind") == "done").alias("done"), F.count_if(F.col("kind") == "fail").alias("failed"), F.count_if(F.col("kind") == "skip").alias("skipped"), F.max(F.when(F.col("kind") == "done", F.col("ts"))).alias("last_done"))
    return counts.crossJoin(recent)  # one row each


def speed(done: Column, minutes: Column) -> Column:
    """Pages a minute; 0 if no time has passed."""
    return F.when(minutes > 0, done / minutes).otherwise(0.0)


def coverage(expected: DataFrame, done: DataFrame, folder: str = "folder", key: tuple[str, ...] = ("pdf_name", "page")) -> DataFrame:
    """(folder, total, done, remaining, coverage_pct) for each folder and for all of them (TOTAL)."""
    rows = expected.join(done.select(*key).distinct().withColumn("_done", F.lit(1)), list(key), "left")
    out = rows.rollup(folder).agg(F.count("*").alias("total"), F.count("_done").alias("done"), F.grouping(folder).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(folder)).alias(folder), "total", "done", (F.col("total") - F.col("done")).alias("remaining"), F.try_divide(F.lit(100.0) * F.col("done"), F.col("total")).alias("coverage_pct"))


def eta_hours(remaining: Column, per_minute: Column) -> Column:
    """Hours left; infinite at no speed."""
    return F.when(per_minute > 0, remaining / (per_minute * 60)).otherwise(F.lit(float("inf")))


def last_values(df: DataFrame, order: str, n: int, *by: str) -> DataFrame:
    """The last n rows of each group."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")
