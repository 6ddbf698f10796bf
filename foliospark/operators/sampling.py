"""Reproducible samples, budgets and splits: random order is md5 order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_order
from .ranks import running


#: Hex digits of the md5 order by which rows are counted before any are sorted.
DIGITS = 3


def _counted(rows: DataFrame, amount: Column, *by: str) -> DataFrame:
    """(by, _b, _n, _base): what each bucket of the md5 order (_b) has, and what those before it have: 16^DIGITS rows a
    group at most."""
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*by, "_b").agg(amount.alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def balanced(df: DataFrame, caps: dict[str, int | None], stratum: str, *key: str, seed: int = 42) -> DataFrame:
    """Up to caps[s] rows of each stratum s in md5 order of the key (None: all); other strata are left out.

    A stratum is counted by the first digits of the md5: buckets below the cap are kept whole, and only the one where the
    cap falls is sorted."""
    rows = df.where(F.col(stratum).isin(*[s for s, c in caps.items() if c is None]))
    if capped := {s: c for s, c in caps.items() if c is not None}:
        cap = reduce(lambda e, kv: F.when(F.col(stratum) == kv[0], F.lit(kv[1])).otherwise(e), capped.items(), F.lit(0))
        cut = df.where(F.col(stratum).isin(*capped)).withColumn("_o", stable_order(*key, seed=seed)).withColumn("_b", F.left("_o", F.lit(DIGITS)))
        some = cut.join(_counted(cut, F.count("*"), stratum).where(F.col("_base") < cap), [stratum, "_b"])
        whole = F.col("_base") + F.col("_n") <= cap
        rank = F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_o", *key))
        border = some.where(~whole).withColumn("_r", rank).where(F.col("_base") + F.col("_r") <= cap)
        rows = rows.unionByName(some.where(whole).select(*df.columns)).unionByName(border.select(*df.columns))
    return rows


def to_budget(df: DataFrame, amount: str, target: int, *key: str, by: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """Rows in md5 order until their amounts reach the target; the row that crosses it is kept, empty ones don't count.

    Without groups the order is one: it is cut by the first hex digits of the md5, whose sums are few, so that only the
    rows of one bucket are ordered in one task."""
    rows = df.where(F.col(amount) > 0).withColumn("_o", stable_order(*key, seed=seed)).withColumn("_b", F.left("_o", F.lit(DIGITS)))
    sums = _counted(rows, F.sum(amount), *by).where(F.col("_base") < target).drop("_n")
    rows = rows.join(F.broadcast(sums) if not by else sums, [*by, "_b"])
    before = Window.partitionBy(*by, "_b").orderBy("_o", *key).rowsBetween(Window.unboundedPreceding, -1)
    return rows.where(F.col("_base") < target).withColumn("_before", F.coalesce(F.sum(amount).over(before), F.lit(0))).where(F.col("_base") + F.col("_before") < target).select(*df.columns)


def max_pages(documents: DataFrame, pages: str, most: int, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents in order until their pages reach `most`; a document is never cut, so the sum may be more. Running totals
    are put together from those of chunks, so neither a group nor the table goes through one task."""
    rows = running(documents, pages, list(order), *by)
    return rows.where(F.col("_before") < most).drop("_before")


def first_fitting(df: DataFrame, amount: str, budget: Column, order: list[Column | str], *by: str) -> DataFrame:
    """The rows of each group before the first one that overflows the budget."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_upto", F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_upto") <= budget).drop("_upto")


def split(df: DataFrame, share: float, *key: str, seed: int = 42) -> DataFrame:
    """df with split: val for about `share` of the keys by md5, else train; a share of 0 leaves all in train."""
    bucket = F.conv(F.left(stable_order(*key, seed=seed), F.lit(8)), 16, 10).cast("long") % 10_000
    return df.withColumn("split", F.when(bucket < round(share * 10_000), "val").otherwise("train"))
