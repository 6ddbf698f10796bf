"""Pages of documents: linear text, what is left to do, inventory, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lstrip, rstrip


def linearize(pages: DataFrame, doc: str = "pdf_name", page: str = "page", text: str = "natural_text") -> DataFrame:
    """(doc, n_pages, text): the non-empty pages of each document in order. A page follows after one space if the one
    before ends without . ? ! : or a double quote and it begins with an ASCII small letter, else after a blank line."""
    rows = pages.where(F.col(text).isNotNull() & (F.col(text) != ""))
    before = F.lag(text).over(Window.partitionBy(doc).orderBy(page))
    goes_on = ~rstrip(before).rlike("[.?!:\"\\x{201D}]\\z") & lstrip(F.col(text)).rlike("^[a-z]")
    gap = F.when(before.isNull(), "").when(goes_on, " ").otherwise("\n\n")
    rows = rows.select(doc, page, F.concat(gap, F.col(text)).alias("_piece"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page), F.col("_piece")))), lambda x: x["_piece"])
    return rows.groupBy(doc).agg(F.count("*").alias("n_pages"), F.array_join(parts, "").alias("text"))


def document_arrays(results: DataFrame, doc: str = "pdf_name", page: str = "page") -> DataFrame:
    """(doc, pages): one JSON array of each document's page results, by page; an error takes the place of its fields."""
    rest = [c for c in results.columns if c != doc]
    body = F.to_json(F.struct(*rest))
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page), body.alias("_j")))), lambda x: x["_j"])
    return results.groupBy(doc).agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("pages"))


def expected_pages(documents: DataFrame, pages: str = "n_pages") -> DataFrame:
    """A row for each page, 1 to n, of each document; documents of no pages have none."""
    n = F.coalesce(pages, F.lit(0))
    return documents.where(n > 0).withColumn("page", F.explode(F.sequence(F.lit(1), n.cast("int"))))


def todo(expected: DataFrame, *done: DataFrame, key: tuple[str, ...] = ("pdf_name", "page")) -> DataFrame:
    """The expected pages that none of the outputs has."""
    for d in done:
        expected = expected.join(d.select(*key).distinct(), list(key), "left_anti")
    return expected


def inventory(outputs: DataFrame) -> DataFrame:
    """(pages, pdfs): how many pages are there, of how many documents."""
    return outputs.agg(F.count("*").alias("pages"), F.count_distinct("pdf_name").alias("pdfs"))


def page_counters(events: DataFrame, *by: str) -> DataFrame:
    """(by, done, skipped, failed, seconds, fully_skipped) from rows with status (done, skip, fail) and seconds."""
    done, failed = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "fail")
    return events.groupBy(*by).agg(done.alias("done"), F.count_if(F.col("status") == "skip").alias("skipped"), failed.alias("failed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"), ((done == 0) & (failed == 0)).alias("fully_skipped"))


def usage_totals(df: DataFrame, *by: str, free_tokens: int = 28_000) -> DataFrame:
    """Token and cost sums; missing numbers are 0; over_free counts calls of more than `free_tokens` tokens."""
    n = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    return df.groupBy(*by).agg(n("prompt_tokens"), n("completion_tokens"), n("total_tokens"), n("cost"), F.count_if(F.col("total_tokens") > free_tokens).alias("over_free"))


def costs_money(cost: Column) -> Column:
    """Whether a call that should have been free had a price: a run stops on it."""
    return F.coalesce(cost, F.lit(0.0)) > 0


def free_models(catalogue: DataFrame) -> DataFrame:
    """(id, is_free): both prices are 0; a price that is missing or no number is taken as not free."""
    price = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) == 0
    return catalogue.select("id", (price("pricing.prompt") & price("pricing.completion")).alias("is_free"))


def split_errors(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without error, dead letters): a page that failed doesn't stop the others."""
    return results.where("error is null").drop("error"), results.where("error is not null")
