"""Tests against texts: one native expression for all that needs no edits, one Arrow search for the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.match import cell_near, exact, formula, in_order, within_edits
from ..functions.text import normalize_text, strip_pdf
from ..schemas import PAGE_TEST

#: A text's normalised form, made once for a page before its tests are joined to it.
NORMAL = "ocr_normal"
#: Column that a type can't do without, and its evaluator of the text and its normalised form; add to it to support another type.
EVALUATORS: dict[str, tuple[tuple[str, ...], Callable[[Column, Column], Column]]] = {
    "text_presence": (("text",), lambda ocr, h: exact(ocr, F.col("text"), h)),
    "text_absence": (("text",), lambda ocr, h: exact(ocr, F.col("text"), h)),
    "table": (("cell",), lambda ocr, h: cell_near(ocr, *[F.col(c) for c in ("cell", "up", "down", "left", "right", "top_heading")], h)),
    "order": (("before", "after"), lambda ocr, h: in_order(ocr, F.col("before"), F.col("after"), h)),
    "math": (("latex",), lambda ocr, h: F.when(F.col("latex").isNotNull(), formula(ocr, F.col("latex")))),
    "formatting": (("text",), lambda ocr, h: exact(ocr, F.col("text"), h)),
}
FUZZY = ("text_presence", "text_absence")


def with_normal(texts: DataFrame, ocr_col: str = "ocr_text") -> DataFrame:
    """texts with NORMAL: do this before a text is repeated for its tests."""
    return texts.withColumn(NORMAL, normalize_text(F.coalesce(F.col(ocr_col), F.lit(""))))


def evaluate(pairs: DataFrame, ocr_col: str = "ocr_text") -> DataFrame:
    """pairs (columns of PAGE_TEST, a text and perhaps its NORMAL form) with passed and error: an unknown type or a
    missing field fails with a message. Presence and absence allow max_diffs edits; the search with edits, in Arrow
    batches of the same one plan branch, gets only what exact search left open."""
    pairs = pairs if NORMAL in pairs.columns else with_normal(pairs, ocr_col)
    ocr, h = F.coalesce(F.col(ocr_col), F.lit("")), F.col(NORMAL)
    known, lacks, native = F.lit(False), F.lit(None).cast("string"), F.lit(False)
    for kind, (needs, rule) in EVALUATORS.items():
        here = F.col("type") == kind
        known = known | F.coalesce(here, F.lit(False))
        for c in needs:
            lacks = F.when(here & F.col(c).isNull(), F.lit(f"missing field: {c}")).otherwise(lacks)
        native = F.when(here, rule(ocr, h)).otherwise(native)
    error = F.when(~known, F.concat(F.lit("Unknown test type: "), F.coalesce("type", F.lit("")))).otherwise(lacks)
    staged = pairs.withColumns({"error": error, "_native": F.coalesce(native, F.lit(False))})
    edits = F.col("type").isin(*FUZZY) & ~F.col("_native") & (F.coalesce("max_diffs", F.lit(0)) > 0) & (F.length(h) > 0)
    # The search gets its texts as columns of their own, null where exact search has decided: rows wait for it without the page's text.
    staged = staged.withColumns({"_text": F.when(edits, h), "_needle": F.when(edits, normalize_text(F.col("text")))})
    searched = F.coalesce(within_edits("_text", "_needle", "max_diffs"), F.col("_native"))
    found = F.when(F.col("_text").isNull(), F.col("_native")).otherwise(searched)
    passed = F.when(F.col("error").isNotNull(), False).when(F.col("type") == "text_absence", ~found).otherwise(found)
    return staged.withColumn("passed", passed).drop("_native", "_text", "_needle", NORMAL)


def join_tests(texts: DataFrame, tests: DataFrame, key: tuple[str, ...] = ("pdf_name", "page"), outer: bool = False) -> DataFrame:
    """Every text of a page with every test of it; tests name their page by pdf and page. With `outer`, a text without
    tests has one row too, and `tested` tells it apart.

    A page's tests meet its texts as one array, so a text travels once, and its normal form is made after that."""
    named = tests.select(*[f.name for f in PAGE_TEST if f.name != "page"], strip_pdf(F.col("pdf")).alias("pdf_name"), F.coalesce("page", F.lit(0)).alias("page"))
    columns = [c for c in named.columns if c not in key]
    arrays = named.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("_tests"))
    rows = with_normal(texts.join(arrays, list(key), "left" if outer else "inner"))
    if outer:
        return rows.select("*", F.col("_tests").isNotNull().alias("tested"), F.inline_outer("_tests")).drop("_tests")
    return rows.select("*", F.inline("_tests")).drop("_tests")


def score(results: DataFrame, *by: str) -> DataFrame:
    """(by, num_passed, num_failed, num_total, score); no tests, no rows."""
    n, ok = F.count("*"), F.count_if("passed")
    return results.groupBy(*by).agg(ok.alias("num_passed"), (n - ok).alias("num_failed"), n.alias("num_total"), F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("score"))


def by_type(results: DataFrame) -> DataFrame:
    """Passed, total and percentage of each type, sorted by type."""
    n, ok = F.count("*"), F.count_if("passed")
    return results.groupBy("type").agg(ok.alias("passed"), n.alias("total"), (F.lit(100.0) * ok / n).alias("pct")).orderBy("type")


def failures(results: DataFrame, n: int = 10) -> DataFrame:
    """The first n failures by id."""
    return results.where("not passed").orderBy("id").limit(n)
