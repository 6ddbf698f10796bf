"""Queries that SQL can't say, against plain Python over the whole table."""

from __future__ import annotations

import random
import re

import pytest
import yaml
from foliospark.functions import sentences, text
from foliospark.functions.match import edit_distance, fuzzy_contains, sellers
from foliospark.operators import evaluate, search
from foliospark.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def least_distance(needle: str, hay: str) -> int:
    """The least edit distance of the needle to a substring of at least one character."""
    row = [0] * (len(hay) + 1)
    for i, c in enumerate(needle, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(hay, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row[1:], default=len(needle) + 1)


def test_finder_against_distances():
    rng = random.Random(4)
    for k in (0, 1, 3):
        needles = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(25)]
        find = search.Finder(needles, k)
        for _ in range(40):
            hay = "".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))
            want = {x for x, n in enumerate(needles) if (n in hay if not k else hay and (len(n) <= k or least_distance(n, hay) <= k))}
            assert find(hay) == want


@pytest.fixture(scope="module")
def normal(spark):
    """(normalised documents by id, normalised benchmark items by id)."""
    read = lambda t, i: {r[0]: r[1] for r in spark.read.parquet(f"{SF}/{t}.parquet").select(i, text.normalize_text(F.col("text"))).collect() if r[1] is not None}
    return read("documents", "doc_id"), read("benchmark", "item_id")


def test_presence_fuzzy_over_the_whole_table(spark, normal):
    docs, items = normal
    got = {tuple(r) for r in catalogue.presence_fuzzy(spark, SF).collect()}
    exact = {(d, i) for d, h in docs.items() for i, n in items.items() if n in h}
    assert exact <= got and {tuple(r) for r in catalogue.presence_exact(spark, SF).collect()} == exact
    # A text within four edits of a needle holds one of any five pieces of it, wherever they are cut.
    near = {(d, i) for d, h in docs.items() for i, n in items.items() if h and any(n[a : a + len(n) // 5] in h for a in range(0, len(n) // 5 * 5, len(n) // 5))}
    assert got == {(d, i) for d, i in near if sellers(docs[d], items[i], 4)}


def test_sellers_is_the_least_distance():
    rng = random.Random(9)
    for _ in range(300):
        n, h = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))) for _ in range(2))
        k = rng.randint(0, 5)
        assert sellers(h, n, k) == (len(n) <= k or least_distance(n, h) <= k)


def test_no_nested_loops_and_one_parse(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for name in ("presence_exact", "presence_fuzzy", "eval_dispatch"):
        assert "NestedLoop" not in plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    # Pages are parsed when they are written; the six families read that table.
    assert "MapInArrow" not in plan(catalogue.gen_tests(spark, "/root/testdata/sf0.001"))
    assert "ArrowEvalPython" not in plan(catalogue.gen_tests(spark, "/root/testdata/sf0.001"))


def test_fuzzy_contains_and_distance(spark):
    rows = [("hello world", "helo", 1), ("hello world", "helo", 0), ("", "a", 3), ("abc", "", 0), (None, "a", 1), ("abc", "xbz", 1)]
    df = spark.createDataFrame(rows, "t string, n string, k int")
    got = df.select(fuzzy_contains(F.col("t"), F.col("n"), F.col("k")), edit_distance("t", "n")).collect()
    assert [r[0] for r in got] == [True, False, False, True, None, False] and [r[1] for r in got][:3] == [7, 7, 1]


def test_evaluation_with_edits_in_one_branch(spark):
    kinds = "id string, type string, text string, max_diffs int, cell string, up string, down string, left string, right string, top_heading string, before string, after string, latex string, ocr_text string"
    none = [None] * 9
    rows = [("a", "text_presence", "hello wurld", 1, *none, "Hello  world"), ("b", "text_presence", "hello wurld", 0, *none, "Hello world"), ("c", "text_absence", "hello wurld", 1, *none, "Hello world"), ("d", "text_absence", "nothing", 2, *none, "Hello world"), ("e", "text_presence", "x", 3, *none, None), ("f", "formatting", "hello", None, *none, "Hello"), ("g", "text_presence", None, 1, *none, "x"), ("h", None, "x", 1, *none, "x")]
    got = {r.id: (r.passed, r.error) for r in evaluate.evaluate(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"a": (True, None), "b": (False, None), "c": (False, None), "d": (True, None), "e": (False, None), "f": (True, None), "g": (False, "missing field: text"), "h": (False, "Unknown test type: ")}


def by_placeholders(x: str) -> list[str]:
    """Abbreviations one after the other, then initials, then `p.` before a number, become words; then the text is cut."""
    for n, a in enumerate(sentences.ABBREVIATIONS):
        x = x.replace(a, f"<{n}>")
    x = re.sub(r"(^|[\s\"'(,])([A-Z])\.", r"\1<i\2>", x)
    x = re.sub(r"(?<!\w)p\.(\s*)(?=\d)", r"<p>\1", x)
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z\"(])", x)
    names = {f"<{n}>": a for n, a in enumerate(sentences.ABBREVIATIONS)} | {"<p>": "p."}
    back = [re.sub(r"<i([A-Z])>", r"\1.", re.sub(r"<(?:\d+|p)>", lambda m: names[m[0]], y)).strip() for y in parts]
    return [y for y in back if y]


def test_sentences_are_those_of_placeholders(spark):
    rng = random.Random(6)
    bits = [*sentences.ABBREVIATIONS, "Mr", ". ", " ", "x", "e.", "g.", "Rev.", "Conv.", "A.", "\n", "p. 3", "! ", "Word", '"So', "(B. "]
    texts = ["z" + "".join(rng.choice(bits) for _ in range(14)) for _ in range(1500)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sentences.split_sentences(F.col("t"))).collect()]
    assert got == [by_placeholders(t) for t in texts]


def test_translation_records_over_the_whole_table(spark):
    got = {r.document_id: r for r in catalogue.translation_record(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").cast("string"), catalogue._yaml()).collect()
    assert len(got) == len(pages)
    for i, raw in pages:
        try:
            record = yaml.safe_load(raw) if raw else None
        except yaml.YAMLError:
            continue  # the line scanner has tests of its own
        if isinstance(record, dict):
            assert got[i].error is None and got[i].is_table == record["is_table"]
            assert str(got[i].primary_language) in (str(record["primary_language"]), "en", "no")
