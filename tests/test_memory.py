"""Batches of texts are worked off in pieces: a task's memory doesn't grow with the rows of a batch."""

from __future__ import annotations

import gc

import pyarrow as pa
from foliospark.functions import html, text, yamlio
from foliospark.operators import rewards
from foliospark.schemas import PAGE_TEST
from pyspark.sql import functions as F


def test_answers_are_parsed_in_pieces():
    """Records come in pieces of bounded size, one for each text, in order; long texts by themselves."""
    record = "primary_language: {}\nis_table: true\nnatural_text: |\n  {}"
    texts = [record.format("en", "x" * 10_000)] * 400 + [None, "", record.format("no", "y" * (3 << 20)), "- a list"]
    got = list(yamlio.parse_yaml_page.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert sum(map(len, got)) == len(texts)
    assert max(sum(len(x["natural_text"].as_py() or "") for x in piece) for piece in got) < 5 << 20
    rows = [x for piece in got for x in piece.to_pylist()]
    assert [r["primary_language"] for r in rows] == ["en"] * 400 + [None, None, "no", None]
    assert [r["error"] for r in rows[400:]] == ["empty page", "empty page", None, "not a record"]
    assert len(got) >= 4


def test_pages_are_handed_on_in_pieces():
    """Unclosed paragraphs nest, so what is taken from a page may be many times the page; pieces are bounded by that."""
    page = "<html lang='de'><body>" + "".join(f"<p>paragraph {i} of a page" for i in range(200)) + "</body></html>"
    htmls = [page] * 100 + [None]
    got = list(html._pieces(pa.array(htmls), html.page_of))
    assert [x for _, pages in got for x in pages] == [html.page_of(h) for h in htmls]
    assert [at for at, _ in got] == [sum(len(p) for _, p in got[:k]) for k in range(len(got))]
    assert max(sum(len(n["text"]) for x in pages for n in x["nodes"]) for _, pages in got) < 2 << 20


def test_trees_go_without_the_collector():
    gc.collect()
    gc.disable()
    try:
        html.page_of("<body><div><p>one<p>two</div><aside><b>x</b></aside></body>")
        assert not any(isinstance(x, html.Node) for x in gc.get_objects())
    finally:
        gc.enable()


def test_parts_are_those_of_the_whole():
    page = "<html lang='de'><body><header>top</header><h2>Head</h2><p>some <b>bold</b> text<table><tr><td>a<td>b</tr></table><math>x</math><aside>y</aside></body></html>"
    whole = html.page_of(page)
    for k in whole:
        assert html.page_of(page, parts=(k,)) == {k: whole[k]}
    assert html.page_of(page, parts=("nodes",), tags=frozenset(("b",)))["nodes"] == [n for n in whole["nodes"] if n["tag"] == "b"]


def test_tests_meet_a_completion_once(spark):
    """One join of answers with their page's tests, and no second one for answers without any."""
    answers = spark.createDataFrame([("d", 1, 0, "alpha")], "pdf_name string, page int, gen_id int, text string")
    plan = rewards.completion_rewards(answers, spark.createDataFrame([], PAGE_TEST))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_runs_of_white_space_in_all_code_points(spark):
    """The normal form is Python's of every character that there is."""
    texts = ["".join(f"A{chr(c)}b  {chr(c)} " for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in [*range(0, 0x4000, 4096), 0xD000, 0xE000, 0x1F000]]
    letters = "".join(c for c in texts[0] if ord(c) < 128 and c.isascii())
    rows = spark.createDataFrame([(letters,), *[(t,) for t in texts]], "t string").select("t", text.normalize_text(F.col("t")).alias("n"), F.lower("t").alias("l"))
    for r in rows.collect():
        assert r.n == " ".join(r.l.split())


def test_rows_wait_for_the_search_without_the_page(spark):
    """Only texts that the search needs are on its way."""
    tests = spark.createDataFrame([tuple({"id": "1", "type": "text_presence", "pdf": "d.pdf", "page": 1, "text": "alpha", "max_diffs": 1}.get(f.name) for f in PAGE_TEST)], PAGE_TEST)
    answers = spark.createDataFrame([("d", 1, 0, "alpha")], "pdf_name string, page int, gen_id int, text string")
    plan = rewards.completion_rewards(answers, tests)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("ArrowEvalPython") :].splitlines()[1]
    assert "ocr_normal" not in below.split("AS _text")[0].rsplit("CASE WHEN", 1)[0] and "ocr_text" not in below.split(",")[0]
