"""The engine's functions and operators against plain Python, on hand-made edge rows; plans; streams as batches."""

from __future__ import annotations

import random
import re
import textwrap

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import geometry, html, match, sentences, tables, text, yamlio
from foliospark.operators import datasets, evaluate, layout, pages, progress, rewards, sampling, search, testgen, translation
from foliospark.sources import providers, readers, sinks
from foliospark.streaming import jobs


def one(spark, column, **values):
    """The value of a column over literal columns."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# Text


def test_page_key(spark):
    rows = spark.createDataFrame([("a_page_1_page_2",), ("x",), ("_page_3",), ("a_page_b",), (None,)], "s string")
    got = [r.k and tuple(r.k) for r in rows.select(text.page_key(F.col("s")).alias("k")).collect()]
    assert got == [("a_page_1", 2), None, None, None, None]
    assert tuple(rows.select(text.page_key(F.col("s"), True).alias("k")).collect()[1].k) == ("x", 1)


@pytest.mark.parametrize("raw", ["", "  A\t\n b 　 C\xa0", "\x1cX\x85 y ", "Straße  É", "\x0b\x0c"])
def test_normalize(spark, raw):
    assert one(spark, text.normalize_text(F.col("t")), t=raw) == re.sub(r"\s+", " ", raw.lower().strip())
    assert one(spark, text.squeeze(F.col("t")), t=raw) == re.sub(r"\s+", "", raw).lower()


def plain_clean(t: str, most: int = 250) -> str:
    t = t.strip()
    for a, b in (("[", "\\["), ("]", "\\]"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        t = t.replace(a, b)
    if len(t) > most:
        half = most // 2 - 3
        t = f"{t[:half].rsplit(' ', 1)[0] or t[:half]} ... {t[-half:].split(' ', 1)[-1] or t[-half:]}"
    return t


def test_clean_anchor(spark):
    rng = random.Random(1)
    cases = ["", " [a]\n\tb ", "x" * 400, " ".join("w" * rng.randint(1, 30) for _ in range(80)), " " + "y" * 200 + " " + "z" * 200, "a" + " " * 300 + "b"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in rows.select("i", text.clean_anchor(F.col("t")).alias("x")).collect()}
    assert got == {i: plain_clean(c) for i, c in enumerate(cases)}


def test_small_text_functions(spark):
    assert one(spark, text.detect_script(F.col("t")), t="ক" * 2 + "x" * 8) == "bn" and one(spark, text.detect_script(F.col("t")), t="क" + "x" * 9) == "en"
    assert one(spark, text.strip_pdf(F.col("t")), t="a.pdf.PDF") == "a.pdf" and one(spark, text.doc_tag(F.col("t")), t="a~b~c") == "c"
    assert one(spark, text.allowed_diffs(F.col("t")), t="x" * 200) == 4 and one(spark, text.allowed_diffs(F.col("t")), t="x") == 3
    head = "Page dimensions: 612.0x792.0\n"
    assert one(spark, text.scanned_page(F.col("t")), t=head + "ab") and not one(spark, text.scanned_page(F.col("t"), False), t=head + "ab")


# Sentences and tables


def test_sentences(spark):
    cases = {
        "One. Two! Three? (Four) end": ["One.", "Two!", "Three?", "(Four) end"],
        "By P. G. Rao (A. B. case). Next": ["By P. G. Rao (A. B. case).", "Next"],
        "See No. 5 vs. Mr. X. The end": ["See No. 5 vs. Mr. X. The end"],
        "See p. 12. It ends. lower": ["See p. 12.", "It ends. lower"],
        "the latest. Then more": ["the latest. Then more"],
        "Yes. Mr. X came": ["Yes. Mr. X came"],
        "e.g. This. \"Quoted\" x": ["e.g. This.", "\"Quoted\" x"],
        " NULL ": [], "": [], " \n ": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in rows.select("t", sentences.split_sentences(F.col("t")).alias("s")).collect()}
    assert got == cases
    assert one(spark, sentences.split_sentences(F.col("t")), t=None) == []
    assert [tuple(x) for x in one(spark, sentences.numbered(F.col("t")), t="A b. C d")] == [(1, "A b."), (2, "C d")]


def test_tables(spark):
    t = "Before\n| a | b |\n|---|---|\n| 1 | |\n|| 2 |\nAfter\n| x |\n|---|\n|---|\nend"
    got = one(spark, tables.markdown_tables(F.col("t")), t=t)
    assert [(x.table_id, x.headers, x.rows) for x in got] == [(1, ["a", "b"], [["1", ""], ["2"]])]
    assert one(spark, tables.without_tables(F.col("t")), t=t) == "Before\nAfter\n| x |\n|---|\n|---|\nend"
    assert one(spark, tables.text_to_html(F.col("t")), t="a & b\nc  d\n\n| h |\n|---|\n| <i> |") == "<p>a &amp; b c d</p>\n<table>\n  <tr><th>h</th></tr>\n  <tr><td><i></td></tr>\n</table>"
    assert one(spark, tables.text_to_html(F.col("t")), t="null") == "<p><em>(No text content)</em></p>"
    assert one(spark, tables.table_to_html(F.col("t")), t="| one |") == "<p>| one |</p>"


def test_sentences_to_html(spark):
    s = F.array(F.struct(F.lit(1).alias("id"), F.lit("a <b>\n\nc\nd").alias("text")))
    t = F.array(F.struct(F.lit(1).alias("table_id"), F.array(F.lit("h")).alias("headers"), F.array(F.array(F.lit("x"))).alias("rows")))
    assert one(spark, tables.sentences_to_html(s, t)) == "<p>a &lt;b&gt;</p>\n<p>c d</p>\n<table>\n  <tr><th>h</th></tr>\n  <tr><td>x</td></tr>\n</table>"


# HTML

PAGE = """<!DOCTYPE html><html lang="DE-at"><head><style>p{}</style></head><body><header>Top of the page</header>
<div class="main-col x"><!-- note --><h1>A title here</h1><p>Hello <b>big</b> world &amp; more<p>Second paragraph that is long enough<br>for it</p></p>
<table><tr><th>K</th><th>V</th></tr><tr><td>k1</td><td>v|1</td></tr><tr><td>k2</td></tr></table>
<span>tail \\( x^2 + 1 \\) and $$ y = 3 $$</span><em>some italics</em><math>a+b=c</math><i class="katex-html">z = 1</i></div>
<aside>In the margin</aside><footer>Page 1 of 9</footer></body></html>"""


def test_tree_rules():
    root = html.parse("<p>a<p>b</div></p>c<br/>d<script>no</script><!-- x --><b>e")
    outer = next(root.walk())
    assert outer.text() == "abcde" and [x.tag for x in root.walk()] == ["p", "p", "br", "script", "b"]
    assert html.parse("<p>Hello <b>big</b> world</p>").text() == "Hellobigworld"
    assert html.parse(None).text() == "" and html.page_of("")["main_html"] == ""
    deep = html.parse("<div>" * 3000 + "x")
    assert deep.text() == "x" and deep.markup().count("<div>") == 3000


def test_page_parts():
    p = html.page_of(PAGE)
    assert p["lang"] == "de" and not p["is_table"] and not p["is_diagram"]
    assert "A title here" in p["main_html"] and "note" not in p["main_html"] and "Top of" not in p["main_html"]
    assert "| K | V |\n| --- | --- |\n| k1 | v\\|1 |\n| k2 |" in p["main_markdown"] and "<table><tr><th>K</th>" in p["main_html"]
    assert "note" in html.page_of(PAGE, comments=True)["main_html"]
    assert html.page_of("<html><body><table><tr><td>" + "x" * 90 + "</td></tr></table>y</body></html>")["is_table"]
    assert html.page_of("<body><img src=a>few</body>")["is_diagram"]


def test_generated_tests(spark):
    df = html.parse_pages(spark.createDataFrame([("d", 1, PAGE), ("e", 2, ""), ("f", 3, None)], "pdf_name string, page int, html string"))
    got = testgen.page_tests(df).collect()
    assert testgen.page_tests(df).schema.simpleString() == schemas.PAGE_TEST.simpleString() and len({r.id for r in got}) == len(got)
    kinds = {k: [r for r in got if r.type == k] for k in {r.type for r in got}}
    assert sorted(r.text for r in kinds["text_absence"]) == ["In the margin", "Page 1 of 9", "Top of the page"]
    assert {r.latex for r in kinds["math"]} == {"a+b=c", "z = 1", "x^2 + 1", "y = 3"}
    assert all(r.max_diffs == max(3, len(r.text) // 50) and len(r.text) >= 15 for r in kinds["text_presence"])
    cell = {r.cell: r for r in kinds["table"]}
    assert cell["k1"].top_heading == "K" and cell["k1"].right == "v|1" and cell["k1"].down == "k2" and cell["k2"].right is None
    assert {r.format_type for r in kinds["formatting"]} == {"bold", "italic", "heading_h1"} and len(kinds["order"]) >= 1
    ocr = df.select("pdf_name", "page", F.col("page_parts.main_html").alias("ocr_text"))
    done = evaluate.evaluate(evaluate.join_tests(ocr, testgen.page_tests(df)))
    assert done.where("type = 'text_absence' and not passed").count() == 0  # what is around the main column stays out
    assert sorted(map(tuple, testgen.page_tests(df).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_html_functions(spark):
    assert one(spark, html.html_of_completion(F.col("t")), t="x ```html\n <p>a</p> \n``` y") == "<p>a</p>"
    assert one(spark, html.html_of_completion(F.col("t")), t="```\nno tags\n```") is None and one(spark, html.html_of_completion(F.col("t")), t="```\n<b>\n```") == "<b>"
    for page, before in (("<head></head><body>", "</head>"), ("x<body a>", "<body a>"), ("plain", None)):
        got = one(spark, html.inject_viewport(F.col("t"), F.lit(1000)), t=page)
        assert "width: 1000px" in got and "min-height: 1414px" in got
        assert got.replace(one(spark, html.viewport_css(F.lit(1000))), "") == (page if before else "<html><head></head>\nplain")
    assert '<html lang="bn">' in one(spark, html.page_document(F.lit("<p>" + "ক" * 9 + "</p>"), F.lit("en")))


# YAML


def test_yaml_round_trip(spark):
    body = "First line\n\n   \n  indented: yes\nlast"
    y = one(spark, yamlio.format_yaml(F.col("t"), F.lit("no"), F.lit(True), F.lit(False), document_id=F.lit("d~1")), t=body)
    assert y.endswith("natural_text: |\n" + textwrap.indent(body, "  ")) and y.startswith("document_id: d~1\nprimary_language: no\n")
    rows = spark.createDataFrame([(1, y), (2, "just a string"), (3, None), (4, "primary_language: en\nis_table: false\nbad: [\nnatural_text: |\n  a\n  b\n"), (5, "natural_text: null")], "i int, y string")
    got = {r.i: r.p for r in rows.select("i", yamlio.parse_yaml_page("y").alias("p")).collect()}
    assert got[1].primary_language == "no" and got[1].is_table is True and got[1].natural_text.startswith("First line")
    assert got[2].error == "not a record" and got[3].error == "empty page"
    assert got[4].natural_text == "a\nb" and got[4].is_table is False and got[5].natural_text is None and got[5].error is None
    answers = spark.createDataFrame([(1, f"ok\n```yaml\n{y}\n```"), (2, "words: [")], "i int, y string")
    got = {r.i: r.p for r in answers.select("i", yamlio.parse_response("y").alias("p")).collect()}
    assert got[1].primary_language == "no" and got[2].natural_text == "words: [" and got[2].is_rotation_valid


def test_yaml_cutting(spark):
    assert one(spark, yamlio.natural_text_of(F.col("t")), t="a: 1\nnatural_text: |\n  x\n    y\n\n  z\nb: 2") == "x\n  y\n\nz"
    assert one(spark, yamlio.natural_text_of(F.col("t")), t=" plain ") == "plain"
    assert one(spark, yamlio.yaml_of_completion(F.col("t")), t="<think>\nprimary_language: q</think>so\nprimary_language: en\nnatural_text: |\n  x\n```") == "primary_language: en\nnatural_text: |\n  x"
    assert one(spark, yamlio.yaml_of_completion(F.col("t")), t="```yaml\nnatural_text: a\n```") == "natural_text: a"
    assert one(spark, yamlio.yaml_of_completion(F.col("t")), t="no") is None


# Matching


def window_search(h: str, n: str, k: int) -> bool:
    def d(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    if n in h:
        return True
    return k > 0 and any(d(h[i : i + w], n) <= k for w in range(max(1, len(n) - k), len(n) + k + 1) for i in range(len(h) - w + 1))


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", max_size=14), st.text("abc ", max_size=7), st.integers(1, 4))
def test_bounded_search_equals_windows(h, n, k):
    assert (n in h or match.sellers(h, n, k)) == window_search(h, n, k)


def test_evaluate(spark):
    base = {f.name: None for f in schemas.PAGE_TEST}
    made = [
        ("p1", dict(type="text_presence", text="HELLO  wurld", max_diffs=1), True), ("p2", dict(type="text_presence", text="hello wurld"), False), ("p3", dict(type="text_presence", text=None), False),
        ("a1", dict(type="text_absence", text="nothing"), True), ("a2", dict(type="text_absence", text=""), False), ("t1", dict(type="table", cell="b", left="a", down="c"), True),
        ("t2", dict(type="table", cell="a", left="b"), False), ("o1", dict(type="order", before="a", after="c"), True), ("o2", dict(type="order", before="c", after="a"), False),
        ("o3", dict(type="order", before="a", after="a"), False), ("m1", dict(type="math", latex="X ^ 2"), True), ("f1", dict(type="formatting", text=""), True), ("u1", dict(type="odd"), False), ("n1", dict(type=None), False),
    ]
    rows = spark.createDataFrame([tuple({**base, "id": i, "pdf": "d.pdf", "page": 1, **x}.values()) for i, x, _ in made], schemas.PAGE_TEST).withColumn("ocr_text", F.lit("| a | b |\n| c |\nHello world x^2"))
    got = {r.id: r for r in evaluate.evaluate(rows).collect()}
    assert {i: got[i].passed for i in got} == {i: p for i, _, p in made}
    assert got["u1"].error == "Unknown test type: odd" and got["p3"].error == "missing field: text"
    s = evaluate.score(evaluate.evaluate(rows), "pdf").first()
    assert (s.num_passed, s.num_failed, s.num_total) == (6, 8, 14) and s.score == 6 / 14
    assert evaluate.failures(evaluate.evaluate(rows), 2).count() == 2


def test_native_tests_run_without_python(spark):
    rows = spark.createDataFrame([], schemas.PAGE_TEST).withColumn("ocr_text", F.lit("x"))
    plan = evaluate.evaluate(rows.where("type = 'order'"))._jdf.queryExecution().optimizedPlan().toString()
    assert "cartesian" not in plan.lower()
    native = rows.select(match.in_order(F.col("ocr_text"), F.col("before"), F.col("after")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in native


def test_find_needles(spark):
    docs = spark.createDataFrame([(1, "The quick  brown fox jumps"), (2, "the quikc brown fox"), (3, ""), (4, None)], "doc_id int, text string")
    needles = spark.createDataFrame([(7, "quick brown fox"), (8, None)], "item_id int, text string")
    assert [tuple(r) for r in search.find_needles(docs, needles).collect()] == [(1, 7)]
    assert sorted(tuple(r) for r in search.find_needles(docs, needles, max_diffs=2).collect()) == [(1, 7), (2, 7)]


# Rewards


def test_rewards(spark):
    rows = spark.createDataFrame([(1, "table", True), (1, "formatting", False), (1, "new", True), (2, "order", None), (3, "math", False)], "g int, type string, passed boolean")
    get = lambda s, **k: {r.g: r.reward for r in rewards.rewards(rows, "g", strategy=s, **k).collect()}
    assert get("binary") == {1: 0.0, 2: 1.0, 3: 0.0} and get("proportional") == {1: 2 / 3, 2: 0.0, 3: 0.0}
    assert get("weighted") == {1: 3 / 3.5, 2: 0.0, 3: 0.0} and get("weighted", weights={"table": 7.0})[1] == 8 / 9
    with pytest.raises(ValueError, match="unknown reward strategy"):
        rewards.rewards(rows, "g", strategy="x")
    adv = rewards.advantages(spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (2, 0, 0.5), (2, 1, 0.5)], "p int, gen_id int, reward double"), "p")
    assert sorted((r.p, r.advantage) for r in adv.collect()) == [(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    assert rewards.without_zero(adv).count() == 2 and rewards.step_metrics(adv, "p").where("p = 1").first().rewards == [0.0, 1.0]


# Pages, samples, data sets, logs


def test_linearize(spark):
    rows = [("a", 2, "goes on. "), ("a", 1, "It"), ("a", 3, "new"), ("a", 4, None), ("a", 5, "it said:"), ("a", 6, "x"), ("b", 1, "")]
    got = {r.pdf_name: r for r in pages.linearize(spark.createDataFrame(rows, "pdf_name string, page int, natural_text string")).collect()}
    assert got["a"].text == "It goes on. \n\nnew it said:\n\nx" and got["a"].n_pages == 5 and "b" not in got


def test_resume_and_counts(spark):
    docs = spark.createDataFrame([("a", 3), ("b", 0), ("c", None)], "pdf_name string, n_pages int")
    todo = pages.expected_pages(docs)
    done = spark.createDataFrame([("a", 2), ("a", 2)], "pdf_name string, page int")
    assert sorted(r.page for r in pages.todo(todo, done).collect()) == [1, 3]
    c = {r.folder: r for r in progress.coverage(todo.withColumn("folder", F.lit("f")), done).collect()}
    assert (c["TOTAL"].total, c["f"].done, c["f"].remaining) == (3, 1, 2)
    models = spark.createDataFrame([("m", ("0", "0.0")), ("n", ("0", "x")), ("o", None)], "id string, pricing struct<prompt:string,completion:string>")
    assert {r.id: r.is_free for r in pages.free_models(models).collect()} == {"m": True, "n": False, "o": False}


def test_samples(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"))
    got = sampling.to_budget(df, "n", 100, "k").collect()
    total = sum(r.n for r in got)
    assert 100 <= total < 107 and all(r.n > 0 for r in got) and sorted(got) == sorted(sampling.to_budget(df.repartition(3), "n", 100, "k").collect())
    b = sampling.balanced(df, {"a": 5, "b": None}, "s", "k").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in b} == {"a": 5, "b": 250}
    assert sampling.split(df, 0.0, "k").where("split = 'val'").count() == 0 and 5 < sampling.split(df, 0.05, "k").where("split = 'val'").count() < 60
    assert sampling.max_pages(df.where("n = 5"), "n", 12, "k").count() == 3


def test_sft_lines_load_again(spark):
    shown = datasets.messages(F.col("p"), F.col("i"), F.col("a"))
    rows = spark.createDataFrame([('say "hi"\n', "x.png", "n: |\n  é"), ("q", "gone.png", "a"), ("q", "x.png", "")], "p string, i string, a string")
    lines = datasets.sft_lines(rows.select(shown.alias("messages"), datasets.metadata(page=F.lit(3)).alias("metadata")))
    extra = spark.createDataFrame([(" ",), ("{broken",)], "value string")
    good, bad = datasets.load_sft(lines.unionAll(extra), spark.createDataFrame([("x.png",)], "image string"))
    got = good.collect()
    assert len(got) == 1 and got[0].images == ["x.png"] and got[0].messages[0].content[0].text == 'say "hi"\n' and got[0].messages[1].content_text == "n: |\n  é"
    assert bad.count() == 1
    import json

    first = json.loads(lines.first().value)
    assert isinstance(first["messages"][0]["content"], list) and isinstance(first["messages"][1]["content"], str) and first["metadata"] == {"page": 3}
    with pytest.raises(Exception, match="no messages"):
        datasets.load_sft(spark.createDataFrame([("{}",)], "value string"))[0].collect()


def test_log(spark):
    raw = ["[2024-01-01 10:00:00] === YAML SESSION START ===", "[2024-01-01 10:00:05] [DONE ] a b page 3  120 chars  2.5s  prompt=1 completion=2 total=3 provider=p", "[2024-01-02 10:00:00] === YAML SESSION START ===", "[2024-01-02 10:01:00] [DONE ] a page 4  12 chars  4.0s  prompt=1 completion=2 total=4 provider=q", "[2024-01-02 10:01:01] [DONE ] a page 6  12 chars  1.0s  prompt=1 completion=2 total=7 provider=q", "[2024-01-02 10:02:00] [FAIL ] a page 5  broke", "noise", "[bad"]
    log = progress.parse_log(spark.createDataFrame(list(enumerate(raw)), "line_no long, line string"))
    s = progress.session_stats(log).first()
    assert (s.done, s.failed, s.skipped, s.avg_seconds, s.avg_tokens) == (2, 1, 0, 2.5, 5) and str(s.last_done) == "2024-01-02 10:01:01"
    r = log.where("line_no = 1").first()
    assert (r.pdf_name, r.page, r.chars, r.seconds, r.provider) == ("a b", 3, 120, 2.5, "p")


def test_translation(spark):
    y = "primary_language: en\nis_table: true\nnatural_text: |\n  One. Two.\n\n  | h |\n  |---|\n  | c |\n"
    out = translation.translation_records(spark.createDataFrame([("d", y), ("e", "words"), ("f", None)], "document_id string, yaml string"))
    got = {r.document_id: r for r in out.collect()}
    assert [s.text for s in got["d"].sentences] == ["One.", "Two."] and got["d"].tables[0].rows == [["c"]] and got["e"].error and got["e"].sentences == []
    import yaml

    docs = {r.document_id: yaml.safe_load(r.value.removeprefix("---\n")) for r in translation.yaml_documents(out).collect()}
    assert docs["d"]["sentences"] == [{"id": 1, "text": "One."}, {"id": 2, "text": "Two."}]


# Layout


def test_geometry(spark):
    m = [F.lit(float(x)) for x in (2, 0, 0, 3, 5, 7)]
    assert tuple(one(spark, geometry.affine(F.lit(1.0), F.lit(1.0), m))) == (7.0, 10.0)
    assert tuple(one(spark, geometry.unit_square_box(m))) == (5.0, 7.0, 7.0, 10.0)
    n = [F.lit(float(x)) for x in (1, 2, 3, 4, 5, 6)]
    two = geometry.affine(F.lit(2.0), F.lit(3.0), geometry.affine_product(m, n))
    p = geometry.affine(F.lit(2.0), F.lit(3.0), m)
    assert tuple(one(spark, two)) == tuple(one(spark, geometry.affine(p["x"], p["y"], n)))
    assert tuple(one(spark, geometry.png_size(F.lit(b"not a png")))) == (800, 1000)
    assert tuple(one(spark, geometry.fit_size(F.lit(2000), F.lit(1000)))) == (1288, 644) and one(spark, geometry.fixed(F.lit(72.5), 0)) == "72"


def test_merge_and_anchor(spark):
    boxes = [("d", 1, 0, "a", 0.0, 0.0, 1.0, 1.0), ("d", 1, 1, "b", 9.0, 9.0, 10.0, 10.0), ("d", 1, 2, "c", 1.5, 0.0, 2.0, 1.0), ("d", 2, 0, "z", 0.0, 0.0, 1.0, 1.0)]
    df = layout.merge_boxes(spark.createDataFrame(boxes, "pdf_name string, page int, idx int, name string, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.page, r.name, r.x1) for r in df.collect()) == [(1, "a+c", 2.0), (1, "b", 10.0), (2, "z", 1.0)]
    size = spark.createDataFrame([("d", 1, 612.0, 792.0), ("d", 3, 10.0, 20.0)], "pdf_name string, page int, width double, height double")
    words = spark.createDataFrame([("d", 1, i, f"text {i}" if i else " ", float(i * 37 % 100), float(i)) for i in range(60)], "pdf_name string, page int, idx int, text string, x double, y double")
    whole = {r.page: r.anchor for r in layout.anchor_text(size, df, words).collect()}
    assert whole[1].startswith("Page dimensions: 612.0x792.0\n[Image 0x0 to 2x1]\n[Image 9x9 to 10x10]\n[37x1]text 1\n") and whole[3] == "Page dimensions: 10.0x20.0\n"
    tight = {r.page: r.anchor for r in layout.anchor_text(size, df, words, budget=300).collect()}[1]
    body = tight.split("\n")[1:-1]
    assert len(tight) <= 300 and "[Image 0x0 to 2x1]" in body and len(body) < 62 and any("x59]" in x for x in body)
    assert layout.anchor_text(size, df, words, budget=10).where("page = 1").first().anchor == "Page dimensions: 612.0x792.0\n"


# Providers, files and streams


def test_provider_policy(spark):
    import random as r

    calls = []

    def flaky(request: dict) -> dict:
        calls.append(1)
        if len(calls) < 3:
            raise providers.Temporary("429")
        return {"content": "b", "reasoning": "a", "cost": 0.0}

    waits: list[float] = []
    got = providers.call(flaky, {}, providers.Policy(sleep=waits.append), r.Random(1))
    assert got["answer"] == "ab" and got["attempts"] == 3 and len(waits) == 2 and 2.5 <= waits[0] <= 7.5 <= 2 * waits[1]
    assert providers.call(lambda _: 1 / 0, {}, providers.Policy(), r.Random(1))["error"]
    with pytest.raises(providers.CostIncurred):
        providers.call(lambda _: {"cost": 0.1}, {}, providers.Policy(), r.Random(1))
    late = providers.call(lambda _: __import__("time").sleep(0.3), {}, providers.Policy(tries=1, seconds=0.02), r.Random(1))
    assert late["error"] and 0 <= providers.stagger(3, r.Random(1)) <= 7 and providers.stagger(99, r.Random(1)) == 30
    out = providers.complete(spark.createDataFrame([("one",), (None,)], "text string"))
    assert out.where("error is null").count() == 2 and out.select(yamlio.valid_page(F.col("answer")).alias("v")).where("v").count() == 2


def test_files(spark, tmp_path):
    at = str(tmp_path)
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a_page_1.html").write_text("<p>é</p>\n\nx")
    (tmp_path / "h" / "a_page_1.json").write_text('{"page": 1, "width": 5,\n "height": 6}')
    (tmp_path / "h" / "b.pdf").write_bytes(b"%PDF")
    page = readers.read_html(spark, f"{at}/h").first()
    assert page.stem == "a_page_1" and page.html == "<p>é</p>\n\nx"
    assert readers.list_files(spark, f"{at}/h").first().stem == "b" and readers.read_sidecars(spark, f"{at}/h").first().width == 5
    tests = spark.createDataFrame([("i", "order", "d.pdf", 1)], "id string, type string, pdf string, page int")
    sinks.write_jsonl(tests, f"{at}/t")
    assert readers.read_tests(spark, f"{at}/t").first().type == "order" and "null" not in readers.read_lines(spark, f"{at}/t").first().value
    sinks.append_dead_letters(spark.sql("select timestamp_ntz'2024-01-01 00:00:00' ts, 'd' pdf_name, 1 page, 'a\tb' reason"), f"{at}/dlq")
    assert spark.read.option("sep", "\t").csv(f"{at}/dlq").first()[3] == "a b"
    (tmp_path / "log").write_text("one\n\ntwo\n")
    assert sorted(tuple(r) for r in readers.read_log(spark, f"{at}/log").collect()) == [(0, "one"), (2, "two")]
    assert sinks.manifest(spark.range(3).select(F.col("id").alias("stem")), spark.range(1).select(F.col("id").alias("stem"))).count() == 2


def test_streams_equal_batches(spark, tmp_path, sf):
    at = str(tmp_path)
    src = spark.read.parquet(f"{sf}/pages.parquet").select(F.lit("s").alias("pdf_name"), F.col("page_id").cast("int").alias("page"), "html")
    src.where("page < 20").write.parquet(f"{at}/in")
    stream = lambda: jobs.stream_parquet(spark, f"{at}/in", src.schema)
    shout = lambda df: df.select("page", F.upper("pdf_name").alias("x"))
    jobs.resume_pages(stream(), shout, f"{at}/out", f"{at}/c1")
    first = spark.read.parquet(f"{at}/out").count()
    src.where("page >= 20").write.mode("append").parquet(f"{at}/in")
    jobs.resume_pages(stream(), shout, f"{at}/out", f"{at}/c1")
    assert first == src.where("page < 20").count() and spark.read.parquet(f"{at}/out").count() == src.count()
    jobs.stream_tests(stream(), f"{at}/tests", f"{at}/c2")
    want = testgen.page_tests(html.parse_pages(src))
    assert sorted(r.id for r in spark.read.parquet(f"{at}/tests").collect()) == sorted(r.id for r in want.collect())
    jobs.split_stream(stream().withColumn("error", F.when(F.col("page") % 2 == 0, "odd")), f"{at}/good", f"{at}/bad", f"{at}/c3")
    assert spark.read.parquet(f"{at}/good").count() + spark.read.parquet(f"{at}/bad").count() == src.count()
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "x.log").write_text("[2024-01-01 10:00:00] [SKIP ] a page 1\n[2024-01-01 10:00:00] [FAIL ] a page 2  x\n")
    jobs.stream_log_counts(spark.readStream.text(f"{at}/logs").withColumnRenamed("value", "line"), "counts", f"{at}/c4")
    assert {r.kind: r.n for r in spark.table("counts").collect()} == {"skip": 1, "fail": 1}
