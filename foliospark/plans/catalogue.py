"""All queries of the engine's own operators over the driver tables, each with its DuckDB SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, html, match, sentences, tables, text, yamlio
from ..operators import datasets, evaluate, layout, pages, progress, rewards, sampling, search, testgen, translation
from ..sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WS = text.WS


def norm(x: str) -> str:
    """The normalisation in DuckDB's words."""
    return f"regexp_replace(regexp_replace(lower({x}), '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


TEMPLATE = "Read the page and answer in YAML."


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def parsed(spark: SparkSession, sf: str, **only: Collection[str]) -> DataFrame:
    rows = table(spark, sf, "pages").select(F.lit("site").alias("pdf_name"), F.col("page_id").cast("int").alias("page"), "html")
    return html.parse_pages(rows, **only)


# Keys and text.


@query(r"""SELECT doc_id, regexp_extract(source || '_page_' || doc_id, '^(.+)_page_(\d+)$', 1) AS pdf_name,
regexp_extract(source || '_page_' || doc_id, '^(.+)_page_(\d+)$', 2)::INT AS page FROM documents""")
def key_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = text.page_key(F.concat("source", F.lit("_page_"), F.col("doc_id").cast("string")))
    return docs(spark, sf).select("doc_id", k.alias("k")).select("doc_id", "k.pdf_name", "k.page")


@query(f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT part, n FROM (SELECT CASE WHEN length(regexp_replace(s, '[^ঀ-৿]', '', 'g')) / length(s) > 0.1 THEN 'bn'
WHEN length(regexp_replace(s, '[^ऀ-ॿ]', '', 'g')) / length(s) > 0.1 THEN 'hi' ELSE 'en' END AS part, count(*) AS n
FROM (SELECT text || repeat(CASE doc_id % 3 WHEN 0 THEN 'ক' WHEN 1 THEN 'क' ELSE 'x' END, (doc_id % 1000)::INT) AS s FROM documents) WHERE length(s) > 0 GROUP BY 1)""")
def script_detect(spark: SparkSession, sf: str) -> DataFrame:
    letter = F.when(F.col("doc_id") % 3 == 0, "ক").when(F.col("doc_id") % 3 == 1, "क").otherwise("x")
    s = F.concat("text", F.repeat(letter, (F.col("doc_id") % 1000).cast("int")))
    return docs(spark, sf).where(F.length(s) > 0).groupBy(text.detect_script(s).alias("part")).agg(F.count("*").alias("n"))


@query(rf"""WITH s AS (SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '[', '\['), ']', '\]'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS x FROM documents),
h AS (SELECT doc_id, x, left(x, 122) AS a, right(x, 122) AS b FROM s)
SELECT doc_id, md5(CASE WHEN length(x) > 250 THEN coalesce(nullif(regexp_extract(a, '(?s)^(.*) [^ ]*$', 1), ''), a) || ' ... ' || coalesce(nullif(regexp_extract(b, '(?s)^[^ ]* (.*)$', 1), ''), b) ELSE x END) AS digest FROM h""")
def clean_anchor(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(text.clean_anchor(F.col("text")).cast("binary")).alias("digest"))


@query(rf"""SELECT doc_id, length('{TEMPLATE}' || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '<|anchor_start|>' || chr(10) || text || chr(10) || '<|anchor_end|>' ELSE '' END)::INT AS chars FROM documents""")
def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    anchor = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    return docs(spark, sf).select("doc_id", F.length(text.build_prompt(anchor, TEMPLATE)).alias("chars"))


_SPLIT = "replace(text, chr(57344), '')"
for _a in sentences.ABBREVIATIONS:
    _SPLIT = f"replace({_SPLIT}, '{_a}', chr(57344) || '{_a.replace('.', chr(0xE001))}')"
_SPLIT = f"regexp_replace({_SPLIT}, '(^|{WS}|[\"''(,])([A-Z])\\.', '\\1' || chr(57344) || '\\2' || chr(57345), 'g')"
_SPLIT = f"regexp_replace({_SPLIT}, '(^|[^\\p{{L}}\\p{{N}}_])p\\.({WS}*)(\\d)', '\\1' || chr(57344) || 'p' || chr(57345) || '\\2\\3', 'g')"
_SPLIT = f"regexp_replace({_SPLIT}, '([.!?]){WS}+([A-Z\"(])', '\\1' || chr(57346) || '\\2', 'g')"


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split({_SPLIT}, chr(57346))) AS s, generate_subscripts(string_split({_SPLIT}, chr(57346)), 1) AS i FROM documents),
q AS (SELECT doc_id, i, regexp_replace(replace(replace(s, chr(57344), ''), chr(57345), '.'), '^{WS}+|{WS}+$', '', 'g') AS s FROM p)
SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY i)) AS digest FROM q WHERE s <> '' GROUP BY doc_id""")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    s = docs(spark, sf).select("doc_id", sentences.split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


# Matching.


@query(f"SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains({norm('d.text')}, {norm('b.text')})")
def presence_exact(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_needles(docs(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark"))


@query()
def presence_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return search.find_needles(docs(spark, sf).select("doc_id", "text"), table(spark, sf, "benchmark"), max_diffs=4)


@query(rf"""SELECT page_id, NOT contains({norm("split_part(html, '<footer>', 1)")}, {norm("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}) AS passed FROM pages""")
def absence_check(spark: SparkSession, sf: str) -> DataFrame:
    foot = F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)
    return table(spark, sf, "pages").select("page_id", (~match.exact(F.substring_index("html", "<footer>", 1), foot)).alias("passed"))


_GRID = "SELECT r_name, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS ocr FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"


@query(f"""WITH g AS ({_GRID}), t AS (SELECT r_name, n_name AS cell, lag(n_name) OVER (PARTITION BY r_name ORDER BY n_nationkey) AS up, n_nationkey::VARCHAR AS l, lead(n_name) OVER (PARTITION BY r_name ORDER BY n_nationkey) AS down FROM nation JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT cell, up, l, down, strpos({norm('ocr')}, {norm('cell')}) AS c, strpos({norm('ocr')}, {norm('up')}) AS u, strpos({norm('ocr')}, {norm('l')}) AS f, strpos({norm('ocr')}, {norm('down')}) AS d FROM t JOIN g USING (r_name))
SELECT cell, c > 0 AND (up IS NULL OR (u > 0 AND u <= c)) AND f > 0 AND f <= c AND (down IS NULL OR (d > 0 AND d >= c)) AS passed FROM p""")
def table_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    ocr = rows.groupBy("r_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("x")))), lambda s: s["x"]), "\n").alias("ocr"))
    grid = rows.select(F.col("r_name"), F.lit(0).alias("table_idx"), F.row_number().over(testgen.Window.partitionBy("r_name").orderBy("n_nationkey")).alias("row_idx"), F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.col("n_nationkey").cast("string").alias("text")), F.struct(F.lit(1).alias("col_idx"), F.col("n_name").alias("text")))).alias("c"), F.lit(False).alias("head_row"))
    near = testgen.neighbours(grid.select("r_name", "table_idx", "row_idx", "c.col_idx", "c.text", "head_row"), ("r_name",)).where("col_idx = 1").join(ocr, "r_name")
    none = F.lit(None).cast("string")
    return near.select(F.col("text").alias("cell"), match.cell_near(F.col("ocr"), F.col("text"), F.col("up"), F.col("down"), F.col("left"), none, none).alias("passed"))


@query("""WITH c AS (SELECT n_regionkey AS g, r, col, x FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_nationkey::VARCHAR AS a, n_name AS b FROM nation), LATERAL (VALUES (0, a), (1, b)) v(col, x))
SELECT g, r::INT AS row_idx, col AS col_idx, lag(x) OVER (PARTITION BY g, col ORDER BY r) AS up, lead(x) OVER (PARTITION BY g, col ORDER BY r) AS down,
lag(x) OVER (PARTITION BY g, r ORDER BY col) AS "left", lead(x) OVER (PARTITION BY g, r ORDER BY col) AS "right",
CASE WHEN r > 1 THEN first_value(x) OVER (PARTITION BY g, col ORDER BY r) END AS heading FROM c""")
def table_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").withColumn("row_idx", F.row_number().over(testgen.Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cells = F.explode(F.array(F.struct(F.lit(0).alias("col_idx"), F.col("n_nationkey").cast("string").alias("text")), F.struct(F.lit(1).alias("col_idx"), F.col("n_name").alias("text"))))
    grid = rows.select(F.col("n_regionkey").alias("g"), F.lit(0).alias("table_idx"), "row_idx", cells.alias("c"), (F.col("row_idx") == 1).alias("head_row"))
    return testgen.neighbours(grid.select("g", "table_idx", "row_idx", "c.*", "head_row"), ("g",)).select("g", "row_idx", "col_idx", "up", "down", "left", "right", "heading")


_LINES = "([x for x in string_split(text, chr(10)) if trim(x) <> ''])"


@query(f"""WITH l AS (SELECT doc_id, {norm('text')} AS h, {norm(_LINES + '[1]')} AS a, {norm(_LINES + '[-1]')} AS b FROM documents WHERE len({_LINES}) > 0)
SELECT doc_id, strpos(h, a) > 0 AND strpos(h, b) > 0 AND strpos(h, a) < strpos(h, b) AS passed FROM l""")
def order_check(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs(spark, sf).select("doc_id", "text", lines.alias("l")).where(F.size("l") > 0)
    return rows.select("doc_id", match.in_order(F.col("text"), F.element_at("l", 1), F.element_at("l", -1)).alias("passed"))


@query("""SELECT p_partkey, contains(lower(replace('\\( X = ' || p_size || ' \\) ' || p_name, ' ', '')), 'x=' || (p_partkey % 50 + 1)) AS passed FROM part""")
def math_check(spark: SparkSession, sf: str) -> DataFrame:
    ocr = F.concat(F.lit("\\( X = "), F.col("p_size").cast("string"), F.lit(" \\) "), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", match.formula(ocr, F.concat(F.lit("x = "), (F.col("p_partkey") % 50 + 1).cast("string"))).alias("passed"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Seven tests for each document, among them an unknown type and one without its field."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs(spark, sf).select("doc_id", "text", lines.alias("l")).where(F.size("l") > 0)
    first, last = F.element_at("l", 1), F.element_at("l", -1)
    fields = ("type", "text", "max_diffs", "before", "after", "latex")

    def test(kind: str, **x: object) -> object:
        return F.struct(*[(F.lit(kind) if f == "type" else x.get(f, F.lit(None))).cast("int" if f == "max_diffs" else "string").alias(f) for f in fields])

    made = [test("text_presence", text=last, max_diffs=F.lit(0)), test("text_absence", text=first, max_diffs=F.lit(0)), test("order", before=first, after=last), test("order", before=last, after=first), test("formatting", text=F.concat(first, F.lit("#"))), test("math"), test("colour", text=first)]
    rows = evaluate.with_normal(rows.withColumn("ocr_text", F.col("text")))
    rows = rows.select("doc_id", "ocr_text", evaluate.NORMAL, F.posexplode(F.array(*made)).alias("k", "t")).select("doc_id", "ocr_text", evaluate.NORMAL, "k", "t.*")
    return rows.select("doc_id", "ocr_text", evaluate.NORMAL, F.concat_ws("_", "doc_id", "k").alias("id"), "type", "text", "max_diffs", *[F.lit(None).cast("string").alias(c) for c in ("cell", "up", "down", "left", "right", "top_heading")], "before", "after", "latex")


_MIXED = f"""l AS (SELECT doc_id, {norm('text')} AS h, {norm(_LINES + '[1]')} AS a, {norm(_LINES + '[-1]')} AS b FROM documents WHERE len({_LINES}) > 0),
m AS (SELECT doc_id, v.k, v.type, v.passed, v.error FROM l, LATERAL (VALUES (0, 'text_presence', contains(h, b), NULL), (1, 'text_absence', NOT contains(h, a), NULL),
(2, 'order', strpos(h, a) > 0 AND strpos(h, b) > 0 AND strpos(h, a) < strpos(h, b), NULL), (3, 'order', strpos(h, a) > 0 AND strpos(h, b) > 0 AND strpos(h, b) < strpos(h, a), NULL),
(4, 'formatting', contains(h, a || '#'), NULL), (5, 'math', false, 'missing field: latex'), (6, 'colour', false, 'Unknown test type: colour')) v(k, type, passed, error))"""


@query(f"WITH {_MIXED} SELECT doc_id || '_' || k AS id, type, passed, error FROM m")
def eval_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.evaluate(_mixed(spark, sf)).select("id", "type", "passed", "error")


@query(f"WITH {_MIXED} SELECT type, count(*) FILTER (passed) AS passed, count(*) AS total, 100.0::DOUBLE * count(*) FILTER (passed) / count(*) AS pct FROM m GROUP BY type")
def score_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.by_type(evaluate.evaluate(_mixed(spark, sf)))


@query(f"WITH {_MIXED} SELECT doc_id, count(*) FILTER (passed) AS num_passed, count(*) FILTER (NOT passed) AS num_failed, count(*) AS num_total, (count(*) FILTER (passed))::DOUBLE / count(*) AS score FROM m GROUP BY doc_id")
def score_by_page(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score(evaluate.evaluate(_mixed(spark, sf)), "doc_id")


@query(f"WITH {_MIXED} SELECT doc_id || '_' || k AS id, type, error FROM m WHERE NOT passed ORDER BY id LIMIT 10")
def first_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.failures(evaluate.evaluate(_mixed(spark, sf))).select("id", "type", "error")


_RESULTS = f"WITH {_MIXED}, r AS (SELECT d.doc_id, m.type, m.passed FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id AND d.doc_id % 10 > 0)"
_WEIGHT = "CASE type WHEN 'table' THEN 2.0::DOUBLE WHEN 'text_absence' THEN 1.5 WHEN 'order' THEN 1.5 WHEN 'math' THEN 2.0 WHEN 'formatting' THEN 0.5 ELSE 1.0 END"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Results by document; every tenth has no tests."""
    found = evaluate.evaluate(_mixed(spark, sf)).where("doc_id % 10 > 0").select("doc_id", "type", "passed")
    return docs(spark, sf).select("doc_id").join(found, "doc_id", "left")


@query(f"{_RESULTS} SELECT doc_id, CASE WHEN count(*) FILTER (NOT passed) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS reward FROM r GROUP BY doc_id")
def reward_binary(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.rewards(_results(spark, sf), "doc_id", strategy="binary")


@query(f"{_RESULTS} SELECT doc_id, coalesce((count(*) FILTER (passed))::DOUBLE / nullif(count(passed), 0), 0.0) AS reward FROM r GROUP BY doc_id")
def reward_proportional(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.rewards(_results(spark, sf), "doc_id")


@query(f"{_RESULTS} SELECT doc_id, coalesce(sum(CASE WHEN passed THEN {_WEIGHT} ELSE 0.0 END) / sum(CASE WHEN passed IS NOT NULL THEN {_WEIGHT} END), 0.0) AS reward FROM r GROUP BY doc_id")
def reward_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rewards.rewards(_results(spark, sf), "doc_id", strategy="weighted")


_GENS = """g AS (SELECT doc_id, gen_id, CASE gen_id WHEN 0 THEN text WHEN 1 THEN replace(text, '.', ' ') WHEN 2 THEN left(text, (length(text) // 2)::INT) ELSE '' END AS gen FROM documents, range(4) t(gen_id)),
w AS (SELECT g.doc_id, gen_id, unnest([contains(lower(gen), lower(left(text, 20))), contains(lower(gen), lower(right(text, 20))), contains(lower(gen), '.')]) AS ok FROM g JOIN documents d ON d.doc_id = g.doc_id),
s AS (SELECT doc_id, gen_id::INT AS gen_id, (count(*) FILTER (ok))::DOUBLE / 3 AS reward FROM w GROUP BY 1, 2)"""


def _generations(spark: SparkSession, sf: str) -> DataFrame:
    """Four answers for each document, scored by three plain tests."""
    d, t = docs(spark, sf), F.col("text")
    gens = F.array(t, F.replace(t, F.lit("."), F.lit(" ")), F.left(t, F.floor(F.length(t) / 2).cast("int")), F.lit(""))
    rows = d.select("doc_id", t, F.posexplode(gens).alias("gen_id", "gen"))
    ok = F.explode(F.array(F.contains(F.lower("gen"), F.lower(F.left(t, F.lit(20)))), F.contains(F.lower("gen"), F.lower(F.right(t, F.lit(20)))), F.contains(F.lower("gen"), F.lit("."))))
    return rewards.rewards(rows.select("doc_id", "gen_id", F.lit("text_presence").alias("type"), ok.alias("passed")), "doc_id", "gen_id")


@query(f"WITH {_GENS}, a AS (SELECT *, avg(reward) OVER (PARTITION BY doc_id) AS m, stddev_pop(reward) OVER (PARTITION BY doc_id) AS sd FROM s), b AS (SELECT doc_id, gen_id, reward, CASE WHEN sd < 1e-8 THEN 0.0 ELSE (reward - m) / sd END AS adv FROM a) SELECT doc_id, gen_id, round(reward, 6) AS reward, round(adv, 5) AS advantage FROM b WHERE abs(adv) >= 1e-8")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    out = rewards.without_zero(rewards.advantages(_generations(spark, sf), "doc_id"))
    return out.select("doc_id", "gen_id", F.round("reward", 6).alias("reward"), F.round("advantage", 5).alias("advantage"))


@query(f"WITH {_GENS} SELECT doc_id, round(avg(reward), 6) AS reward_mean, round(stddev_pop(reward), 6) AS reward_std, count(*)::INT AS num_generations FROM s GROUP BY doc_id")
def step_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = rewards.step_metrics(rewards.advantages(_generations(spark, sf), "doc_id"), "doc_id")
    return out.select("doc_id", F.round("reward_mean", 6).alias("reward_mean"), F.round("reward_std", 6).alias("reward_std"), "num_generations")


@query(f"""WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents WHERE len({_LINES}) > 0),
g AS (SELECT doc_id, unnest([0, 1, 2]) AS gen_id, unnest([text, left(text, (length(text) // 2)::INT), array_to_string(list_reverse(l), chr(10))]) AS gen, l[1] AS first, l[-1] AS last FROM l),
n AS (SELECT doc_id, gen_id, {norm('gen')} AS h, {norm('first')} AS a, {norm('last')} AS b FROM g)
SELECT doc_id::VARCHAR AS pdf_name, gen_id::INT AS gen_id, (contains(h, a)::INT + contains(h, b)::INT + 1.5 * (NOT contains(h, b))::INT + 1.5 * (strpos(h, a) > 0 AND strpos(h, b) > 0 AND strpos(h, a) < strpos(h, b))::INT)::DOUBLE / 5.0::DOUBLE AS reward FROM n""")
def completion_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Three answers for each document, all against the document's four tests, which are stored as JSON lines."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = docs(spark, sf).select(F.col("doc_id").cast("string").alias("pdf_name"), F.lit(1).alias("page"), "text", lines.alias("l")).where(F.size("l") > 0)
    first, last, none = F.element_at("l", 1), F.element_at("l", -1), F.lit(None).cast("string")
    test = lambda kind, text=none, before=none, after=none: F.struct(F.lit(kind).alias("type"), text.alias("text"), before.alias("before"), after.alias("after"))
    made = [test("text_presence", first), test("text_presence", last), test("text_absence", last), test("order", before=first, after=last)]
    tests = rows.select(F.concat("pdf_name", F.lit(".pdf")).alias("pdf"), "page", F.posexplode(F.array(*made)).alias("k", "t")).select(F.concat_ws("_", "pdf", "k").alias("id"), "pdf", "page", "t.*", F.lit(0).alias("max_diffs"))
    at = f"{sinks.shared_folder(spark)}/tests-{uuid.uuid4().hex}"
    sinks.write_jsonl(tests, at)
    gens = F.array(F.col("text"), F.left("text", F.floor(F.length("text") / 2).cast("int")), F.array_join(F.reverse("l"), "\n"))
    answers = rows.select("pdf_name", "page", F.posexplode(gens).alias("gen_id", "text"))
    return rewards.completion_rewards(answers, readers.read_tests(spark, at), "weighted").select("pdf_name", "gen_id", "reward")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM events")
def moving_reward(spark: SparkSession, sf: str) -> DataFrame:
    out = rewards.moving_average(table(spark, sf, "events"), "value", "event_id", 10, "event_type")
    return out.select("event_id", F.round("moving_avg", 4).alias("moving_avg"))


# Test generation.


@query()
def gen_tests(spark: SparkSession, sf: str) -> DataFrame:
    return testgen.page_tests(sinks.written_once(parsed(spark, sf), "parsed"))


@query()
def gen_presence(spark: SparkSession, sf: str) -> DataFrame:
    return testgen.presence_tests(parsed(spark, sf, parts=("nodes",), tags=html.BODY_TAGS))


@query()
def gen_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return testgen.formatting_tests(parsed(spark, sf, parts=("nodes",), tags=testgen.FORMATTED))


@query()
def formatting_check(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.written_once(parsed(spark, sf, parts=("nodes", "main_html"), tags=testgen.FORMATTED), "parsed")
    tests = testgen.formatting_tests(p).withColumnRenamed("page", "p")
    ocr = evaluate.with_normal(p.select(F.col("page").alias("p"), F.col("page_parts.main_html").alias("ocr_text")))
    return evaluate.evaluate(tests.join(ocr, "p").withColumnRenamed("p", "page")).select("id", "page", "format_type", "passed")


@query("SELECT page_id::INT AS page, coalesce(nullif(lower(left(regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1), 2)), ''), 'en') AS lang FROM pages")
def html_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf, parts=("lang",)).select("page", "page_parts.lang")


@query()
def html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return parsed(spark, sf, parts=("main_html", "main_markdown", "is_table", "is_diagram")).select("page", F.col("page_parts.main_html").alias("text"), F.col("page_parts.main_markdown").alias("markdown"), "page_parts.is_table", "page_parts.is_diagram")


_HEX = "('0x' || left(md5('42|{}|' || doc_id || '|' || k), 8))::BIGINT"


@query(f"""WITH t AS (SELECT doc_id, len({_LINES}) AS n FROM documents), d AS (SELECT doc_id, n, k FROM t, range(1, 4) r(k) WHERE n >= 2 AND k <= n - 1),
i AS (SELECT doc_id, n, k, {_HEX.format('oi')} % (n - 1) AS i FROM d) SELECT doc_id, k::INT AS k, i::INT AS i, (i + 1 + {_HEX.format('oj')} % (n - 1 - i))::INT AS j FROM i""")
def gen_order_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = docs(spark, sf).select("doc_id", F.explode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("line"))
    return testgen.order_pairs(lines, key=("doc_id",))


@query("""SELECT source AS pdf_name, (doc_id % 7)::INT AS page, count(*) AS n_tests FROM documents GROUP BY 1, 2 HAVING count(*) >= 2""")
def tests_by_page(spark: SparkSession, sf: str) -> DataFrame:
    tests = docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), F.lit("order").alias("type"), F.concat("source", F.lit(".pdf")).alias("pdf"), (F.col("doc_id") % 7).cast("int").alias("page"))
    for f in datasets.PAGE_TEST:
        if f.name not in tests.columns:
            tests = tests.withColumn(f.name, F.lit(None).cast(f.dataType))
    return datasets.tests_by_page(tests, 2).select("pdf_name", "page", "n_tests")


# Pages and documents.


@query(f"""WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE text <> ''),
q AS (SELECT conv_id, turn, text, b, CASE WHEN b IS NULL THEN '' WHEN NOT regexp_matches(regexp_replace(b, '{WS}+$', ''), '[.?!:"”]$') AND regexp_matches(regexp_replace(text, '^{WS}+', ''), '^[a-z]') THEN ' ' ELSE chr(10) || chr(10) END AS g FROM p)
SELECT conv_id, count(*) AS n_pages, md5(string_agg(g || text, '' ORDER BY turn)) AS digest FROM q GROUP BY conv_id""")
def linearize(spark: SparkSession, sf: str) -> DataFrame:
    out = pages.linearize(table(spark, sf, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "n_pages", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return pages.todo(table(spark, sf, "orders").select("o_orderkey"), done, key=("o_orderkey",))


@query("SELECT count(*) AS pages, count(DISTINCT source) AS pdfs FROM documents")
def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return pages.inventory(docs(spark, sf).withColumnRenamed("source", "pdf_name"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS done, count(*) FILTER (event_type = 'view') AS skipped, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 3) AS seconds,
count(*) FILTER (event_type IN ('purchase', 'error')) = 0 AS fully_skipped FROM events GROUP BY user_id""")
def page_counters(spark: SparkSession, sf: str) -> DataFrame:
    status = F.create_map(F.lit("purchase"), F.lit("done"), F.lit("view"), F.lit("skip"), F.lit("error"), F.lit("fail"))[F.col("event_type")]
    rows = table(spark, sf, "events").select("user_id", status.alias("status"), F.col("value").alias("seconds"))
    return pages.page_counters(rows, "user_id").withColumn("seconds", F.round("seconds", 3))


_USAGE = "SELECT l_returnflag AS provider, coalesce(sum(l_partkey), 0)::BIGINT AS prompt_tokens, coalesce(sum(l_linenumber), 0)::BIGINT AS completion_tokens, sum(l_partkey + l_linenumber)::BIGINT AS total_tokens, round(sum(CASE WHEN l_orderkey = 7 THEN 0.5::DOUBLE ELSE 0 END), 3) AS cost, count(*) FILTER (l_partkey + l_linenumber > 1000) AS over_free FROM lineitem GROUP BY 1"


@query(_USAGE)
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("provider"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"), (F.col("l_partkey") + F.col("l_linenumber")).alias("total_tokens"), F.when(F.col("l_orderkey") == 7, 0.5).alias("cost"))
    return pages.usage_totals(rows, "provider", free_tokens=1000).withColumn("cost", F.round("cost", 3))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CASE WHEN l_orderkey = 7 THEN 0.5 ELSE 0 END > 0")
def cost_guard(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where(pages.costs_money(F.when(F.col("l_orderkey") == 7, 0.5))).select("l_orderkey", "l_linenumber")


@query("SELECT event_id, event_type AS reason FROM events WHERE event_type = 'error'")
def dlq_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("event_type")).alias("error"))
    return pages.split_errors(rows)[1].select("event_id", F.col("error").alias("reason"))


@query("SELECT p_brand AS id, min(p_size) = 1 AND max(p_size) >= 1 AS is_free FROM (SELECT p_brand, p_size FROM part) GROUP BY 1")
def free_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg((F.min("p_size") - 1).cast("string").alias("prompt"), F.lit("0").alias("completion"))
    return pages.free_models(rows.select("id", F.struct("prompt", "completion").alias("pricing")))


# Samples.


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents WHERE lang IN ('en', 'fr', 'de')) SELECT doc_id, lang FROM r WHERE lang <> 'en' OR r <= 50""")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced(docs(spark, sf).select("doc_id", "lang"), {"en": 50, "fr": None, "de": None}, "lang", "doc_id")


@query("""WITH r AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY md5('42|' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM documents WHERE n_chars > 0) SELECT doc_id, n_chars FROM r WHERE coalesce(b, 0) < 200000""")
def sample_to_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.to_budget(docs(spark, sf).select("doc_id", "n_chars"), "n_chars", 200_000, "doc_id")


@query("""WITH r AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM documents) SELECT doc_id, source FROM r WHERE coalesce(b, 0) < 20000""")
def max_pages_stop(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.max_pages(docs(spark, sf).select("doc_id", "source", "n_chars"), "n_chars", 20_000, "doc_id", by=("source",)).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN ('0x' || left(md5('42|' || doc_id), 8))::BIGINT % 10000 < 500 THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(docs(spark, sf).select("doc_id"), 0.05, "doc_id")


# Logs and coverage.


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return _log_of(table(spark, sf, "events"))


def _log_of(e: DataFrame) -> DataFrame:
    """A progress log made of events: a session starts every 5000 lines."""
    stamp = F.date_format("ts", "'['yyyy-MM-dd HH:mm:ss']'")
    page = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(" page "), F.col("event_id").cast("string"))
    n = F.col("event_id").cast("string")
    done = F.concat(stamp, F.lit(" [DONE ] "), page, F.lit("  120 chars  "), F.format_string("%d.5s", F.col("event_id") % 50), F.lit("  prompt=9 completion="), n, F.lit(" total="), (F.col("event_id") + 9).cast("string"), F.lit(" provider=p"))
    line = F.when(F.col("event_id") % 5000 == 0, F.concat(stamp, F.lit(" === YAML SESSION START ==="))).when(F.col("event_type") == "purchase", done).when(F.col("event_type") == "view", F.concat(stamp, F.lit(" [SKIP ] "), page)).when(F.col("event_type") == "error", F.concat(stamp, F.lit(" [FAIL ] "), page, F.lit("  no answer"))).otherwise(F.lit("noise"))
    return progress.parse_log(e.select(F.col("event_id").alias("line_no"), line.alias("line")))


_KIND = "CASE WHEN event_id % 5000 = 0 THEN 'start' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'view' THEN 'skip' WHEN event_type = 'error' THEN 'fail' END"


@query(f"""SELECT event_id AS line_no, {_KIND} AS kind, CASE WHEN {_KIND} IS NOT NULL THEN date_trunc('second', ts) END AS ts, CASE WHEN {_KIND} IN ('done', 'skip', 'fail') THEN 'u' || user_id END AS pdf_name, CASE WHEN {_KIND} = 'done' THEN (event_id % 50 + 0.5)::DOUBLE END AS seconds, CASE WHEN {_KIND} = 'done' THEN (event_id + 9)::INT END AS total FROM events""")
def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("line_no", "kind", "ts", "pdf_name", "seconds", "total")


@query(f"""WITH k AS (SELECT event_id AS i, ts, {_KIND} AS kind FROM events), s AS (SELECT * FROM k WHERE i >= (SELECT max(i) FROM k WHERE kind = 'start')), r AS (SELECT i FROM s WHERE kind = 'done' ORDER BY i DESC LIMIT 10)
SELECT (SELECT count(*) FROM s WHERE kind = 'done') AS done, (SELECT count(*) FROM s WHERE kind = 'fail') AS failed, (SELECT count(*) FROM s WHERE kind = 'skip') AS skipped, (SELECT date_trunc('second', max(ts)) FROM s WHERE kind = 'done') AS last_done, (SELECT avg(i % 50 + 0.5)::DOUBLE FROM r) AS avg_seconds, (SELECT (sum(i + 9) // count(*))::BIGINT FROM r) AS avg_tokens""")
def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    return progress.session_stats(_log(spark, sf))


@query("""WITH x AS (SELECT d.lang AS folder, l.doc_id AS done FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT CASE WHEN grouping(folder) = 1 THEN 'TOTAL' ELSE folder END AS folder, count(*) AS total, count(done) AS done, count(*) - count(done) AS remaining, 100.0::DOUBLE * count(done) / count(*) AS coverage_pct FROM x GROUP BY ROLLUP (folder)""")
def coverage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return progress.coverage(docs(spark, sf).select("doc_id", F.col("lang").alias("folder")), table(spark, sf, "labels"), key=("doc_id",))


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 10")
def last10(spark: SparkSession, sf: str) -> DataFrame:
    return progress.last_values(table(spark, sf, "events"), "event_id", 10, "event_type").select("event_id", "event_type")


# Tables, HTML and YAML.


_MD = """SELECT r_regionkey, r_name, r_name || ' list' || chr(10) || chr(10) || '| key | name |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || 'That is all & <done>.' AS md, count(*) AS n, string_agg(n_nationkey || ',' || n_name, ';' ORDER BY n_nationkey) AS cells,
string_agg('  <tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', chr(10) ORDER BY n_nationkey) AS trs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit("| "), F.col("n_nationkey").cast("string"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("x")))), lambda s: s["x"]), "\n")
    return rows.groupBy("r_regionkey", "r_name").agg(body.alias("b")).select("r_regionkey", F.concat("r_name", F.lit(" list\n\n| key | name |\n|---|---|\n"), "b", F.lit("\n\nThat is all & <done>.")).alias("md"))


@query(f"WITH m AS ({_MD}) SELECT r_regionkey, 1 AS table_id, 'key,name' AS headers, n, cells, r_name || ' list' || chr(10) || chr(10) || chr(10) || 'That is all & <done>.' AS rest FROM m")
def md_tables(spark: SparkSession, sf: str) -> DataFrame:
    m = _markdown(spark, sf)
    t = m.select("r_regionkey", F.explode(tables.markdown_tables(F.col("md"))).alias("t"), tables.without_tables(F.col("md")).alias("rest"))
    cells = F.array_join(F.transform("t.rows", lambda r: F.array_join(r, ",")), ";")
    return t.select("r_regionkey", "t.table_id", F.array_join("t.headers", ",").alias("headers"), F.size("t.rows").cast("long").alias("n"), cells.alias("cells"), "rest")


@query(f"""WITH m AS ({_MD}) SELECT r_regionkey, '<p>' || r_name || ' list</p>' || chr(10) || '<table>' || chr(10) || '  <tr><th>key</th><th>name</th></tr>' || chr(10) || trs || chr(10) || '</table>' || chr(10) || '<p>That is all &amp; &lt;done&gt;.</p>' AS body FROM m""")
def md_to_html(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf).select("r_regionkey", tables.text_to_html(F.col("md")).alias("body"))


@query(f"""WITH m AS ({_MD}) SELECT r_regionkey, length('<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<meta name="viewport" content="width=800">' || chr(10) || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<div class="main-col">' || chr(10)
|| '<p>' || r_name || ' list</p>' || chr(10) || '<table>' || chr(10) || '  <tr><th>key</th><th>name</th></tr>' || chr(10) || trs || chr(10) || '</table>' || chr(10) || '<p>That is all &amp; &lt;done&gt;.</p>' || chr(10) || '</div>' || chr(10) || '</body>' || chr(10) || '</html>')::INT AS chars FROM m""")
def page_document(spark: SparkSession, sf: str) -> DataFrame:
    body = tables.text_to_html(F.col("md"))
    return _markdown(spark, sf).select("r_regionkey", F.length(html.page_document(body, F.lit("en"))).alias("chars"))


_YAML = r"""'primary_language: ' || lang || chr(10) || 'is_rotation_valid: true' || chr(10) || 'rotation_correction: 0' || chr(10) || 'is_table: ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || chr(10) || 'is_diagram: false' || chr(10) || 'natural_text: |' || chr(10) || regexp_replace(text, '(?m)^([^\n]*[^\s])', '  \1', 'g')"""


def _yaml(with_id: bool = False):
    return yamlio.format_yaml(F.col("text"), F.col("lang"), F.col("doc_id") % 2 == 0, F.lit(False), document_id=F.col("source") if with_id else None)


@query(f"SELECT doc_id, md5({_YAML}) AS digest FROM documents")
def yaml_format(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(_yaml().cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) AS digest FROM documents")
def natural_text(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(yamlio.natural_text_of(F.concat(_yaml(), F.lit("\nend: 1"))).cast("binary")).alias("digest"))


@query("SELECT doc_id, lang AS primary_language, doc_id % 2 = 0 AS is_table, false AS is_diagram, 0 AS rotation_correction FROM documents")
def yaml_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = docs(spark, sf).select("doc_id", yamlio.parse_yaml_page(_yaml(True)).alias("p"))
    return p.select("doc_id", "p.primary_language", "p.is_table", "p.is_diagram", "p.rotation_correction")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE lang END AS primary_language FROM documents")
def yaml_response(spark: SparkSession, sf: str) -> DataFrame:
    fence = F.concat(F.lit("Here:\n```yaml\n"), _yaml(), F.lit("\n```"))
    raw = F.when(F.col("doc_id") % 3 == 0, _yaml()).when(F.col("doc_id") % 3 == 1, fence).otherwise(F.lit("just words"))
    return docs(spark, sf).select("doc_id", yamlio.parse_response(raw).alias("p")).select("doc_id", "p.primary_language")


@query(f"""WITH s AS (SELECT doc_id, {_YAML} AS y FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE md5(regexp_replace(y, '^{WS}+|{WS}+$', '', 'g')) END AS digest FROM s""")
def fence_extract(spark: SparkSession, sf: str) -> DataFrame:
    fence = F.concat(F.lit("<think>primary_language: x</think> Here:\n```yaml\n"), _yaml(), F.lit("\n```"))
    raw = F.when(F.col("doc_id") % 3 == 0, fence).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("It is primary"), F.lit(" so: "), _yaml())).otherwise(F.lit("nothing"))
    return docs(spark, sf).select("doc_id", F.md5(yamlio.yaml_of_completion(raw).cast("binary")).alias("digest"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE md5(regexp_replace(html, '^\\s+|\\s+$', '', 'g')) END AS digest FROM pages")
def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Here\n```html\n"), "html", F.lit("\n```\nend"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("```\n"), "html", F.lit("\n```"))).otherwise(F.lit("```\nplain\n```"))
    return table(spark, sf, "pages").select("page_id", F.md5(html.html_of_completion(raw).cast("binary")).alias("digest"))


_CSS = """(chr(10) || '<style>' || chr(10) || '  /* Injected viewport constraints */' || chr(10) || '  html { margin: 0 !important; padding: 0 !important; }' || chr(10) || '  body {' || chr(10) || '    width: 800px !important;' || chr(10) || '    min-height: 1131px !important;' || chr(10) || '    overflow: visible !important;' || chr(10) || '    box-sizing: border-box !important;' || chr(10) || '    margin: 0 !important;' || chr(10) || '  }' || chr(10) || '</style>' || chr(10))"""


@query(f"""SELECT page_id, md5(CASE WHEN strpos(html, '</head>') > 0 THEN left(html, strpos(html, '</head>') - 1) || {_CSS} || substr(html, strpos(html, '</head>')) WHEN strpos(html, '<body') > 0 THEN left(html, strpos(html, '<body') - 1) || {_CSS} || substr(html, strpos(html, '<body')) ELSE '<html><head>' || {_CSS} || '</head>' || chr(10) || html END) AS digest FROM pages""")
def viewport_inject(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(html.inject_viewport(F.col("html"), F.lit(800)).cast("binary")).alias("digest"))


# Geometry.


@query("SELECT p_partkey, (p_partkey % 3000 + 1)::INT AS width, (p_size * 50)::INT AS height FROM part")
def png_dims(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    w, h = F.col("p_partkey") % 3000 + 1, F.col("p_size") * 50
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), word(w), word(h)))
    return table(spark, sf, "part").select("p_partkey", geometry.png_size(png).alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT p_partkey, CASE WHEN greatest(w, h) > 1288 THEN floor(w * (1288.0::DOUBLE / greatest(w, h)))::INT ELSE w END AS width, CASE WHEN greatest(w, h) > 1288 THEN floor(h * (1288.0::DOUBLE / greatest(w, h)))::INT ELSE h END AS height FROM (SELECT p_partkey, (p_partkey % 3000 + 1)::INT AS w, (p_size * 50)::INT AS h FROM part)")
def fit_1288(spark: SparkSession, sf: str) -> DataFrame:
    s = geometry.fit_size((F.col("p_partkey") % 3000 + 1).cast("int"), (F.col("p_size") * 50).cast("int"))
    return table(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT p_partkey, round_even(p_size * 1.414::DOUBLE, 0)::INT AS height FROM part")
def a4_height(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", geometry.a4_height(F.col("p_size")).alias("height"))


@query("SELECT l_orderkey, l_linenumber, round(2.0::DOUBLE * l_quantity + 0.5::DOUBLE * l_linenumber + 3, 4) AS x, round(1.5::DOUBLE * l_quantity - 1.0::DOUBLE * l_linenumber + 4, 4) AS y FROM lineitem")
def affine(spark: SparkSession, sf: str) -> DataFrame:
    m = [F.lit(float(x)) for x in (2.0, 1.5, 0.5, -1.0, 3.0, 4.0)]
    p = geometry.affine(F.col("l_quantity"), F.col("l_linenumber"), m)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT l_orderkey, l_linenumber, greatest(0.0::DOUBLE, greatest(l_quantity, 20.0::DOUBLE) - least(l_quantity + 5, 30.0::DOUBLE)) AS gap FROM lineitem")
def bbox_gap(spark: SparkSession, sf: str) -> DataFrame:
    a = F.struct(F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 5).alias("x1"))
    b = F.struct(F.lit(20.0).alias("x0"), F.lit(30.0).alias("x1"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", geometry.box_gap(a, b, "x").alias("gap"))


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty boxes for each page of parts."""
    k, x, y = F.col("p_partkey"), F.col("p_partkey") * 37 % 100, F.col("p_partkey") * 53 % 100
    return table(spark, sf, "part").select(F.lit("d").alias("pdf_name"), F.floor(k / 20).cast("int").alias("page"), (k % 20).cast("int").alias("idx"), k.cast("string").alias("name"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.col("p_size") % 15).cast("double").alias("x1"), (y + 8).cast("double").alias("y1"))


@query("""WITH RECURSIVE b AS (SELECT (p_partkey // 20)::INT AS page, (p_partkey % 20)::INT AS idx, p_partkey AS name, (p_partkey * 37 % 100)::DOUBLE AS x0, (p_partkey * 53 % 100)::DOUBLE AS y0, (p_partkey * 37 % 100 + p_size % 15)::DOUBLE AS x1, (p_partkey * 53 % 100 + 8)::DOUBLE AS y1 FROM part),
e AS (SELECT a.page, a.idx AS i, c.idx AS j FROM b a JOIN b c ON a.page = c.page AND greatest(a.x0, c.x0) - least(a.x1, c.x1) <= 0.5 AND greatest(a.y0, c.y0) - least(a.y1, c.y1) <= 0.5),
r AS (SELECT page, i, j FROM e UNION SELECT r.page, r.i, e.j FROM r JOIN e ON r.page = e.page AND r.j = e.i), m AS (SELECT page, i, min(j) AS root FROM r GROUP BY 1, 2)
SELECT m.page, root AS idx, string_agg(name::VARCHAR, '+' ORDER BY idx) AS name, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM m JOIN b ON b.page = m.page AND b.idx = m.i GROUP BY 1, 2""")
def image_merge(spark: SparkSession, sf: str) -> DataFrame:
    return layout.merge_boxes(_boxes(spark, sf)).drop("pdf_name")


@query()
def anchor_text(spark: SparkSession, sf: str) -> DataFrame:
    boxes = layout.merge_boxes(_boxes(spark, sf))
    k = F.col("doc_id")
    texts = docs(spark, sf).select(F.lit("d").alias("pdf_name"), (k % 40).cast("int").alias("page"), k.cast("int").alias("idx"), "text", (k * 13 % 600).cast("double").alias("x"), (k * 7 % 800).cast("double").alias("y"))
    sizes = texts.select("pdf_name", "page").distinct().select("pdf_name", "page", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))
    return layout.anchor_text(sizes, boxes, texts)


# Data sets.


def _examples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "pages").select(F.concat(F.lit("site_page_"), F.col("page_id").cast("string")).alias("stem"), F.col("url").alias("path"), "html")
    d = docs(spark, sf).select(F.concat("source", F.lit("_page_"), F.col("doc_id").cast("string")).alias("stem"), F.col("source").alias("path"), _yaml().alias("yaml"))
    images = p.select("stem").unionAll(d.where("stem not like '%0'").select("stem")).select("stem", F.concat(F.lit("images/"), "stem", F.lit(".png")).alias("image"))
    anchors = docs(spark, sf).where("doc_id % 2 = 0").select(F.col("source").alias("pdf_name"), F.col("doc_id").cast("int").alias("page"), F.lit("Page dimensions: 612.0x792.0\n").alias("anchor"))
    return datasets.from_html(p, images, anchors, TEMPLATE), datasets.from_yaml(d, images, anchors, TEMPLATE)


@query("""SELECT 'site' AS pdf_name, page_id::INT AS page, false AS from_yaml FROM pages UNION ALL SELECT source, doc_id::INT, true FROM documents WHERE doc_id % 10 <> 0""")
def sft_union(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.build_sft(*_examples(spark, sf)).select("pdf_name", "page", F.col("metadata.generated_by").isNotNull().alias("from_yaml"))


@query("""SELECT ['images/' || source || '_page_' || doc_id || '.png'][1] AS image FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 3 <> 0""")
def sft_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and loaded again; a third of the images is missing, and one line is broken."""
    lines = datasets.sft_lines(_examples(spark, sf)[1]).unionAll(spark.range(1).select(F.lit("{broken").alias("value")))
    there = docs(spark, sf).where("doc_id % 3 <> 0").select(F.concat(F.lit("images/"), "source", F.lit("_page_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"))
    return datasets.load_sft(lines, there)[0].select(F.get("images", F.lit(0)).alias("image"))


@query("""SELECT source AS pdf_name, doc_id::INT AS page_num, 'images/' || doc_id || '.png' AS image, doc_id % 2 = 0 AS anchored FROM documents WHERE doc_id % 3 <> 0""")
def rlvr_dataset(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    images = d.select(F.concat("source", F.lit("_page_"), F.col("doc_id").cast("string")).alias("stem"), F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image"))
    tests = d.select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2))).alias("k")).select(F.concat_ws("_", "doc_id", "k").alias("id"), F.lit("order").alias("type"), F.concat("source", F.lit(".pdf")).alias("pdf"), F.col("doc_id").cast("int").alias("page"))
    for f in datasets.PAGE_TEST:
        if f.name not in tests.columns:
            tests = tests.withColumn(f.name, F.lit(None).cast(f.dataType))
    anchors = d.where("doc_id % 2 = 0").select(F.col("source").alias("pdf_name"), F.col("doc_id").cast("int").alias("page"), F.lit("x").alias("anchor"))
    out = datasets.build_rlvr(images, tests, anchors, TEMPLATE)
    return out.select("pdf_name", "page_num", "image", F.contains("prompt", F.lit("<|anchor_start|>")).alias("anchored"))


@query("""SELECT p.page_id, coalesce(c.c_custkey * 10, 800)::INT AS width, coalesce(c.c_custkey * 20, 1000)::INT AS height FROM pages p LEFT JOIN customer c ON c.c_custkey = p.page_id AND c.c_custkey % 2 = 0""")
def sidecar_join(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("stem"))
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("stem"), (F.col("c_custkey") * 10).cast("int").alias("width"), (F.col("c_custkey") * 20).cast("int").alias("height"))
    return datasets.with_sidecar(p, c).select("page_id", "width", "height")


@query("SELECT page_id FROM pages WHERE page_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def html_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("stem"))
    c = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("stem"))
    return datasets.complete_pairs(p, c).select("page_id")


@query()
def translation_record(spark: SparkSession, sf: str) -> DataFrame:
    out = translation.translation_records(docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), _yaml().alias("yaml")))
    return out.select("document_id", "primary_language", "is_table", F.size("sentences").alias("n_sentences"), F.size("tables").alias("n_tables"), "error")


# Streams: each is read as one, up to what is there, and gives what a batch would.


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    return jobs.stream_parquet(spark, sf, table(spark, sf, "events").schema, pattern="events.parquet")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the watermark has closed, and those still open when all is read."""
    from ..streaming import jobs

    at = f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.stream_throughput(_events_stream(spark, sf), at, f"{at}/checkpoint", late="400 days", shares=1)
    closed = spark.read.schema("window_start timestamp_ntz, event_type string, n long").parquet(f"{at}/closed").select("window_start", "event_type", "n")
    return closed.unionByName(jobs.open_windows(spark, f"{at}/checkpoint"))


@query(f"SELECT kind, count(*) AS n FROM (SELECT {_KIND} AS kind FROM events) WHERE kind IS NOT NULL GROUP BY kind")
def log_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..streaming import jobs

    counts = jobs.log_counts(_log_of(_events_stream(spark, sf)).select("line_no", "line"))
    return jobs.counted(counts, "counts", f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The events table read as a stream of files, counted until all that is there is read."""
    from ..streaming import jobs

    counts = _events_stream(spark, sf).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return jobs.counted(counts, "counts", f"{sinks.shared_folder(spark)}/stream-{uuid.uuid4().hex}")
