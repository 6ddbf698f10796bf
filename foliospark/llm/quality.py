"""Quality rules with adaptive thresholds.

Cutoffs aren't fixed: each (language, source) has its own, read from quantile sketches of its documents. A sketch is a
histogram of relative-error buckets (each GAMMA times the last); histograms add up, so tasks merge theirs in any order
with the same result, and a language's sketch is the sum of its sources'. To a group's sketch come PRIOR_ROWS rows spread
as its language's, so a small group leans on its language and a large one on itself, without a size where rules switch.
The filter is a join with the thresholds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .shingles import WordHashes, mix

#: Buckets grow by this factor: a quantile is within 1 percent.
GAMMA, LEAST = 1.02, 1e-4
#: Rows that a group's sketch gets from its language's, and a language's from that of all.
PRIOR_ROWS = 25
#: A language's groups meet its sketch in this many parts, so that one task doesn't meet all groups of a large one.
PARTS = 16
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A value is too high above median + reach * max(median - tenth percentile, spread): the half below the median sets the
    scale, so bad documents, up to half of a group, don't move the threshold. With low, too low below is found likewise."""

    metric: str
    reach: float
    spread: float
    low: bool = False


RULES = (
    Rule("symbol_ratio", 5.0, 0.02),
    Rule("mean_word_chars", 10.0, 0.15),
    Rule("mean_word_chars", 10.0, 0.15, low=True),
    Rule("dup_line_ratio", 5.0, 0.1),
    Rule("repeat_ratio", 10.0, 0.04),
)
METRICS = tuple(dict.fromkeys(r.metric for r in RULES))
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def measure(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    w = text.encode("utf-8", "surrogatepass").split()
    chars = len(text.translate(_SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.translate(_SPACES):
            seen.add(line)
    n, again = len(w), 0
    if n > 3:
        h = np.fromiter(map(hashes.__getitem__, w), np.uint64, n)
        three = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        _, at, count = np.unique(three, return_inverse=True, return_counts=True)
        if len(count) < len(three):
            hit = count[at] > 1
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            again = int(cover.sum())
    return n, chars, symbols, dup, again


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        rows = np.array([measure(t.as_py(), hashes) for t in batch.column(3)], np.int64).reshape(-1, 5)
        lines = pa.array([(t.as_py() or "").count("\n") + 1 for t in batch.column(3)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(rows[:, k]) for k in range(5)), lines], ["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"])


def sketches(values: DataFrame, groups: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """(groups, metric, bucket, n): the quantile sketch of each metric in each group."""
    long = values.select(*groups, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("m"))
    bucket = F.when(F.col("m.x") < LEAST, -(1 << 20)).otherwise(F.floor(F.log("m.x") / math.log(GAMMA))).cast("int")
    return long.groupBy(*groups, "m.metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, groups: list[str], at: dict[str, float]) -> DataFrame:
    """(groups, metric, one column for each entry of `at`) from sketches: the least bucket end that a share of rows, in
    whole percent, reaches."""
    by = Window.partitionBy(*groups, "metric")
    up = sketch.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("rows", F.sum("n").over(by))
    value = F.when(F.col("bucket") == -(1 << 20), 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") + 1))
    return up.groupBy(*groups, "metric").agg(*[F.min(F.when(F.col("upto") * 100 >= F.col("rows") * round(100 * q), value)).alias(k) for k, q in at.items()])


def blended(fine: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): each group's sketch with PRIOR_ROWS rows of its language's, which has PRIOR_ROWS
    rows of all. Counts aren't divided but multiplied by the other sizes, so they stay whole (to 10^12 rows each)."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    known = lambda a, b: a["lang"].eqNullSafe(b["l"]) & (a["metric"] == b["m"])
    whole = fine.groupBy("metric", "bucket").agg(F.sum("n").alias("n_all"))
    whole = whole.withColumn("all_rows", F.sum("n_all").over(Window.partitionBy("metric")))
    counts = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n_lang"))
    counts = counts.select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("bucket").alias("b"), "n_lang")
    langs = fine.groupBy("lang", "metric").agg(F.sum("n").alias("lang_rows")).join(whole, "metric")
    langs = langs.join(counts, known(langs, counts) & (langs["bucket"] == counts["b"]), "left")
    prior = langs.select(
        F.col("lang").alias("l"),
        F.col("metric").alias("m"),
        "bucket",
        ((F.coalesce(big("n_lang"), F.lit(0)) * big("all_rows") + PRIOR_ROWS * big("n_all")) * PRIOR_ROWS).cast("decimal(38,0)").alias("w"),
        F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"),
    )
    groups = fine.select("lang", "source", "metric").distinct().withColumn("of", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int"))
    theirs = groups.join(prior, known(groups, prior) & (groups["of"] == prior["part"])).select("lang", "source", "metric", "bucket", "w")
    scale = langs.groupBy("lang", "metric").agg(((F.max(big("lang_rows")) + PRIOR_ROWS) * F.max(big("all_rows"))).cast("decimal(38,0)").alias("scale"))
    scale = scale.select(F.col("lang").alias("l"), F.col("metric").alias("m"), "scale", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    own = fine.withColumn("of", F.pmod(F.xxhash64("source"), F.lit(PARTS)).cast("int"))
    own = own.join(scale, known(own, scale) & (own["of"] == scale["part"]))
    own = own.select("lang", "source", "metric", "bucket", (big("n") * F.col("scale")).cast("decimal(38,0)").alias("w"))
    return own.unionAll(theirs).groupBy("lang", "source", "metric", "bucket").agg(F.sum("w").cast("decimal(38,0)").alias("n"))


def thresholds(values: DataFrame, ws: Scratch) -> DataFrame:
    """(lang, source, one pair of bounds for each metric) for every (lang, source) of values."""
    fine = ws.save(sketches(values, ["lang", "source"], METRICS), "sketch")
    at = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
    q = quantiles(blended(fine), ["lang", "source"], at)
    bounds = []
    for r in RULES:
        scale = F.greatest(F.col("q90") - F.col("q50") if r.low else F.col("q50") - F.col("q10"), F.lit(r.spread)) * r.reach
        value = F.col("q50") - scale if r.low else F.col("q50") + scale
        bounds.append(F.max(F.when(F.col("metric") == r.metric, value)).alias(f"{r.metric}_{'low' if r.low else 'high'}"))
    return ws.save(q.groupBy("lang", "source").agg(*bounds), "thresholds")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules) of every row.

    base_failed: fewer than `least_words` words, or over `most_repeats` percent of them repeated. The sketches are of
    the rows that pass; a row is kept if it passes and no metric is beyond the threshold of its language and source. Every
    language and source has thresholds of its own: of its passing rows and PRIOR_ROWS rows spread as its language's, which
    has as many spread as all. A group without passing rows needs none.
    Null texts have no words; null languages and sources are groups like others; a null id stays null; repeated rows
    count and come back as often; other columns are ignored; an empty table gives an empty one."""
    ws = Scratch(df.sparkSession, "quality")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.mapInArrow(_measures, "id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    n = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.select(
        "*",
        ((F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_dup_lines") / F.col("n_lines")).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"),
    )
    rows = ws.save(rows, "rows")
    cut = thresholds(rows.where(~F.col("base_failed")), ws).withColumnRenamed("lang", "l").withColumnRenamed("source", "s")
    out = rows.join(cut, rows["lang"].eqNullSafe(cut["l"]) & rows["source"].eqNullSafe(cut["s"]), "left")
    broken = [F.when(F.col(r.metric) < F.col(f"{r.metric}_low") if r.low else F.col(r.metric) > F.col(f"{r.metric}_high"), F.lit(f"{r.metric} {'low' if r.low else 'high'}")) for r in RULES]
    out = out.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's measures and verdicts of all documents."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract in SQL: a sketch's quantile is the bucket of an order statistic.
OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1) GROUP BY 1
), m AS (
  SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines FROM w LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols::DOUBLE / greatest(n_words, 1) AS symbol_ratio,
    word_chars::DOUBLE / greatest(n_words, 1) AS mean_word_chars, n_dup_lines::DOUBLE / n_lines AS dup_line_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_ratio FROM m
), x AS (
  UNPIVOT (SELECT lang, source, symbol_ratio, mean_word_chars, dup_line_ratio, repeat_ratio FROM v WHERE NOT base_failed)
  ON symbol_ratio, mean_word_chars, dup_line_ratio, repeat_ratio INTO NAME metric VALUE x
), b AS (
  SELECT lang, source, metric, CASE WHEN x < 1e-4 THEN 0 ELSE pow(1.02::DOUBLE, floor(ln(x) / ln(1.02::DOUBLE)) + 1) END AS x FROM x
), fine AS (
  SELECT lang, source, metric, x, count(*)::HUGEINT AS n FROM b GROUP BY ALL
), of_lang AS (
  SELECT lang, metric, x, sum(n) AS n FROM fine GROUP BY ALL
), of_all AS (
  SELECT metric, x, sum(n) AS n FROM fine GROUP BY ALL
), langs AS (
  SELECT lang, metric, sum(n) AS c FROM fine GROUP BY ALL
), whole AS (
  SELECT metric, sum(n) AS c FROM fine GROUP BY ALL
), prior AS (
  SELECT g.lang, g.metric, a.x, coalesce(l.n, 0) * t.c + 25 * a.n AS w, (g.c + 25) * t.c AS scale FROM langs g JOIN of_all a ON g.metric = a.metric JOIN whole t ON g.metric = t.metric
  LEFT JOIN of_lang l ON g.lang IS NOT DISTINCT FROM l.lang AND g.metric = l.metric AND a.x = l.x
), s AS (
  SELECT g.lang, g.source, g.metric, p.x, coalesce(f.n, 0) * p.scale + 25 * p.w AS w FROM (SELECT DISTINCT lang, source, metric FROM fine) g
  JOIN prior p ON g.lang IS NOT DISTINCT FROM p.lang AND g.metric = p.metric
  LEFT JOIN fine f ON g.lang IS NOT DISTINCT FROM f.lang AND g.source IS NOT DISTINCT FROM f.source AND g.metric = f.metric AND p.x = f.x
), up AS (
  SELECT lang, source, metric, x, sum(w) OVER (PARTITION BY lang, source, metric ORDER BY x) AS upto, sum(w) OVER (PARTITION BY lang, source, metric) AS n FROM s
), q AS (
  SELECT lang, source, metric, min(x) FILTER (upto * 100 >= n * 10) AS q10, min(x) FILTER (upto * 100 >= n * 50) AS q50, min(x) FILTER (upto * 100 >= n * 90) AS q90 FROM up GROUP BY ALL
), k AS (
  SELECT lang, source, max(CASE WHEN metric = 'symbol_ratio' THEN q50 + 5 * greatest(q50 - q10, 0.02) END) AS sh, max(CASE WHEN metric = 'mean_word_chars' THEN q50 + 10 * greatest(q50 - q10, 0.15) END) AS mh,
    max(CASE WHEN metric = 'mean_word_chars' THEN q50 - 10 * greatest(q90 - q50, 0.15) END) AS ml, max(CASE WHEN metric = 'dup_line_ratio' THEN q50 + 5 * greatest(q50 - q10, 0.1) END) AS dh,
    max(CASE WHEN metric = 'repeat_ratio' THEN q50 + 10 * greatest(q50 - q10, 0.04) END) AS rh FROM q GROUP BY ALL
), f AS (
  SELECT v.*, array_to_string([y for y in [CASE WHEN symbol_ratio > sh THEN 'symbol_ratio high' END, CASE WHEN mean_word_chars > mh THEN 'mean_word_chars high' END, CASE WHEN mean_word_chars < ml THEN 'mean_word_chars low' END,
    CASE WHEN dup_line_ratio > dh THEN 'dup_line_ratio high' END, CASE WHEN repeat_ratio > rh THEN 'repeat_ratio high' END] if y IS NOT NULL], ',') AS failed_rules
  FROM v LEFT JOIN k ON v.lang IS NOT DISTINCT FROM k.lang AND v.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
