"""Page layout: boxes that touch are merged, elements become an anchor text within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import fixed
from ..functions.text import clean_anchor, stable_order, strip
from ..schemas import schema

KEY = ("pdf_name", "page")
MERGED = schema("pdf_name string, page int, idx int, name string, x0 double, y0 double, x1 double, y1 double")


def _groups(boxes: list[tuple], tolerance: float) -> list[list[int]]:
    """Which of a page's boxes (x0, y0, x1, y1) belong together, by their first. A sweep over x compares only boxes whose
    x ranges come within reach; a box without a coordinate stays alone."""
    root = list(range(len(boxes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    whole = [i for i, b in enumerate(boxes) if None not in b]
    active: list[int] = []
    for i in sorted(whole, key=lambda i: boxes[i][0]):
        x0, y0, _, y1 = boxes[i]
        active = [j for j in active if x0 - boxes[j][2] <= tolerance]
        for j in active:
            if max(y0, boxes[j][1]) - min(y1, boxes[j][3]) <= tolerance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        active.append(i)
    out: dict[int, list[int]] = {}
    for i in range(len(boxes)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def _merged(page: list[tuple], tolerance: float) -> list[tuple]:
    boxes = [r[4:] for r in page]
    known = lambda f, k, some: f((boxes[i][k] for i in some if boxes[i][k] is not None), default=None)
    return [(*page[some[0]][:3], "+".join(page[i][3] for i in some), known(min, 0, some), known(min, 1, some), known(max, 2, some), known(max, 3, some)) for some in _groups(boxes, tolerance)]


def merge_boxes(boxes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(pdf_name, page, idx, name, x0, y0, x1, y1): boxes of a page with gaps of at most `tolerance` in both axes are one,
    through any number of others; names are joined by + in order, idx is the first member's.

    Pages stream through in Arrow batches; one page's boxes are held at a time."""
    kinds = [f.type for f in to_arrow_schema(MERGED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], MERGED.names)

        page: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if page and row[:2] != page[0][:2]:
                    out += _merged(page, tolerance)
                    page = []
                page.append(row)
            if out:
                yield given(out)
        if page:
            yield given(_merged(page, tolerance))

    rows = boxes.select("pdf_name", F.col("page").cast("int").alias("page"), F.col("idx").cast("int").alias("idx"), F.coalesce("name", F.lit("")).alias("name"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "idx").mapInArrow(run, MERGED)


def anchor_text(pages: DataFrame, images: DataFrame, texts: DataFrame, budget: int = 4000, seed: int = 42) -> DataFrame:
    """(pdf_name, page, anchor): pages (pdf_name, page, width, height) with their merged images (idx, x0..y1) and texts
    (idx, text, x, y). If all fits the budget, images then texts in order. Else the elements at the page's edges, then
    others in md5 order up to the first that overflows, by position. A budget under 20 leaves the first line."""
    head = F.concat(F.lit("Page dimensions: "), fixed(F.col("width"), 1), F.lit("x"), fixed(F.col("height"), 1), F.lit("\n"))
    pages = pages.select(*KEY, head.alias("head"))
    if budget < 20:
        return pages.select(*KEY, F.col("head").alias("anchor"))
    n = lambda c: fixed(F.col(c), 0)
    shown = F.concat(F.lit("[Image "), n("x0"), F.lit("x"), n("y0"), F.lit(" to "), n("x1"), F.lit("x"), n("y1"), F.lit("]\n"))
    a = images.select(*KEY, F.lit(0).alias("kind"), "idx", F.col("x0").alias("x"), F.col("y0").alias("y"), "x1", "y1", shown.alias("s"))
    b = texts.where(strip(F.col("text")) != "").select(*KEY, F.lit(1).alias("kind"), "idx", "x", "y", F.col("x").alias("x1"), F.col("y").alias("y1"), F.concat(F.lit("["), n("x"), F.lit("x"), n("y"), F.lit("]"), clean_anchor(F.col("text")), F.lit("\n")).alias("s"))
    every = a.unionByName(b).withColumn("o", stable_order(*KEY, "kind", "idx", seed=seed))
    every = every.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("kind", "idx", "x", "y", "x1", "y1", "o", "s"))).alias("_e"))
    edge = lambda kind, pick, side, sign: pick(F.transform(F.filter("_e", lambda e: e["kind"] == kind), lambda e: F.struct(e[side].alias("p"), (e["idx"] * sign).alias("q"))))["q"] * sign
    ends = [F.array(edge(k, F.array_min, "x", 1), edge(k, F.array_max, "x1", -1), edge(k, F.array_min, "y", 1), edge(k, F.array_max, "y1", -1)) for k in (0, 1)]
    size = lambda e: F.coalesce(F.length(e["s"]), F.lit(0))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda t, e: t + size(e))
    rows = every.withColumn("_ends", F.array(*ends)).withColumn("_edges", F.filter("_e", lambda e: F.array_contains(F.col("_ends")[e["kind"]], e["idx"])))
    rest = F.filter("_e", lambda e: ~F.array_contains(F.col("_ends")[e["kind"]], e["idx"]))
    rows = pages.join(rows, list(KEY), "left").withColumn("_all", F.length("head") + total(F.coalesce("_e", F.array())))
    rows = rows.withColumn("_rest", F.when(F.col("_all") > budget, F.array_sort(F.transform(rest, lambda e: F.struct(e["o"].alias("o"), e["kind"].alias("kind"), e["idx"].alias("idx"), e["x"].alias("x"), e["y"].alias("y"), e["s"].alias("s"))))))
    # How many of the rest come before the first that overflows.
    start = F.struct((F.length("head") + total("_edges")).alias("upto"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    more = lambda t, e: F.struct((t["upto"] + size(e)).alias("upto"), (t["n"] + F.when(t["open"] & (t["upto"] + size(e) <= budget), 1).otherwise(0)).alias("n"), (t["open"] & (t["upto"] + size(e) <= budget)).alias("open"))
    fit = F.slice("_rest", F.lit(1), F.aggregate("_rest", start, more)["n"])
    placed = lambda c: F.transform(c, lambda e: F.struct(e["x"].cast("double").alias("x"), e["y"].cast("double").alias("y"), e["kind"].alias("kind"), e["idx"].cast("int").alias("idx"), e["s"].alias("s")))
    joined = lambda c: F.array_join(F.transform(c, lambda e: e["s"]), "")
    text = F.when(F.col("_all") > budget, joined(F.array_sort(F.concat(placed("_edges"), placed(fit))))).otherwise(joined(F.col("_e")))
    return rows.select(*KEY, F.concat("head", F.coalesce(text, F.lit(""))).alias("anchor"))
