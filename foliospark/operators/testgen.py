"""Page tests derived from parsed pages: presence, absence, table, order, math and formatting.

Every generator takes pages that functions.html.parse_pages has parsed, with pdf_name and page, and returns rows of
schemas.PAGE_TEST. Samples are drawn by md5 order (functions.text.stable_order), so a rerun gives the same tests.

All families but the tables' are arrays of drafts on the page's row, so they need no exchange; cells meet once, by table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import BODY_TAGS, HEADINGS
from ..functions.text import allowed_diffs, clip, stable_order, strip
from ..schemas import PAGE_TEST

KEY = ("pdf_name", "page")
#: Tags that formatting tests are made of.
FORMATTED = ("strong", "b", "em", "i", *HEADINGS)


#: What a family says about a test before it has its id; `seq` tells equal contents apart.
DRAFT = "struct<kind:string,short:string,content:string,seq:int,text:string,max_diffs:int,before:string,after:string,latex:string,format_type:string>"


def _drafts(found: Column, kind: str, short: str, make) -> Column:
    """An array of DRAFT: make(x) gives the fields of each x of `found` that are set."""

    def draft(x: Column) -> Column:
        made = {"kind": F.lit(kind), "short": F.lit(short)} | make(x)
        names = [f.split(":")[0] for f in DRAFT[len("struct<") : -1].split(",")]
        return F.struct(*[made.get(n, F.lit(None)).alias(n) for n in names]).cast(DRAFT)

    return F.coalesce(F.transform(found, draft), F.array().cast(f"array<{DRAFT}>"))


def _body(parts: str, tags: tuple[str, ...] | list[str], least: int) -> Column:
    """The page's nodes of these tags with texts of `least` characters or more, outside headers, footers and asides."""
    return F.filter(f"{parts}.nodes", lambda n: n["tag"].isin(*tags) & ~n["in_chrome"] & (F.length(n["text"]) >= least))


def _sampled(found: Column, k: int, seed: int, salt: str) -> Column:
    """Up to k nodes in md5 order."""
    keyed = F.transform(found, lambda n: F.struct(stable_order(F.lit(salt), *KEY, n["seq"], seed=seed).alias("o"), n["seq"].alias("seq"), n["text"].alias("text")))
    return F.slice(F.array_sort(keyed), F.lit(1), F.lit(k))


def _made(parsed: DataFrame, *families: Column) -> DataFrame:
    """Rows of PAGE_TEST for all drafts of a page."""
    rows = parsed.select(*KEY, F.explode(F.concat(*families)).alias("d")).select(*KEY, "d.*")
    return _tests(rows, F.col("kind"), F.col("short"), F.col("content"), **{c: c for c in ("text", "max_diffs", "before", "after", "latex", "format_type")})


def _tests(df: DataFrame, kind: Column | str, short: Column | str, content: Column, **columns: Column | str) -> DataFrame:
    """Rows of PAGE_TEST from df with seq; the id is a digest of what the test says and where it was found."""
    short = F.lit(short) if isinstance(short, str) else short
    digest = F.left(F.md5(F.concat_ws("|", content, F.col("seq").cast("string")).cast("binary")), F.lit(8))
    made = {
        "id": F.concat(F.col("pdf_name"), F.lit("_p"), F.col("page").cast("string"), F.lit("_"), short, F.lit("_"), digest),
        "type": F.lit(kind) if isinstance(kind, str) else kind,
        "pdf": F.concat(F.col("pdf_name"), F.lit(".pdf")),
        "page": F.col("page"),
    } | {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PAGE_TEST])


def presence_drafts(seed: int = 42, k: int = 5, parts: str = "page_parts") -> Column:
    """Up to k body texts of 15 characters or more outside headers, footers and asides, cut at 200."""

    def make(n: Column) -> dict[str, Column]:
        text = clip(n["text"], 200)
        return {"content": text, "seq": n["seq"], "text": text, "max_diffs": allowed_diffs(text)}

    return _drafts(_sampled(_body(parts, BODY_TAGS, 15), k, seed, "tp"), "text_presence", "tp", make)


def absence_drafts(parts: str = "page_parts") -> Column:
    """Every header, footer and aside of 3 characters or more."""
    found = F.filter(f"{parts}.nodes", lambda n: n["tag"].isin("header", "footer", "aside") & (F.length(n["text"]) >= 3))
    return _drafts(found, "text_absence", "ta", lambda n: {"content": n["text"], "seq": n["seq"], "text": n["text"], "max_diffs": F.lit(0)})


def presence_tests(parsed: DataFrame, seed: int = 42, k: int = 5) -> DataFrame:
    """The presence tests of parsed pages."""
    return _made(parsed, presence_drafts(seed, k))


def table_cells(parsed: DataFrame, parts: str = "page_parts") -> DataFrame:
    """A row for each cell of each table of two rows or more, ragged rows padded with empty cells: (key, table_idx,
    row_idx, col_idx, text, head_row, up, down, left, right, heading); what is empty is null."""
    cells = parsed.select(*KEY, F.explode(f"{parts}.cells").alias("c")).select(*KEY, "c.*")
    t = (*KEY, "table_idx")
    rows = cells.repartition(*t).groupBy(*t, "row_idx").agg(F.max("head_row").alias("head_row"), F.map_from_entries(F.collect_list(F.struct("col_idx", "text"))).alias("by_col"), F.max("col_idx").alias("_col"))
    table = Window.partitionBy(*t)
    rows = rows.select("*", F.min("row_idx").over(table).alias("first_row"), F.max("row_idx").over(table).alias("last_row"), F.max("_col").over(table).alias("last_col"), F.lead("row_idx").over(table.orderBy("row_idx")).alias("next"))
    # Rows without cells lie between two others.
    every = rows.where("last_row > 0 and first_row = 0").withColumn("at", F.explode(F.sequence("row_idx", F.coalesce(F.col("next") - 1, F.col("row_idx")))))
    here = F.col("at") == F.col("row_idx")
    grid = every.select(*t, F.col("at").alias("row_idx"), (here & F.coalesce("head_row", F.lit(False))).alias("head_row"), F.explode(F.sequence(F.lit(0), "last_col")).alias("col_idx"), F.when(here, F.col("by_col")).alias("by_col"))
    grid = grid.withColumn("text", F.coalesce(F.col("by_col")[F.col("col_idx")], F.lit(""))).drop("by_col")
    return neighbours(grid)


def neighbours(grid: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """grid with what stands above, below, left, right and, for rows that aren't header rows, in the first header row."""
    column = Window.partitionBy(*key, "table_idx", "col_idx").orderBy("row_idx")
    row = Window.partitionBy(*key, "table_idx", "row_idx").orderBy("col_idx")
    some = lambda c: F.nullif(c, F.lit(""))
    head = F.min_by("text", F.when(F.col("head_row"), F.col("row_idx"))).over(Window.partitionBy(*key, "table_idx", "col_idx"))
    return grid.select("*", some(F.lag("text").over(column)).alias("up"), some(F.lead("text").over(column)).alias("down"), some(F.lag("text").over(row)).alias("left"), some(F.lead("text").over(row)).alias("right"), F.when(~F.col("head_row"), some(head)).alias("heading"))


def table_tests(cells: DataFrame, seed: int = 42, rows: int = 3, cols: int = 2) -> DataFrame:
    """Cells of up to 3 rows (no header rows, unless there are no others) and 2 columns of each table, of 2 characters
    or more and with at least one neighbour or heading."""
    t = (*KEY, "table_idx")
    body = cells.withColumn("_body", F.min("head_row").over(Window.partitionBy(*t))).where(~F.col("head_row") | F.col("_body"))
    body = body.withColumn("_r", F.dense_rank().over(Window.partitionBy(*t).orderBy(stable_order(F.lit("tr"), *t, "row_idx", seed=seed), "row_idx")))
    body = body.withColumn("_c", F.dense_rank().over(Window.partitionBy(*t).orderBy(stable_order(F.lit("tc"), *t, "col_idx", seed=seed), "col_idx")))
    near = F.coalesce("up", "down", "left", "right", "heading").isNotNull()
    body = body.where((F.col("_r") <= rows) & (F.col("_c") <= cols) & (F.length("text") >= 2) & near)
    body = body.withColumn("seq", F.concat_ws(".", "table_idx", "row_idx", "col_idx"))
    return _tests(body, "table", F.concat(F.lit("tbl"), F.col("table_idx").cast("string")), F.col("text"), cell="text", max_diffs=F.lit(0), up="up", down="down", left="left", right="right", top_heading="heading")


def pair_places(n: Column, k: Column, key: tuple[str, ...], seed: int) -> tuple[Column, Column]:
    """The k-th drawn pair i < j of n texts, by md5 digits."""
    number = lambda salt: F.conv(F.left(stable_order(F.lit(salt), *key, k, seed=seed), F.lit(8)), 16, 10).cast("long")
    i = (number("oi") % (n - 1)).cast("int")
    return i, (i + 1 + number("oj") % (n - 1 - i)).cast("int")


def order_pairs(texts: DataFrame, seed: int = 42, most: int = 3, key: tuple[str, ...] = KEY) -> DataFrame:
    """(key, k, i, j): up to `most` pairs i < j of each key's n texts, drawn with replacement by md5 digits."""
    sizes = texts.groupBy(*key).agg(F.count("*").cast("int").alias("n")).where("n >= 2")
    drawn = sizes.select(*key, "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("n") - 1))).alias("k"))
    i, j = pair_places(F.col("n"), F.col("k"), key, seed)
    return drawn.select(*key, "k", i.alias("i"), j.alias("j"))


def order_drafts(seed: int = 42, most: int = 3, parts: str = "page_parts") -> Column:
    """Up to `most` ordered pairs of body texts of 20 characters or more, cut at 150."""

    def pairs(body: Column) -> Column:
        n = F.size(body)

        def make(k: Column) -> dict[str, Column]:
            first, second = (clip(F.get(body, at)["text"], 150) for at in pair_places(n, k, KEY, seed))
            return {"content": F.concat_ws("|", first, second), "seq": k, "before": first, "after": second}

        return _drafts(F.when(n >= 2, F.sequence(F.lit(1), F.least(F.lit(most), n - 1))), "order", "ord", make)

    return F.get(F.transform(F.array(_body(parts, BODY_TAGS, 20)), pairs), F.lit(0))


def math_drafts(parts: str = "page_parts") -> Column:
    """Formulas of 3 characters or more: math elements, MathJax and KaTeX ones, and \\(..\\), \\[..\\], $$..$$ in the body."""
    body = F.coalesce(F.col(f"{parts}.body"), F.lit(""))
    found = [F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(1)), strip) for p in (r"(?s)\\\((.+?)\\\)", r"(?s)\\\[(.+?)\\\]", r"(?s)\$\$(.+?)\$\$")]
    every = F.transform(F.concat(F.col(f"{parts}.math"), *found), lambda x, at: F.struct(at.alias("seq"), x.alias("latex")))
    return _drafts(F.filter(every, lambda m: F.length(m["latex"]) >= 3), "math", "math", lambda m: {"content": m["latex"], "seq": m["seq"], "latex": m["latex"]})


def formatting_drafts(seed: int = 42, k: int = 3, parts: str = "page_parts") -> Column:
    """All bold texts (3 characters), up to k italic ones (5), all headings (3), outside headers, footers and asides."""
    drafts = lambda found, kind: _drafts(found, "formatting", "fmt", lambda n: {"content": n["text"], "seq": n["seq"], "text": n["text"], "format_type": kind(n)})
    bold = drafts(_body(parts, ("strong", "b"), 3), lambda n: F.lit("bold"))
    italic = drafts(_sampled(_body(parts, ("em", "i"), 5), k, seed, "it"), lambda n: F.lit("italic"))
    return F.concat(bold, italic, drafts(_body(parts, HEADINGS, 3), lambda n: F.concat(F.lit("heading_"), n["tag"])))


def formatting_tests(parsed: DataFrame, seed: int = 42, k: int = 3) -> DataFrame:
    """The formatting tests of parsed pages."""
    return _made(parsed, formatting_drafts(seed, k))


def page_tests(parsed: DataFrame, seed: int = 42) -> DataFrame:
    """All six families of a table of parsed pages."""
    found = _made(parsed, presence_drafts(seed), absence_drafts(), order_drafts(seed), math_drafts(), formatting_drafts(seed))
    return found.unionByName(table_tests(table_cells(parsed), seed))
