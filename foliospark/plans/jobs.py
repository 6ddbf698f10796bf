"""Whole jobs over folders, the command line's functions: each reads, transforms and writes once."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..functions.html import inject_viewport, page_document, parse_pages
from ..functions.html import html_of_completion as html_answer
from ..functions.tables import sentences_to_html, text_to_html
from ..functions.text import build_prompt, page_key
from ..functions.yamlio import format_yaml, parse_yaml_page, yaml_of_completion
from ..operators import datasets, evaluate, pages, progress, sampling, testgen, translation
from ..schemas import schema
from ..sources import pdf, providers, readers, render, sinks

KEY = ("pdf_name", "page")
NO_ANCHORS = "pdf_name string, page int, anchor string"


def keyed(df: DataFrame, fallback: bool = False) -> DataFrame:
    """df with the pdf_name and page of its stem; without `fallback`, stems that name no page are left out."""
    out = df.withColumn("_k", page_key(F.col("stem"), fallback))
    return out.where("_k is not null").select("*", "_k.pdf_name", "_k.page").drop("_k")


def images_in(spark: SparkSession, path: str) -> DataFrame:
    return readers.list_files(spark, path, "*.png").select("stem", F.col("path").alias("image"))


def make_tests(spark: SparkSession, html_dir: str, out: str, seed: int = 42) -> DataFrame:
    """Tests of a folder of HTML pages as JSON lines; counts by type come back."""
    parsed = sinks.written_once(parse_pages(keyed(readers.read_html(spark, html_dir), True)), "parsed")
    tests = testgen.page_tests(parsed, seed)
    sinks.write_jsonl(tests, out)
    return readers.read_tests(spark, out).groupBy("type").count().orderBy("type")


def evaluate_texts(spark: SparkSession, tests: str, texts_dir: str, pattern: str = "*.txt") -> DataFrame:
    """Results of a folder of texts, named like their pages, against tests from JSON lines."""
    texts = keyed(readers.read_texts(spark, texts_dir, pattern, "ocr_text"), True).select(*KEY, "ocr_text")
    return evaluate.evaluate(evaluate.join_tests(texts, readers.read_tests(spark, tests)))


def prepare_sft(spark: SparkSession, out: str, template: str, images_dir: str, html_dir: str | None = None, yaml_dir: str | None = None, anchors: DataFrame | None = None) -> int:
    """Supervised examples of HTML and YAML pages as JSON lines."""
    images = images_in(spark, images_dir)
    anchors = spark.createDataFrame([], NO_ANCHORS) if anchors is None else anchors
    html = datasets.from_html(readers.read_html(spark, html_dir), images, anchors, template) if html_dir else None
    yaml = datasets.from_yaml(readers.read_yaml(spark, yaml_dir), images, anchors, template) if yaml_dir else None
    sinks.write_lines(datasets.sft_lines(datasets.build_sft(html, yaml)), out)
    return readers.read_lines(spark, out).count()


def prepare_rl(spark: SparkSession, tests: str, images_dir: str, out: str, template: str, min_tests: int = 2, anchors: DataFrame | None = None) -> int:
    """Examples with their tests as JSON lines."""
    anchors = spark.createDataFrame([], NO_ANCHORS) if anchors is None else anchors
    sinks.write_jsonl(datasets.build_rlvr(images_in(spark, images_dir), readers.read_tests(spark, tests), anchors, template, min_tests), out)
    return readers.read_lines(spark, out).count()


def html_to_yaml(spark: SparkSession, html_dir: str, out: str) -> None:
    """A YAML record for each HTML page, tables as markdown; a folder for each document."""
    p = F.col("page_parts")
    rows = parse_pages(keyed(readers.read_html(spark, html_dir), True))
    y = format_yaml(p["main_markdown"], p["lang"], p["is_table"], p["is_diagram"], document_id=F.col("stem"))
    sinks.write_by_document(rows.select("stem", y.alias("yaml")), out, "yaml", "stem")


def yaml_to_html(spark: SparkSession, yaml_dir: str, out: str, css: str = "") -> None:
    """An HTML document for each YAML page; pages without a record say so."""
    rows = readers.read_yaml(spark, yaml_dir).select("stem", parse_yaml_page("yaml").alias("p"))
    body = F.when(F.col("p.error").isNotNull(), "<p><em>(No content)</em></p>").otherwise(text_to_html(F.col("p.natural_text")))
    sinks.write_by_document(rows.select("stem", page_document(body, F.col("p.primary_language"), css).alias("html")), out, "html", "stem")


def records_to_html(records: DataFrame, css: str = "") -> DataFrame:
    """(document_id, html) of translation records."""
    body = sentences_to_html(F.col("sentences"), F.col("tables"))
    return records.select("document_id", page_document(body, F.col("primary_language"), css).alias("html"))


def translate(spark: SparkSession, yaml_dir: str, out: str) -> DataFrame:
    """Translation records of YAML pages as a folder of YAML documents; pages that are no records come back."""
    records = sinks.written_once(translation.translation_records(readers.read_yaml(spark, yaml_dir).withColumnRenamed("stem", "document_id")), "records")
    good, bad = records.where("error is null"), records.where("error is not null")
    sinks.write_lines(translation.yaml_documents(good), out)
    return bad.select("document_id", "error")


def linearize(spark: SparkSession, results: str, out: str) -> None:
    """Linear text of documents from JSON lines of page results (pdf_name, page, natural_text)."""
    rows = spark.read.schema("pdf_name string, page int, natural_text string").json(results)
    sinks.write_by_document(pages.linearize(rows), out, "text")


#: What is kept of an answer that tells whether its page must be asked for again.
ANSWERED = "answer string, error string, pdf_name string, page int"


def answer_in_batches(todo: DataFrame, ask: Callable[[DataFrame], DataFrame], out: str, batch: int, partitions: int, stopped: Callable[[], bool] = lambda: False) -> None:
    """ask(rows) of todo added to the folder `out`, `batch` rows at a time: a stream over todo's rows, written as small
    files first, whose micro-batches are committed one by one. A run that is killed keeps all batches before the one
    under way, and an executor that is lost asks its rows of that batch again, no others. A batch replaces its own folder,
    so one that runs again is there once. After each batch, stopped() says whether the rest is left out."""
    spark, n = todo.sparkSession, -(-batch // partitions)
    at, run = f"{sinks.shared_folder(todo.sparkSession)}/requests-{uuid.uuid4().hex}", uuid.uuid4().hex
    rows = sinks.written_once(todo, "todo")
    files = -(-rows.count() // n)
    if not files:
        return
    rows.repartition(files).write.parquet(f"{at}/rows")

    def write(part: DataFrame, epoch: int) -> None:
        if not stopped():
            ask(part.repartition(partitions)).write.mode("overwrite").parquet(f"{out}/run={run}/epoch={epoch}")
        if stopped():
            raise RuntimeError("the run has stopped")

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", partitions).parquet(f"{at}/rows")
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not stopped():
            raise


def answers(spark: SparkSession, path: str, shape: T.StructType) -> DataFrame:
    """All answers of all runs below a folder; none where it isn't there yet."""
    if not sinks.exists(spark, path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path).select(*shape.names)


def generate(requests: DataFrame, done: list[DataFrame], template: str, out: str, open_provider: Callable[[], providers.Provider] = providers.Stub, policy: providers.Policy = providers.Policy(), kind: str = "yaml", partitions: int = 4, at_once: int = 2, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(pages, dead letters) for the requests (pdf_name, page, anchor, width) that no output in `done` and no good answer
    in the folder `out` has. `partitions` providers work at a time, each on `at_once` pages. An answer without a page is
    an error like a failed call.

    Answers are added to `out`, `batch` of them at a time, before they are told apart, so a page is asked for once,
    however often the results are read; a rerun asks again for what failed or wasn't asked. A call with a price stops the
    run: what was answered by then is kept, CostIncurred is raised."""
    spark, spec = requests.sparkSession, schema(ANSWERED)
    before = answers(spark, out, spec)
    todo = pages.todo(requests, *done, before.where("error is null")).withColumn("prompt", build_prompt(F.col("anchor"), template))
    answer: Column = yaml_of_completion(F.col("answer")) if kind == "yaml" else html_answer(F.col("answer"))

    def ask(part: DataFrame) -> DataFrame:
        got = providers.complete(part, open_provider, policy, at_once, flag.flag).withColumn(kind, answer)
        got = got.withColumn("error", F.when(F.col("error").isNull() & F.col(kind).isNull(), F.lit("no page in the answer")).otherwise(F.col("error")))
        if kind == "html":
            got = got.withColumn("html", inject_viewport(F.col("html"), F.col("width")))
        return got.withColumn("asked_at", F.current_timestamp())

    with providers.RunFlag(spark) as flag:
        shape = ask(todo).schema
        answer_in_batches(todo, ask, out, batch, partitions, lambda: flag.why is not None)
    if flag.why is not None:
        raise providers.CostIncurred(flag.why)
    rows = answers(spark, out, shape).join(requests.select(*KEY).distinct(), list(KEY), "left_semi")
    for d in done:
        rows = rows.join(d.select(*KEY).distinct(), list(KEY), "left_anti")
    last = Window.partitionBy(*KEY).orderBy(F.col("error").isNotNull(), F.desc("asked_at"))
    rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "asked_at")
    return pages.split_errors(rows)


def keep_pages(good: DataFrame, bad: DataFrame, out: str, kind: str) -> None:
    """Pages of `generate` as texts and sidecars below `out`, and its failures as dead letters in `out`/failed; pages that
    an earlier run has written aren't written again."""
    spark = good.sparkSession
    rows = good.select(F.concat_ws("_page_", "pdf_name", "page").alias("stem"), kind, "page", F.concat("pdf_name", F.lit(".pdf")).alias("source"), "width", geometry.a4_height(F.col("width")).alias("height"), "provider", "total_tokens")
    if sinks.exists(spark, f"{out}/sidecars"):
        rows = rows.join(spark.read.schema("stem string").json(f"{out}/sidecars"), "stem", "left_anti")
    with_sidecar(sinks.written_once(rows, "pages"), out, kind)
    sinks.append_dead_letters(bad.select(F.current_timestamp().alias("ts"), *KEY, F.col("error").alias("reason")), f"{out}/failed")


def count_pages(spark: SparkSession, path: str, open_engine: Callable[[], pdf.PdfEngine] = pdf.Offline) -> DataFrame:
    """(folder, pdf_name, n_pages, error) of the PDF files below a folder; folder is the one a file is in."""
    rows = pdf.page_counts(readers.read_files(spark, path), open_engine)
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.col("stem").alias("pdf_name"), "n_pages", "error")


def sample_documents(documents: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Documents in reproducible random order until their pages reach the target."""
    return sampling.to_budget(documents, "n_pages", target, "pdf_name", seed=seed)


def coverage_report(documents: DataFrame, done: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """progress.coverage of the documents' pages by folder, with per_minute (the pages of the log's last session over the
    minutes between its first and last line) and hours_left at that speed."""
    out = progress.coverage(pages.expected_pages(documents), done)
    if log is None:
        return out.withColumns({"per_minute": F.lit(0.0), "hours_left": F.lit(None).cast("double")})
    last = progress.last_session(log)
    span = (F.unix_timestamp(F.max("ts").cast("timestamp")) - F.unix_timestamp(F.min("ts").cast("timestamp"))) / 60.0
    pace = last.agg(progress.speed(F.count_if(F.col("kind") == "done").cast("double"), F.coalesce(span, F.lit(0.0))).alias("per_minute"))
    return out.crossJoin(F.broadcast(pace)).withColumn("hours_left", progress.eta_hours(F.col("remaining"), F.col("per_minute")))  # one row


def with_sidecar(rows: DataFrame, out: str, page: str = "yaml") -> None:
    """Pages (stem, the page's text, and what else is known of it) as texts below `out`/pages and, beside them, one JSON
    line a page below `out`/sidecars."""
    sinks.write_by_document(rows.select("stem", page), f"{out}/pages", page, "stem", mode="append")
    sinks.write_jsonl(rows.drop(page), f"{out}/sidecars", mode="append")


def run_all(spark: SparkSession, requests: DataFrame, template: str, out: str, open_provider: Callable[[], providers.Provider], open_renderer: Callable[[], render.Renderer] = render.Blank, policy: providers.Policy = providers.Policy(), seed: int = 42, batch: int = 64) -> DataFrame:
    """HTML pages from a provider, with sidecars, their images and their tests, below `out`; what an earlier run has made
    isn't made again. `template` must ask for HTML. Returns (step, rows): what is there now."""
    good, bad = generate(requests, [], template, f"{out}/answers", open_provider, policy, kind="html", batch=batch)
    keep_pages(good, bad, out, "html")
    pages_ = good.select(F.concat_ws("_page_", "pdf_name", "page").alias("stem"), *KEY, "html", "width")
    made = answers(spark, f"{out}/images", render.RENDERED).select("stem").distinct()
    todo = pages_.join(made, "stem", "left_anti").select("stem", "html", "width", F.lit(None).cast("int").alias("height"))
    images = render.render_manifest(render.render_pages(todo, open_renderer=open_renderer), f"{out}/images")
    tests = testgen.page_tests(sinks.written_once(parse_pages(pages_), "parsed"), seed)
    sinks.write_jsonl(tests, f"{out}/tests", mode="overwrite")
    steps = {"pages": pages_, "failed": bad, "images": images.where("error is null").select("stem").distinct(), "tests": readers.read_tests(spark, f"{out}/tests")}
    return reduce(DataFrame.unionAll, [d.agg(F.count("*").alias("rows")).select(F.lit(k).alias("step"), "rows") for k, d in steps.items()])


def log_report(spark: SparkSession, path: str) -> DataFrame:
    """The last session's figures of one progress log."""
    return progress.session_stats(progress.parse_log(readers.read_log(spark, path)))
