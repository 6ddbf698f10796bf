"""Training and evaluation sets: prompts, answers, images, tests by page; JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import parse_pages
from ..functions.text import build_prompt, page_key, strip_pdf
from ..functions.yamlio import format_yaml, valid_page
from ..schemas import PAGE_TEST

KEY = ("pdf_name", "page")


def messages(prompt: Column, image: Column, answer: Column) -> Column:
    """The two turns of an example: what the user shows and asks, what the assistant answers."""
    part = lambda kind, text, img: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), img.cast("string").alias("image"))
    none = F.lit(None)
    user = F.struct(F.lit("user").alias("role"), F.array(part("text", prompt, none), part("image", none, image)).alias("content"), none.cast("string").alias("content_text"))
    turn = F.struct(F.lit("assistant").alias("role"), F.array().cast("array<struct<type:string,text:string,image:string>>").alias("content"), answer.alias("content_text"))
    return F.array(user, turn)


def metadata(**fields: Column) -> Column:
    kinds = {"source": "string", "page": "int", "html_source": "string", "yaml_source": "string", "generated_by": "string", "primary_language": "string", "is_table": "boolean", "is_diagram": "boolean"}
    return F.struct(*[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def from_html(pages: DataFrame, images: DataFrame, anchors: DataFrame, template: str) -> DataFrame:
    """Examples of HTML pages (stem, path, html): inner join with images (stem, image), left join with anchor texts
    (pdf_name, page, anchor); pages whose stem names no page are left out."""
    keyed = pages.withColumn("_k", page_key(F.col("stem"))).where("_k is not null").select("stem", "path", "html", "_k.pdf_name", "_k.page")
    keyed = parse_pages(keyed.join(images.select("stem", "image"), "stem"))
    p = F.col("page_parts")
    answer = format_yaml(p["main_html"], p["lang"], p["is_table"], p["is_diagram"])
    out = keyed.join(anchors.select(*KEY, "anchor"), list(KEY), "left")
    meta = metadata(source=F.concat("pdf_name", F.lit(".pdf")), page=F.col("page"), html_source=F.col("path"), primary_language=p["lang"], is_table=p["is_table"], is_diagram=p["is_diagram"])
    return out.select(*KEY, messages(build_prompt(F.col("anchor"), template), F.col("image"), answer).alias("messages"), meta.alias("metadata"))


def from_yaml(pages: DataFrame, images: DataFrame, anchors: DataFrame, template: str) -> DataFrame:
    """Examples of YAML pages (stem, path, yaml) that have a text field; joins as in from_html."""
    keyed = pages.where(valid_page(F.col("yaml"))).withColumn("_k", page_key(F.col("stem"))).where("_k is not null").select("stem", "path", "yaml", "_k.pdf_name", "_k.page")
    out = keyed.join(images.select("stem", "image"), "stem").join(anchors.select(*KEY, "anchor"), list(KEY), "left")
    meta = metadata(source=F.concat("pdf_name", F.lit(".pdf")), page=F.col("page"), yaml_source=F.col("path"), generated_by=F.lit("generate_yaml"))
    return out.select(*KEY, messages(build_prompt(F.col("anchor"), template), F.col("image"), F.col("yaml")).alias("messages"), meta.alias("metadata"))


def build_sft(html: DataFrame | None, yaml: DataFrame | None) -> DataFrame:
    """The examples of both kinds together."""
    parts = [x for x in (html, yaml) if x is not None]
    if not parts:
        raise ValueError("no examples")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def sft_lines(examples: DataFrame) -> DataFrame:
    """(value): a JSON line for each example; the user's content is a list of parts, the assistant's a string."""
    skip = {"ignoreNullFields": "true"}
    turns = F.transform("messages", lambda m: F.concat(F.lit('{"role":'), F.to_json(F.struct(m["role"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(m["role"].alias("x")))) - 6), F.lit(',"content":'), F.when(F.size(m["content"]) > 0, F.to_json(m["content"], skip)).otherwise(F.to_json(F.struct(m["content_text"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(m["content_text"].alias("x")))) - 6)), F.lit("}")))
    return examples.select(F.concat(F.lit('{"messages":['), F.array_join(turns, ","), F.lit('],"metadata":'), F.to_json("metadata", skip), F.lit("}")).alias("value"))


def load_sft(lines: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples, bad lines) of JSON lines (value). Blank lines don't count, broken ones are bad, lines without messages
    raise. An example needs an image (that `images`, (image), has) and an answer; text comes before image."""
    rows = lines.where(F.trim("value") != "").withColumn("_v", F.expr("try_parse_json(value)"))
    bad = rows.where("_v is null").select("value")
    rows = rows.where("_v is not null").withColumn("_m", F.from_json(F.get_json_object("value", "$.messages"), "array<struct<role:string,content:string>>"))
    rows = rows.withColumn("_m", F.when(F.col("_m").isNull(), F.raise_error(F.lit("an example has no messages"))).otherwise(F.col("_m")))
    parts = F.from_json(F.get("_m", F.lit(0))["content"], "array<struct<type:string,text:string,image:string>>")
    rows = rows.withColumn("_p", parts).select(
        F.coalesce(F.element_at(F.filter("_p", lambda x: x["type"] == "text"), -1)["text"], F.lit("")).alias("prompt"),
        F.element_at(F.filter("_p", lambda x: x["type"] == "image"), -1)["image"].alias("image"),
        F.get("_m", F.lit(1))["content"].alias("answer"),
    )
    rows = rows.where("image is not null and coalesce(answer, '') <> ''")
    if images is not None:
        rows = rows.join(images.select("image").distinct(), "image", "left_semi")
    return rows.select(messages(F.col("prompt"), F.col("image"), F.col("answer")).alias("messages"), F.array("image").alias("images")), bad


def tests_by_page(tests: DataFrame, min_tests: int = 1) -> DataFrame:
    """(pdf_name, page, n_tests, tests): the tests of each page by id, pages of fewer than min_tests left out."""
    rows = tests.withColumn("pdf_name", strip_pdf(F.col("pdf"))).withColumn("page", F.coalesce("page", F.lit(0)))
    body = F.struct("id", *[F.col(f.name) for f in PAGE_TEST if f.name not in ("id",)])
    return rows.groupBy(*KEY).agg(F.count("*").alias("n_tests"), F.sort_array(F.collect_list(body)).alias("tests")).where(F.col("n_tests") >= min_tests)


def build_rlvr(images: DataFrame, tests: DataFrame, anchors: DataFrame, template: str, min_tests: int = 2) -> DataFrame:
    """(image, prompt, tests as JSON, pdf_name, page_num) for every image (stem, image) with at least min_tests tests."""
    keyed = images.withColumn("_k", page_key(F.col("stem"))).where("_k is not null").select("image", "_k.pdf_name", "_k.page")
    out = keyed.join(tests_by_page(tests, min_tests), list(KEY)).join(anchors.select(*KEY, "anchor"), list(KEY), "left")
    return out.select("image", build_prompt(F.col("anchor"), template).alias("prompt"), F.to_json("tests", {"ignoreNullFields": "true"}).alias("tests"), "pdf_name", F.col("page").alias("page_num"))


def with_sidecar(pages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Pages with the width and height that their sidecar (stem, width, height) gives, else 800 by 1000."""
    out = pages.join(sidecars.select("stem", F.col("width").alias("_w"), F.col("height").alias("_h")), "stem", "left")
    return out.withColumn("width", F.coalesce("_w", F.lit(800))).withColumn("height", F.coalesce("_h", F.lit(1000))).drop("_w", "_h")


def complete_pairs(html: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The HTML pages that have a sidecar, by exact stem."""
    return html.join(sidecars.select("stem").distinct(), "stem", "left_semi")


def sources_of(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with source_path: the sidecar's own, else the first path of the manifest (pdf_name, path) by name."""
    first = manifest.groupBy("pdf_name").agg(F.min("path").alias("_path"))
    return pages.join(first, "pdf_name", "left").withColumn("source_path", F.coalesce("source", "_path")).drop("_path")
