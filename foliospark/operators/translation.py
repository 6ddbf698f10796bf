"""Translation records: a page's tables cut out and structured, the rest split into numbered sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import numbered
from ..functions.tables import markdown_tables, without_tables
from ..functions.text import strip
from ..functions.yamlio import parse_yaml_page


def translation_records(pages: DataFrame, doc: str = "document_id", yaml_col: str = "yaml") -> DataFrame:
    """schemas.TRANSLATION and error for YAML pages; what isn't a record has an error and no sentences."""
    p = pages.select(F.col(doc).alias("document_id"), parse_yaml_page(yaml_col).alias("p")).select("document_id", "p.*")
    text = strip(F.coalesce("natural_text", F.lit("")))
    return p.select("document_id", F.coalesce("primary_language", F.lit("en")).alias("primary_language"), "is_rotation_valid", "rotation_correction", "is_table", "is_diagram", numbered(without_tables(text)).alias("sentences"), markdown_tables(text).alias("tables"), "error")


def yaml_documents(records: DataFrame) -> DataFrame:
    """(document_id, value): each record as a YAML document that a file of many can hold."""
    names = [c for c in records.columns if c != "error"]
    at = names.index("document_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            out = ["---\n" + yaml.safe_dump(r, allow_unicode=True, sort_keys=False) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(at), pa.array(out, pa.string())], ["document_id", "value"])

    return records.select(*names).mapInArrow(run, "document_id string, value string")
