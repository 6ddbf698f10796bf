"""Images of training sets: resized where they are too large, and kept as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.pixels import fitted_png
from ..schemas import schema
from .readers import read_files

IMAGES = schema("stem string, width int, height int, png binary, error string")


def fit_images(files: DataFrame, most: int = 1288) -> DataFrame:
    """IMAGES of PNG files (stem, content) with the longer edge at most `most`; a file that can't be read is a row with an
    error. A worker holds one image at a time."""
    kinds = to_arrow_schema(IMAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = {"stem": stem, "error": None}
                try:
                    row |= dict(zip(("width", "height", "png"), fitted_png(content.as_py() or b"", most), strict=True))
                except Exception as e:  # noqa: BLE001  an image that fails doesn't stop the others
                    row["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([row], kinds)

    return files.select("stem", "content").mapInArrow(run, IMAGES)


def save_images(spark: SparkSession, path: str, out: str, most: int = 1288) -> DataFrame:
    """Resizes the PNG files below a folder into the table `out`; returns its manifest (stem, width, height, error)."""
    fit_images(read_files(spark, path, "*.png"), most).write.mode("errorifexists").parquet(out)
    return spark.read.schema(IMAGES).parquet(out).drop("png")
