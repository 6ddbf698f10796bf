"""Incremental twins of the batch operators: what a checkpoint has seen isn't done again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from ..functions.html import parse_pages
from ..operators.pages import linearize
from ..operators.progress import parse_log
from ..operators.testgen import page_tests
from ..sources.sinks import written_once


def stream_parquet(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100, pattern: str = "*") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", pattern).parquet(path)


def counted(counts: DataFrame, label: str, checkpoint: str) -> DataFrame:
    """What a stream's running aggregate says once all that is there is read: each micro-batch replaces the table of the
    whole result below the checkpoint, so that nothing is gathered on the driver."""
    spark, at = counts.sparkSession, f"{checkpoint}/{label}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(at)

    counts.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(at)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which state of several values a key needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_batches(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands `write` each micro-batch of what is there, kept while it is written to several places."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            write(batch, epoch)
        finally:
            batch.unpersist()

    rows.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class PagesOfDocument(StatefulProcessor):
    """A document's pages until all have come, or none has come for `wait` milliseconds. Of a page that comes again
    one from its first micro-batch holds; pages of a document that is whole are left out for `remember` milliseconds. Time is that of the
    micro-batches, so a document's time is over when a later batch comes."""

    def __init__(self, wait: int, remember: int):
        self.wait, self.remember = wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "text string")
        self.have = handle.getValueState("have", "n int")
        self.done = handle.getValueState("done", "n int")

    def _timer(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _given(self, key: tuple, whole: bool) -> pd.DataFrame:
        rows = [(key[0], None if page == NO_PAGE else page, text, whole) for (page,), (text,) in self.pages.iterator()]
        self.pages.clear()
        self.have.clear()
        return pd.DataFrame(rows, columns=["doc", "page", "natural_text", "whole"]).astype({"page": "Int32"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            return
        n, most, now = self.have.get()[0] if self.have.exists() else 0, 0, 0
        for part in rows:
            for page, text, pages, at in zip(part["page"], part["natural_text"], part["n_pages"], part["at"], strict=True):
                most, now, place = int(pages), int(at), (NO_PAGE if pd.isna(page) else int(page),)
                if not self.pages.containsKey(place):
                    self.pages.updateValue(place, (text,))
                    n += 1
        if n >= most:
            yield self._given(key, True)
            self.done.update((n,))
            self._timer(now + self.remember)
        else:
            self.have.update((n,))
            self._timer(now + self.wait)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.done.exists():
            self.done.clear()
        else:
            yield self._given(key, False)

    def close(self) -> None:
        pass


#: The key of a page without a number.
NO_PAGE = -1
DAY = 86_400_000


def stream_documents(pages: DataFrame, expected: DataFrame, path: str, checkpoint: str, doc: str = "pdf_name", wait: int = 7 * DAY, remember: int = 365 * DAY) -> None:
    """Documents' linear texts as soon as all their pages are there: `path`/documents gets the documents that a
    micro-batch completes, `path`/unfinished the pages of those for which none has come for `wait` milliseconds. expected
    has (pdf_name, n_pages); pages of other documents are left out.

    The pages of unfinished documents are the stream's state, by document, so a micro-batch's work follows its own rows
    and the documents that it completes. A batch that runs again replaces its own output."""
    rows = pages.join(expected.select(doc, "n_pages"), doc).withColumn("_at", F.current_timestamp()).withWatermark("_at", "0 seconds")
    rows = rows.select(F.col(doc).cast("string").alias("doc"), F.col("page").cast("int").alias("page"), "natural_text", "n_pages", F.unix_millis("_at").alias("at"))

    def write(batch: DataFrame, epoch: int) -> None:
        given = batch.withColumnRenamed("doc", doc)
        linearize(given.where("whole").drop("whole"), doc).write.mode("overwrite").parquet(f"{path}/documents/epoch={epoch}")
        given.where("not whole").drop("whole").write.mode("overwrite").parquet(f"{path}/unfinished/epoch={epoch}")

    with keyed_state(pages.sparkSession):
        state = rows.groupBy("doc").transformWithStateInPandas(PagesOfDocument(wait, remember), "doc string, page int, natural_text string, whole boolean", "Append", "EventTime")
        in_batches(state, write, checkpoint)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Writes what is new as parquet, exactly once, and stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def resume_pages(pages: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Does `work` on pages that no earlier run with this checkpoint has seen."""
    run_available(work(pages), path, checkpoint)


def stream_tests(pages: DataFrame, path: str, checkpoint: str, seed: int = 42) -> None:
    """Tests of new pages: each micro-batch is parsed once and gives its tests; a page's tests don't depend on others."""

    def write(batch: DataFrame, epoch: int) -> None:
        page_tests(written_once(parse_pages(batch), "parsed"), seed).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def log_counts(lines: DataFrame) -> DataFrame:
    """Running counts of log lines by kind, for a stream (complete mode) or a batch."""
    return parse_log(lines).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def stream_log_counts(lines: DataFrame, name: str, checkpoint: str) -> None:
    log_counts(lines).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def split_stream(results: DataFrame, good: str, bad: str, checkpoint: str) -> None:
    """Results without and with an error to two places; a batch that runs again replaces its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/epoch={epoch}")
        batch.where("error is not null").write.mode("overwrite").parquet(f"{bad}/epoch={epoch}")

    results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def throughput(events: DataFrame, ts: str = "ts", every: str = "1 hour", kind: str = "event_type") -> DataFrame:
    """Events of a batch by tumbling window and type."""
    out = events.withColumn(ts, F.col(ts).cast("timestamp")).groupBy(F.window(ts, every), kind).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), kind, "n")


class WindowCount(StatefulProcessor):
    """The count of a window's events (a share of them) until the watermark passes its end; events after that are given
    back as they are."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.n = handle, handle.getValueState("n", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if key[2] <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                late = part[self.columns].copy()
                late["_kind"], late["_start"], late["_n"] = key[0], key[1], pd.NA
                yield late.astype({"_n": "Int64"})
            return
        new = sum(len(part) for part in rows)
        if self.n.exists():
            new += self.n.get()[0]
        else:
            self.handle.registerTimer(key[2])
        self.n.update((new,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = pd.DataFrame({c: [None] for c in self.columns} | {"_kind": [key[0]], "_start": [key[1]], "_n": [self.n.get()[0]]})
        self.n.clear()
        yield out

    def close(self) -> None:
        pass


#: Shares of a window's events that are counted apart, so that a window that most events are in isn't one task's; one is
#: enough where windows have few events.
SHARES = 16


def _windows(rows: DataFrame, kind: str) -> DataFrame:
    start = F.timestamp_millis("_start").cast("timestamp_ntz")
    return rows.groupBy(start.alias("window_start"), F.col("_kind").alias(kind)).agg(F.sum("_n").alias("n"))


def stream_throughput(events: DataFrame, path: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes", every: str = "1 hour", kind: str = "event_type", shares: int = SHARES) -> None:
    """Events by tumbling window and type, each window once: when the watermark (the latest event so far, less `late`)
    passes its end, its count goes to `path`/closed and its state is freed; events of windows that are closed go to
    `path`/late. Events without a time are in no window. Windows still open are in open_windows."""
    own = events.columns
    time = F.window("_ts", every)
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).withColumn("_w", time)
    flat = [f.name for f in events.schema if isinstance(f.dataType, AtomicType)]
    rows = rows.select(*own, F.col(kind).alias("_kind"), F.unix_millis("_w.start").alias("_start"), F.unix_millis("_w.end").alias("_end"), F.pmod(F.xxhash64(*flat), F.lit(shares)).cast("int").alias("_share"))
    shape = StructType([*events.schema.fields, StructField("_kind", events.schema[kind].dataType), StructField("_start", LongType()), StructField("_n", LongType())])

    def write(batch: DataFrame, epoch: int) -> None:
        _windows(batch.where("_n is not null"), kind).write.mode("overwrite").parquet(f"{path}/closed/epoch={epoch}")
        batch.where("_n is null").select(*own).write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")

    with keyed_state(events.sparkSession):
        state = rows.groupBy("_kind", "_start", "_end", "_share").transformWithStateInPandas(WindowCount(own), shape, "Append", "EventTime")
        in_batches(state, write, checkpoint)


def open_windows(spark: SparkSession, checkpoint: str, kind: str = "event_type") -> DataFrame:
    """(window_start, kind, n): the windows of stream_throughput that aren't closed yet, from its state."""
    state = spark.read.format("statestore").option("stateVarName", "n").load(checkpoint)
    return _windows(state.select("key._kind", "key._start", F.col("value.n").alias("_n")), kind)
