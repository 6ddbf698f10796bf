"""Memory of an executor while the pipeline runs."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import common, grouping, lines
from pyspark.sql import functions as F


@pytest.mark.parametrize("stage, step", [("toxicity", "remove_toxic"), ("decontamination", "clean_documents")])
def test_rows_go_through_python_in_small_batches(spark, sf, monkeypatch, stage, step):
    """A stage's result is written by its caller; its rows still reach Python a few MB at a time."""

    def sizes(df, *_):
        return df.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")

    monkeypatch.setattr(corpus_pipeline, step, sizes)
    docs = spark.range(0, 40, 1, 1).select("id", F.repeat(F.lit("word "), 100_000).alias("text"))
    before = spark.conf.get(common.BATCHES)
    try:
        spark.conf.set(common.BATCHES, "64m")
        got = [r["n"] for r in dict(corpus_pipeline.STAGES)[stage](spark, docs, sf).collect()]
    finally:
        spark.conf.set(common.BATCHES, before)
    assert sum(got) >= 20_000_000 and max(got) <= 6_000_000


def test_a_worker_gives_back_what_a_task_has_freed():
    """Blocks below one that is still in use go back to the system too."""
    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    pins = []

    def run(batches):
        blocks = [np.ones(8_000) for _ in range(3_000)]  # 192 MB in blocks that malloc keeps
        pins.append(np.ones(8_000))
        yield pa.RecordBatch.from_pydict({"mb": [held()]})
        del blocks
        yield from batches

    before = held()
    for task in (run, common.freed(run)):
        most = [b["mb"][0].as_py() for b in task(iter([]))][0]
        after = held()
        assert most - before > 150
    assert after - before < 60


def test_band_keys_work_as_one_block():
    """The bins that short lines leave empty are filled at once, not a step of all bins for each empty one."""
    low = np.full((200, lines.BINS), lines._EMPTY)
    for i in range(200):
        low[i, (7 * i + np.arange(i % 5 + 1) ** 2) % lines.BINS] = np.arange(i % 5 + 1) + 1000 * i
    want = low.copy()
    for _ in range(lines.BINS):
        right = np.roll(want, -1, 1)
        want = np.where((want == lines._EMPTY) & (right != lines._EMPTY), right + lines._FAR, want)
    lines.filled(low)
    assert (low == want).all()


def test_large_groups_take_no_call_each(monkeypatch):
    """20,000 groups of over `small` members between the first and the last are linked to their leaders at once."""
    calls = []
    unique = np.unique
    monkeypatch.setattr(grouping.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    key = np.repeat(np.arange(20_000) << 20, 6)
    v = np.tile(np.array([2, 4, 6, 8, 8, 10]), 20_000)  # five vertices each, one twice
    got = grouping.groups(4, 1)(key, v)
    pair = got.column("key").is_null().to_numpy(zero_copy_only=False)
    assert pair.sum() == 80_000 and (~pair).sum() == 100_000
    assert len(calls) < 10
