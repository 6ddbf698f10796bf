"""Disk of the near-duplicate step."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import common, grouping, jaccard


@pytest.mark.parametrize("bits", [5, 8, 13, 17])
def test_blobs_leave_out_what_the_bucket_says(bits):
    """Pairs come back as they went in, in fewer than 16 bytes each."""
    rng = np.random.default_rng(bits)
    keys = rng.integers(-(2**63), 2**63 - 1, 4000) & jaccard.TOLD.view(np.int64)
    keys[1::2] = keys[::2]  # each key twice
    v = np.arange(4000) * 2
    lists = pa.RecordBatch.from_arrays([pa.array(v), pa.array([[k] for k in keys.tolist()], pa.list_(pa.int64()))], ["v", "keys"])
    blobs = pa.Table.from_batches(grouping._pack(bits, 1 << 19, jaccard.LOW)(iter([lists]))).sort_by("bucket").combine_chunks()
    assert sum(map(len, blobs["blob"].to_pylist())) == 4000 * (16 - bits // 8 - jaccard.LOW)
    got = pa.Table.from_batches(grouping._unpack(8, 1, 1 << 21, bits, jaccard.LOW)(iter(blobs.to_batches())))
    assert sorted(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == [(2 * i, 2 * i + 2) for i in range(0, 4000, 2)]


def test_keys_are_not_kept(spark):
    """What is written of the documents takes less room than their texts' numbers of words."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(1500)) for _ in range(60)]
    df = spark.createDataFrame([(i, texts[i % 50] + (" end" if i % 3 else "")) for i in range(120)], "doc_id long, text string")
    at = Path(common.shared_folder(spark).removeprefix("file:"))
    before = set(at.glob("jaccard-*"))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: i % 50 for i in range(120)}
    (own,) = set(at.glob("jaccard-*")) - before
    written = sum(f.stat().st_size for f in (own / "docs").glob("*.parquet"))
    assert written < 120 * 1500
