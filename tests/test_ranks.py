"""Ranks, totals and frames of groups that lie in many partitions, against plain Python."""

from __future__ import annotations

import random

import pytest
from foliospark.functions.text import stable_order
from foliospark.operators import ranks, rewards, sampling
from foliospark.sources import readers
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(spark):
    """A group with a third of all rows, ties in the order, null groups, orders and amounts."""
    rng = random.Random(2)
    got = [(i, rng.choice(["hot", "hot", "b", "c", None, "d"]), rng.choice([None, *range(40)]) if i % 3 else i, rng.choice([None, 0, 1, 5, 40])) for i in range(4_000)]
    return got, spark.createDataFrame(got, "id long, g string, o long, n long").repartition(7)


def in_order(got, by_group: bool, key):
    groups: dict = {}
    for r in sorted(got, key=key):
        groups.setdefault(r[1] if by_group else 0, []).append(r)
    return groups


by_order = lambda r: (r[2] is not None, r[2] or 0, r[0])


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_and_ranks(spark, rows, by):
    got, df = rows
    groups = in_order(got, bool(by), by_order)
    place = {r[0]: k for rs in groups.values() for k, r in enumerate(rs)}
    assert {r.id: r._r for r in ranks.numbered(df, ["o", "id"], *by).collect()} == place
    want = {}
    for rs in groups.values():
        total = 0
        for r in rs:
            want[r[0]] = total
            total += r[3] or 0
    for chunk in (3, 64, ranks.CHUNK):
        assert {r.id: r._before for r in ranks.running(df, "n", ["o", "id"], *by, chunk=chunk).collect()} == want
    kept = {r.id for r in sampling.max_pages(df, "n", 900, "o", "id", by=by).collect()}
    assert kept == {i for i, b in want.items() if b < 900}
    down = {r.id: r._r for r in ranks.numbered(df, [F.desc("id")], *by).collect()}
    assert all(down[r[0]] == k for rs in in_order(got, bool(by), lambda r: -r[0]).values() for k, r in enumerate(rs))


@pytest.mark.parametrize(("n", "chunk"), [(1, 5), (4, 5), (10, 3), (7, 1_000)])
def test_moving_frames(spark, rows, n, chunk):
    got, df = rows
    want = {}
    for rs in in_order(got, True, lambda r: r[0]).values():
        for k, r in enumerate(rs):
            some = [x[3] for x in rs[max(0, k - n + 1) : k + 1] if x[3] is not None]
            want[r[0]] = sum(some) / len(some) if some else None
    out = rewards.moving_average(df, "n", "id", n, "g", chunk=chunk)
    assert {r.id: r.moving_avg for r in out.collect()} == pytest.approx(want) and out.columns == [*df.columns, "moving_avg"]


def test_frames_use_many_tasks(spark):
    """One group: as many tasks have rows as the group has chunks."""
    df = spark.range(20_000).select(F.col("id"), F.col("id").alias("n"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # small partitions stay apart
    try:
        out = ranks.moving(df, "m", F.sum("n"), 5, ["id"], chunk=500)
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset(key)


def test_empty(spark, rows):
    none = rows[1].limit(0)
    assert ranks.running(none, "n", ["id"]).count() == 0 and rewards.moving_average(none, "n", "id", 3, "g").count() == 0
    assert sampling.balanced(none, {"a": 3}, "g", "id").count() == 0


@pytest.mark.parametrize("caps", [{"hot": 700, "b": None, "c": 0, "d": 1}, {"hot": 10**6}, {"b": None}, {"x": 5}])
def test_balanced_is_the_first_by_md5(spark, rows, caps, monkeypatch):
    _, df = rows
    order = {r.id: r.m for r in df.select("id", stable_order("id", seed=7).alias("m")).collect()}
    want = set()
    for s, cap in caps.items():
        own = sorted((order[r[0]], r[0]) for r in rows[0] if r[1] == s)
        want |= {i for _, i in own[:cap]}
    for digits in (1, 3):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        assert {r.id for r in sampling.balanced(df, caps, "g", "id", seed=7).collect()} == want


def test_lines_of_a_log_in_splits(spark, tmp_path):
    """Logs that are cut inside lines are numbered as the files have them, \\r and empty lines included."""
    rng = random.Random(4)
    said = {}
    for name in ("a.log", "b.log"):
        lines = ["x" * rng.choice([0, 1, 30, 900]) + rng.choice(["", "\r", f" é{k}"]) for k in range(900)]
        (tmp_path / name).write_text("\n".join(lines), newline="")
        said[name] = lines
    want = [(k, x) for k, x in enumerate(said["a.log"] + said["b.log"]) if x]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", "100000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted(tuple(r) for r in readers.read_log(spark, str(tmp_path)).collect()) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
