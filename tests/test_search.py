"""Needles in any number: the join against the automaton, which test_brute.py holds against plain distances."""

from __future__ import annotations

import random

import pytest
from foliospark.operators import search
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def both(texts, needles, k, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(search, "PASS_NEEDLES", 10**9)
        m.setattr(search, "PASS_CHARS", 10**12)
        one = rows(search.find_needles(texts, needles, max_diffs=k))
        m.setattr(search, "PASS_NEEDLES", 0)
        return one, rows(search.find_needles(texts, needles, max_diffs=k))


def test_marks_of_a_part_are_marks_of_the_whole():
    """Many texts at once give what each gives alone, and a part's marks are marks of the whole."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é\U0001f600") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    cuts = [sorted(rng.randint(0, len(t)) for _ in range(2)) for t in texts]
    parts = [t[a:b] for t, (a, b) in zip(texts, cuts, strict=True)]

    def sets(grams: search.Grams, owner, keys):
        out: list[set] = [set() for _ in grams.sizes]
        for o, k in zip(owner.tolist(), keys.tolist(), strict=True):
            out[o].add(k)
        return out

    whole, part = search.Grams(texts), search.Grams(parts)
    for a, b in zip(sets(part, *part.marks()), sets(whole, *whole.marks()), strict=True):
        assert a <= b
    for p, own, runs in zip(parts, sets(part, *part.marks()), sets(part, *part.runs(5)), strict=True):
        alone = search.Grams([p])
        assert set(alone.marks()[1].tolist()) == own and set(alone.runs(5)[1].tolist()) == runs
        assert (len(own) > 0) == (len(p) >= search.GRAM + search.WINDOW - 1) and len(runs) == len({p[i : i + 5] for i in range(len(p) - 4)})


@pytest.mark.parametrize("k", [0, 4])
def test_whole_tables(spark, monkeypatch, k):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.col("lang").alias("_h"))
    one, other = both(texts, spark.read.parquet(f"{SF}/benchmark.parquet"), k, monkeypatch)
    assert one == other and len(one) > 20


@pytest.mark.parametrize("k", [0, 3])
def test_awkward_needles(spark, monkeypatch, k):
    """Short needles, empty and null ones, repeated texts and needles, boilerplate, edits at the ends."""
    rng = random.Random(k)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += ["a common line of boilerplate " + texts[3]] * 4 + ["", None, "x"]
    needles = [None, "", "a", "ab", texts[5], "a common line of boilerplate", "a comon line of boilerplat"]
    for t in texts[:40]:
        a = rng.randint(0, len(t))
        part = list(t[a : a + rng.randint(1, 50)])
        for _ in range(rng.randint(0, k)):
            if part:
                part[rng.randrange(len(part))] = rng.choice(["", "z", "zz"])
        needles.append("".join(part))
    tdf = spark.createDataFrame(list(enumerate(texts)), "t_id long, text string")
    ndf = spark.createDataFrame([(f"n{i % 40}", n) for i, n in enumerate(needles + needles[4:9])], "item_id string, text string")
    one, other = both(tdf, ndf, k, monkeypatch)
    assert sorted(set(one), key=repr) == sorted(set(other), key=repr) and len(one) == len(other)
    none = spark.createDataFrame([], "item_id string, text string")
    assert rows(search.find_many(tdf, none, max_diffs=k)) == [] and rows(search.find_many(tdf.limit(0), ndf, max_diffs=k)) == []


def test_many_needles_are_not_collected(spark):
    """More needles than an automaton takes: each text's own sentence is found, and nothing else of 60,000."""
    texts = spark.range(300).select(F.col("id").alias("t_id"), F.concat_ws(" ", F.lit("before it"), F.md5(F.col("id").cast("string").cast("binary")), F.md5((F.col("id") + 5).cast("string").cast("binary")), F.lit("after")).alias("text"))
    needles = spark.range(60_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string").cast("binary")), F.md5((F.col("id") + 5).cast("string").cast("binary"))).alias("text"))
    assert sorted(map(tuple, search.find_needles(texts, needles).collect())) == [(i, i) for i in range(300)]
