"""Tables with awkward rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy(rng: random.Random, text: str, edits: int) -> str:
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99))
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus(spark):
    """Families of near and exact copies, boilerplate, empty, null, blank and very long texts, repeated rows, null ids."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts: list[str | None] = []
    common_line = "this very common line opens a great many of the documents here"
    for f in range(25):
        base = " ".join(word() for _ in range(rng.choice([5, 12, 30, 80, 300])))
        texts += [base] + [near_copy(rng, base, rng.randint(1, 6)) for _ in range(rng.randint(0, 6))]
        texts += [base.upper()] * (f % 3)
        texts.append(common_line + "\n" + " ".join(word() for _ in range(9)))
    texts += [common_line] * 5 + [None, "", " \t\n", "one", "one two", "one two three"] + [" ".join(word() for _ in range(30_000))]
    rows = [(i, t, [None, "en", "de"][i % 3], ["hot", "hot", "b", None][i % 4], 0 if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "a null id has a text of its own here", "en", "b", 1), (None, texts[0], "en", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(corpus):
    """Extra columns named like those that operators make, and one with a map."""
    out = corpus
    for c in ("SHARD", "slot", "mix_size", "key", "row", "score", "_key", "toxicity", "rank", "b", "s"):
        out = out.withColumn(c, F.lit("x"))
    return out.withColumn("extra", F.create_map(F.lit("k"), F.lit(1)))
