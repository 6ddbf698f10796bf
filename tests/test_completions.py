"""Completions against the stored tests of their page; boxes of many pages in one partition."""

from __future__ import annotations

import random

from foliospark.operators import layout, rewards
from foliospark.schemas import PAGE_TEST


def test_completions_share_their_pages_tests(spark):
    tests = [
        {"id": "1", "type": "text_presence", "pdf": "d.pdf", "page": 1, "text": "alpha beta", "max_diffs": 1},
        {"id": "2", "type": "text_absence", "pdf": "d.pdf", "page": 1, "text": "gamma", "max_diffs": 0},
        {"id": "3", "type": "order", "pdf": "d.pdf", "page": 1, "before": "alpha", "after": "beta"},
        {"id": "4", "type": "text_presence", "pdf": "d.pdf", "page": 2, "text": "two", "max_diffs": 0},
    ]
    stored = spark.createDataFrame([tuple(t.get(f.name) for f in PAGE_TEST) for t in tests], PAGE_TEST)
    said = [("d", 1, 0, "Alpha, beta"), ("d", 1, 1, "beta alpha gamma"), ("d", 1, 2, None), ("d", 2, 0, "two"), ("d", 2, 1, ""), ("d", 3, 0, "no tests"), ("e", 1, 0, "none")]
    answers = spark.createDataFrame(said, "pdf_name string, page int, gen_id int, text string")
    got = {(r.pdf_name, r.page, r.gen_id): round(r.reward, 4) for r in rewards.completion_rewards(answers, stored).collect()}
    assert got == {("d", 1, 0): 1.0, ("d", 1, 1): 0.0, ("d", 1, 2): round(1 / 3, 4), ("d", 2, 0): 1.0, ("d", 2, 1): 0.0, ("d", 3, 0): 0.0, ("e", 1, 0): 0.0}
    binary = {(r.pdf_name, r.page, r.gen_id): r.reward for r in rewards.completion_rewards(answers, stored, "binary").collect()}
    assert binary["d", 3, 0] == 1.0 and binary["d", 1, 1] == 0.0


def test_boxes_of_many_pages(spark):
    """Every page's groups against all pairs of its boxes, with boxes that lack a coordinate."""
    rng = random.Random(6)
    rows = [(f"d{i % 7}", i % 3, i, f"n{i}", *(lambda x, y: (x, y, x + rng.choice([1.0, 4.0]), y + rng.choice([1.0, 9.0])))(rng.uniform(0, 40), rng.uniform(0, 40))) for i in range(400)]
    rows += [("d0", 0, 900, None, None, 1.0, 2.0, 3.0), ("d0", 0, 901, "x", 0.0, None, 2.0, 3.0), (None, 0, 1, "a", 0.0, 0.0, 1.0, 1.0), (None, 0, 2, "b", 1.2, 1.2, 2.0, 2.0)]
    want = set()
    for page in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == page), key=lambda r: r[2])
        group = list(range(len(own)))
        for a in range(len(own)):
            for b in range(a):
                p, q = own[a][4:], own[b][4:]
                if None not in p + q and max(p[0], q[0]) - min(p[2], q[2]) <= 0.5 and max(p[1], q[1]) - min(p[3], q[3]) <= 0.5:
                    old, new = group[a], group[b]
                    group = [new if g == old else g for g in group]
        for g in set(group):
            some = [own[i] for i in range(len(own)) if group[i] == g]
            known = lambda f, k: f((r[k] for r in some if r[k] is not None), default=None)  # noqa: B023, E731
            want.add((*page, min(r[2] for r in some), "+".join(r[3] or "" for r in some), known(min, 4), known(min, 5), known(max, 6), known(max, 7)))
    frame = spark.createDataFrame(rows, "pdf_name string, page int, idx int, name string, x0 double, y0 double, x1 double, y1 double")
    got = layout.merge_boxes(frame.repartition(3)).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)
