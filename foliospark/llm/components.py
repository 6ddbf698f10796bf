"""Distributed union-find: connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, freed

#: Links that a task joins at once; a chunk's forest has a link for each vertex at most.
CHUNK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the links (a, b): each vertex but a component's least, and that least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:  # least label over links, then jump to the label's label
        low = np.minimum(root[u], root[v])
        new = root.copy()
        for x in (u, v, root[u], root[v]):
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


@freed
def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= CHUNK:
            yield out()
            held = []
    if held:
        yield out()


def components(links: DataFrame, ws: Scratch, name: str) -> DataFrame:
    """(v long, root long) for every vertex of links (a long, b long): root is the least vertex of v's component.

    Each round, tasks join their own links first; then every vertex moves to its least neighbour and links between
    the moved vertices remain. Vertices are hashes, so the number of them falls by a constant factor each round.
    Nothing is gathered on the driver; each round's tables are written to the shared folder."""
    steps: list[DataFrame] = []
    links = ws.save(links.select("a", "b").where("a <> b").mapInArrow(_local, "a long, b long"), f"{name}-links-0")
    while not links.isEmpty():
        k = len(steps)
        both = links.select(F.col("a").alias("v"), F.col("b").alias("p")).unionAll(links.select("b", "a"))
        to = ws.save(both.groupBy("v").agg(F.least(F.min("p"), F.first("v")).alias("p")), f"{name}-step-{k}")
        steps.append(to)
        moved = links.join(to.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        moved = moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
        new = ws.save(moved.mapInArrow(_local, "a long, b long"), f"{name}-links-{k + 1}")
        ws.drop(f"{name}-links-{k}")
        links = new
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    root = steps[-1].select("v", F.col("p").alias("root"))
    for to in reversed(steps[:-1]):
        root = to.join(root.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root"))
    root = ws.save(root, f"{name}-roots")
    ws.drop(*(f"{name}-step-{k}" for k in range(len(steps))))
    return root
