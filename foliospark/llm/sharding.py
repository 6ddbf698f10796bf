"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix. DataFrame operations only."""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, deal, free_name, row_key, small_table, told_apart

#: Rows that a cell (part of a shard) or a block (part of the input) has at most while the matrix stays within MAX_CELLS.
ROWS_PER_CELL = 4096
MAX_CELLS = 4_000_000
FINE = 1 << 16
#: A row finds its cell among the ends of groups of STEP cells, then within one group.
STEP = 32


def _power(n: int) -> int:
    return 1 << max(0, (n - 1).bit_length())


def communication_matrix(blocks: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each cell in a uniform random permutation: row sums are `blocks`, column sums `cells`."""
    rng, left, out = random.Random(seed), list(cells), []
    for n in blocks:
        row = deal(rng, left, n)
        left = [a - b for a, b in zip(left, row, strict=True)]
        out.append(row)
    return out


def shard_rows(df: DataFrame, shards: int = 24, seed: int = 17, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows of df with a shard (0 to shards-1) and a gapless slot in it from 0; shard sizes differ by one at most.

    Law `rows`: the assignment is a uniform random permutation cut into shards, so rows with equal texts are
    dealt out like any others. Blocks of the input are ranges of a hash of the whole row, so that a rerun, or a
    task repeated after the loss of an executor, sees the same blocks. The driver sees block counts only (65,536
    at most) and draws the block by cell matrix (MAX_CELLS numbers at most). A block is permuted and cut for the cells by
    its keys alone, so that rows are exchanged once, to their cells, and permuted again there.
    Nulls in any column are hashed as values; equal rows are interchangeable; an empty table gives an empty one;
    columns of df named like the two new ones are replaced, as withColumn does."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    df = df.drop(*[c for c in df.columns if c.lower() in (shard_col.lower(), slot_col.lower())])
    key, block, rank, cell, cuts = (free_name(df, f"_{x}") for x in ("key", "block", "rank", "cell", "cuts"))
    coarse = free_name(df, "_coarse")
    keyed = df.withColumn(key, row_key(df, seed))
    ws = Scratch(spark, "shards")
    keys = ws.save(keyed.select(key), "keys")
    apart = told_apart(keyed, key, keys)
    if apart is not keyed:
        keyed, keys = apart, ws.save(apart.select(key), "apart")
    fine = F.pmod(F.col(key), F.lit(FINE))
    counts = {r[0]: r[1] for r in keys.groupBy(fine.alias("b")).count().collect()}
    total = sum(counts.values())
    parts = max(1, min(-(-total // shards // ROWS_PER_CELL), MAX_CELLS // shards // 64))
    n_blocks = min(FINE, _power(max(8, -(-total // ROWS_PER_CELL))), max(8, _power(MAX_CELLS // (shards * parts) + 1) // 2))
    width = FINE // n_blocks
    blocks = [0] * n_blocks
    for b, n in counts.items():
        blocks[b // width] += n
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    cells = [n // parts + (p < n % parts) for n in sizes for p in range(parts)]
    starts = [sum(cells[s * parts : s * parts + p]) for s in range(shards) for p in range(parts)]
    ends = [list(accumulate(row)) for row in communication_matrix(blocks, cells, seed)]
    # A block is permuted by a second hash; only keys are ranked, and the hash at the last rank of each cell bounds the cell.
    of_block, permuted = F.floor(fine / width).cast("long"), F.xxhash64(F.lit(seed + 1), key)
    ranked = keys.select(of_block.alias("b"), permuted.alias("h"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h")).cast("long"))
    asked = small_table(spark, [(b, sorted({x for x in row if x})) for b, row in enumerate(ends)], "b long, r array<long>")
    asked = asked.select("b", F.explode("r").alias("r"))  # MAX_CELLS rows at most
    held = {(r["b"], r["r"]): r["h"] for r in ranked.join(F.broadcast(asked), ["b", "r"]).collect()}
    least = -(1 << 63)
    matrix = [(b, x[STEP - 1 :: STEP], x) for b, row in enumerate(ends) for x in [[held[b, r] if r else least for r in row]]]
    table = small_table(spark, matrix, f"`{block}` long, `{coarse}` array<long>, `{cuts}` array<long>")
    offsets = F.array(*[F.lit(x).cast("long") for x in starts]) if len(starts) <= 64 else None
    dealt = keyed.withColumn(block, of_block).withColumn(key, permuted)
    dealt = dealt.join(F.broadcast(table), block)  # MAX_CELLS numbers at most
    group = F.size(F.filter(coarse, lambda c: c < F.col(key)))
    rest = F.filter(F.slice(cuts, group * STEP + 1, STEP), lambda c: c < F.col(key))
    dealt = dealt.withColumn(cell, (group * STEP + F.size(rest)).cast("long")).drop(block, coarse, cuts)
    ws.drop("keys", "apart")
    within = F.row_number().over(Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed + 2), key), key)) - 1
    dealt = dealt.withColumn(rank, within.cast("long"))
    if offsets is not None:
        dealt = dealt.withColumn(slot_col, F.get(offsets, F.col(cell).cast("int")) + F.col(rank))
    else:
        places = small_table(spark, list(enumerate(starts)), f"`{cell}` long, `{cuts}` long")
        dealt = dealt.join(F.broadcast(places), cell).withColumn(slot_col, F.col(cuts) + F.col(rank))
    return dealt.withColumn(shard_col, F.floor(F.col(cell) / parts).cast("int")).select(*[f"`{c}`" for c in df.columns], shard_col, slot_col)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of shard_rows over all documents: 24 shards, law `rows`."""
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
