"""Mixing sources to target weights: exact quotas split over output shards by a multivariate hypergeometric tree.

DataFrame operations only. The driver sees one row per source (MAX_SOURCES at most) and the numbers of the tree."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, deal, free_name, row_key, small_table, told_apart

#: Sources that a mix may have; the driver holds one row and one row of quotas for each.
MAX_SOURCES = 10_000
#: Documents of a source are ordered in blocks of about this many.
ROWS_PER_BLOCK = 2_000
#: Bits of the hash that make a bucket: so many that a bucket has few rows, within these.
LEAST_BITS, MOST_BITS = 12, 20
#: Partitions that one output shard of the mix is dealt to.
SPREAD = 64
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Each source's share of all sizes by weight; what is above `most` times a source's size is reshared by weight."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        left = total - sum(out[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weights[i] / w for i in open_}
        over = {i for i in open_ if share[i] > most * sizes[i]}
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else share[i]
        open_ = open_ - over if over else set()
    return out


def splitting_tree(rng: random.Random, counts: list[int], sizes: list[int]) -> list[list[int]]:
    """For each output shard, how many blocks of each source it gets: the shards are halved again and again, and
    each half's counts are drawn from its parent's. Shard k gets exactly sizes[k], source i gives exactly counts[i]."""
    if len(sizes) == 1:
        return [counts]
    mid = len(sizes) // 2
    left = deal(rng, counts, sum(sizes[:mid]))
    return splitting_tree(rng, left, sizes[:mid]) + splitting_tree(rng, [a - b for a, b in zip(counts, left, strict=True)], sizes[mid:])


def mix_sources(df: DataFrame, source_col: str = "source", size: Column | None = None, shards: int = 16, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """All rows of df with mix_size, mix_source_size, mix_target, mix_copies (an array of the output shards that get a
    copy of the row) and mix_order (for each copy, the number that orders it in its shard).

    size: the size that a row counts with (default: words of `text`). Sources are ordered by code point, null last,
    and weigh `weights`, repeating. A source's rows have one permuted order (by a hash of the whole row). The mix
    takes whole passes over it as often as the target holds the source, then the first rows of one more pass, as
    many as fit, and last the one row whose size comes nearest to what is left; nothing is cut, and no row is taken
    more than `most` times. The places of a source's sequence of copies are dealt to the shards in disjoint runs,
    whose lengths a hypergeometric splitting tree draws; shards end with equal counts of copies (one apart at most).
    Rows are dealt by thresholds on their hash, so the texts are not shuffled. Null sources form one source; rows of
    size 0 add nothing and are taken with their pass; copies of a repeated row are numbered and taken one by one; an
    empty table gives an empty one. Existing columns named mix_* are replaced."""
    spark, ws = df.sparkSession, Scratch(df.sparkSession, "mix")
    size = word_count(F.col("text")) if size is None else size
    news = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_order")
    df = df.drop(*[c for c in df.columns if c.lower() in news])
    key = free_name(df, "_key")
    keyed = df.withColumn("mix_size", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long")).withColumn(key, row_key(df, seed))
    # The order of a source is that of the hash from its lowest number on; its high bits are the block.
    keyed = told_apart(keyed, key, ws.save(keyed.select(key), "keys"))
    rows = ws.save(keyed.select(F.col(f"`{source_col}`").alias("s"), F.col(key).alias("h"), F.col("mix_size").alias("n")), "rows")
    bits = min(MOST_BITS, max(LEAST_BITS, (rows.count() // ROWS_PER_BLOCK).bit_length()))
    rows = rows.withColumn("b", F.shiftright(F.col("h"), 64 - bits).cast("int") + (1 << bits - 1))
    fine = rows.groupBy("s", "b").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    of = fine.groupBy("s").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).orderBy(F.col("s").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(of) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    text = lambda x: None if x is None else str(x)
    goal = targets([r["words"] for r in of], [weights[i % len(weights)] for i in range(len(of))], most)
    passes = [min(most, int(t // r["words"])) if r["words"] else 1 for t, r in zip(goal, of, strict=True)]
    rest = [max(0.0, t - p * r["words"]) if p < most else 0.0 for t, p, r in zip(goal, passes, of, strict=True)]
    plan = small_table(spark, [(text(r["s"]), i, float(x)) for i, (r, x) in enumerate(zip(of, rest, strict=True))], "s string, i int, rest double")
    plan = plan.withColumn("s", F.col("s").cast(rows.schema["s"].dataType))
    # Blocks are runs of fine buckets; rank and words before a row add up over blocks, then within one.
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("rows0", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("words0", F.coalesce(F.sum("words").over(before), F.lit(0)))
    fine = fine.withColumn("run", F.floor(F.col("rows0") / ROWS_PER_BLOCK))
    starts = ws.save(fine.select("s", "b", "run", "rows0", "words0"), "starts")
    first = Window.partitionBy("s", "run")
    starts = starts.withColumn("rows0", F.min("rows0").over(first)).withColumn("words0", F.min("words0").over(first))
    same = lambda a, b: a["s"].eqNullSafe(b["s"])
    small = len(of) << bits <= 1_000_000
    starts = F.broadcast(starts) if small else starts
    placed = rows.join(starts, same(rows, starts) & (rows["b"] == starts["b"])).select(rows["s"], rows["h"], rows["n"], "run", "rows0", "words0")
    within = Window.partitionBy("s", "run").orderBy("h", "n")
    placed = placed.withColumn("rank", F.col("rows0") + F.row_number().over(within) - 1)
    placed = placed.withColumn("words", F.col("words0") + F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    placed = ws.save(placed.select("s", "h", "n", "rank", "words"), "placed")
    # The part of one more pass: rows that end within what is left, then the row that fits the remainder best.
    part = placed.join(F.broadcast(plan), same(placed, plan)).select(placed["h"], "n", "rank", "words", "i", "rest")
    inside = F.col("words") + F.col("n") <= F.col("rest")
    cut = {r["i"]: r for r in part.groupBy("i").agg(F.min(F.when(~inside, F.col("rank"))).alias("m"), F.min_by(F.when(~inside, F.struct("h", "words")), F.when(~inside, F.col("rank"))).alias("at")).collect()}
    gaps = small_table(spark, [(i, float(rest[i] - cut[i]["at"]["words"]), cut[i]["m"]) for i in cut if cut[i]["m"] is not None and rest[i] > 0], "i int, gap double, m long")
    near = part.join(F.broadcast(gaps), "i").where((F.col("rank") >= F.col("m")) & (F.abs(F.col("n") - F.col("gap")) < F.col("gap")))
    last = {r["i"]: r["x"] for r in near.groupBy("i").agg(F.min(F.struct(F.abs(F.col("n") - F.col("gap")).alias("d"), "h")).alias("x")).collect()}
    # Quotas: copies of each source in the mix, split over the shards.
    whole = [r["rows"] for r in of]
    taken = [0 if rest[i] <= 0 else cut[i]["m"] if cut[i]["m"] is not None else whole[i] for i in range(len(of))]
    quota = [passes[i] * whole[i] + taken[i] + (i in last) for i in range(len(of))]
    sizes = [sum(quota) // shards + (k < sum(quota) % shards) for k in range(shards)]
    tree = splitting_tree(random.Random(seed), quota, sizes) if of else []
    ends = []
    for i in range(len(of)):
        at = 0
        for k in range(shards - 1):
            at += tree[k][i]
            ends.append((i, k, min(at // max(1, whole[i]), most), at - min(at // max(1, whole[i]), most) * whole[i]))
    # A place in a source's sequence is a pass and a rank; the hash at that rank is the threshold.
    bounds = small_table(spark, ends, "i int, k int, pass int, rank long")
    at_rank = part.select("i", "rank", "h").join(F.broadcast(bounds), ["i", "rank"])
    held = {(r["i"], r["k"]): r["h"] for r in at_rank.select("i", "k", "h").collect()}  # shards x sources at most
    top = (1 << 63) - 1
    table = [(text(r["s"]), i, int(r["words"]), float(goal[i]), passes[i], rest[i] > 0, cut[i]["at"]["h"] if rest[i] > 0 and cut[i]["m"] is not None else None, last[i]["h"] if i in last else None, max((k for k in range(shards) if tree[k][i]), default=0), [{"p": p, "h": held.get((i, k), top)} for j, k, p, _ in ends[i * (shards - 1) : (i + 1) * (shards - 1)]]) for i, r in enumerate(of)]
    names = {x: free_name(df, f"_mix_{x}") for x in ("s", "i", "passes", "more", "cut", "last", "final", "ends")}
    kind = "string"
    table = small_table(spark, table, f"`{names['s']}` {kind}, `{names['i']}` int, mix_source_size long, mix_target double, `{names['passes']}` int, `{names['more']}` boolean, `{names['cut']}` long, `{names['last']}` long, `{names['final']}` int, `{names['ends']}` array<struct<p:int,h:long>>")
    table = table.withColumn(names["s"], F.col(names["s"]).cast(rows.schema["s"].dataType))
    out = keyed.join(F.broadcast(table), keyed[f"`{source_col}`"].eqNullSafe(table[names["s"]]), "left")  # MAX_SOURCES rows at most, held by the driver already
    h, c = F.col(key), {k: F.col(v) for k, v in names.items()}

    def shard(p: Column) -> Column:
        return F.size(F.filter(c["ends"], lambda e: (e["p"] < p) | ((e["p"] == p) & (e["h"] <= h)))).cast("int")

    full = F.when(c["passes"] > 0, F.transform(F.sequence(F.lit(0), c["passes"] - 1), shard)).otherwise(F.array().cast("array<int>"))
    more = F.when(c["more"] & (c["cut"].isNull() | (h < c["cut"])), F.array(shard(c["passes"]))).otherwise(F.array().cast("array<int>"))
    extra = F.when(h == c["last"], F.array(c["final"])).otherwise(F.array().cast("array<int>"))
    ws.drop("keys", "rows", "starts", "placed")
    out = out.withColumn("mix_copies", F.concat(full, more, extra))
    out = out.withColumn("mix_order", F.transform("mix_copies", lambda _, k: F.xxhash64(F.lit(seed + 1), k, h)))
    return out.select(*[f"`{x}`" for x in df.columns], *news)


def mixed_rows(df: DataFrame, seed: int = 7, **options) -> DataFrame:
    """The mix itself: a row for each copy, gathered by output shard and shuffled there; the columns of df."""
    out = mix_sources(df, seed=seed, **options)
    copy, shard, order = (free_name(df, f"_{x}") for x in ("copy", "shard", "order"))
    out = out.select(*[f"`{x}`" for x in df.columns], F.explode(F.arrays_zip("mix_copies", "mix_order")).alias(copy))
    out = out.withColumns({shard: F.col(copy)["mix_copies"], order: F.col(copy)["mix_order"]})
    # A shard is dealt to SPREAD partitions, each shuffled locally.
    out = out.repartition(shard, F.pmod(F.col(order), F.lit(SPREAD))).sortWithinPartitions(shard, order)
    return out.select(*[f"`{x}`" for x in df.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of mix_sources over all documents, with the output shard of each copy that the tree deals
    and the number that orders the copy there."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_copies")).alias("taken"), F.col("mix_copies").alias("shards"), F.col("mix_order").alias("orders"))
