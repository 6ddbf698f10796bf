"""Exact n-gram Jaccard join by parity sketches.

A document's set of shingle hashes is cut into segments by hash range, and each segment is folded by XOR: a parity
sketch. A token in one set but not in the other changes one segment, so sets whose symmetric difference is at most k
agree on all but k segments. Documents of like size (a size band) use the same number of segments, k plus one plus a
slack for empty ones; two that are similar enough then share a whole nonempty segment, which is joined on. Pairs are
pruned by size and by the Hamming distance of bit-parity sketches (a lower bound of the symmetric difference), and
what is left is verified on the texts. No pair at or above the threshold is missed.

Segments shared by many documents aren't expanded into all pairs: their members are linked to a leader first. Where
that leaves several components, sketches decide in the group which members of different components may be similar,
and only those pairs are written. Groups too large for that (documents that share boilerplate) are dealt again by
their rarest shingles, as many of them as similar sets can't all differ in, and what is still too large by another,
independent segmentation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MayHold, Scratch, free_name, freed
from .components import components
from .grouping import GROUPS, grouped
from .shingles import WordHashes, mix, shingles

#: Groups up to this size are expanded into pairs; members of larger ones are linked to LEADERS of them.
SMALL, LEADERS = 8, 1
#: Members of a group of several components whose sketches are compared in one task.
BIG = 4096
#: Sets that a task remembers, so that copies have keys once.
SEEN = 200_000
#: Bytes of a key that are left 0, and what that leaves of it: equal ones of different segments only add a pair that sizes and sketches rule out.
LOW, TOLD = 2, np.uint64(~0xFFFF & (1 << 64) - 1)
#: Words of sketches that are compared at once.
AT_ONCE = 1 << 21
#: Pairs and groups that are written as one batch.
WRITTEN = 10_000


class Bands:
    """Size bands and, for each, the segments that let similar sets share one."""

    def __init__(self, threshold: Fraction, ratio: float = 1.5):
        self.t = threshold
        # Below this size, sets that differ can't reach the threshold.
        self.least = max(1, math.ceil(threshold / (1 - threshold))) if threshold < 1 else 1 << 60
        self.edges = [self.least]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * ratio)))
        self.memo: dict[int, tuple[int, int]] = {}

    def of(self, n: int) -> list[int]:
        """The band of a set of n shingles and, if it may match larger sets there, the next one."""
        lo, hi = 0, len(self.edges) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.edges[mid] <= n else (lo, mid - 1)
        return [lo, lo + 1] if n >= self.t * self.edges[lo + 1] else [lo]

    def reach(self, band: int) -> int:
        """Largest n with which a set below may be matched at `band`: one band may not hold all partners if the ratio is small."""
        return self.edges[band + 1] - 1

    def segments(self, band: int) -> tuple[int, int]:
        """Segments of a band, and how many of them may be empty without being joined on."""
        if band not in self.memo:
            most, low = self.reach(band), max(1, math.ceil(self.t * self.edges[band]))
            k = int((1 - self.t) / (1 + self.t) * 2 * most)
            slack = 0
            while True:
                m = k + 1 + slack
                mean = m * (1 - 1 / m) ** low if m > 1 else 0.0
                tail, p = 1.0, math.exp(-mean)
                for i in range(slack + 1):
                    tail -= p
                    p *= mean / (i + 1)
                if tail <= 1e-3 or slack > k + 8:
                    break
                slack += 1
            self.memo[band] = m, slack
        return self.memo[band]


def segment_keys(u: np.ndarray, m: int, slack: int, salt: int) -> np.ndarray:
    """Keys of the XOR-folded segments of the sorted hashes u; empty segments have keys only if there are over `slack` of them."""
    seg = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    where, fold = seg[starts], np.bitwise_xor.reduceat(u, starts)
    if m - len(where) > slack:
        gone = np.setdiff1d(np.arange(m, dtype=np.uint64), where)
        where, fold = np.concatenate((where, gone)), np.concatenate((fold, np.zeros(len(gone), np.uint64)))
    return mix(mix(fold ^ np.uint64(salt)) + where * np.uint64(0x9E3779B97F4A7C15))


def bit_sketch(u: np.ndarray) -> bytes:
    """Parity of how many hashes fall on each bit; at least twice as many bits as hashes, a power of two."""
    bits = 1 << max(6, (2 * len(u) - 1).bit_length())
    odd = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two bit sketches, the longer one folded to the shorter's length."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


DOCS = "id long, row long, sid long, n long, sketch binary, keys long"


def _set_id(u: np.ndarray) -> int:
    return (xxhash.xxh3_64_intdigest(u.tobytes()) >> 1) & ~1


def _sketches(width: int, threshold: Fraction):
    """DOCS of (id, row, text); keys: about how many keys the set has."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), Bands(threshold), set()
        for batch in batches:
            ids, rows, texts = (batch.column(k) for k in range(3))
            for at in range(0, batch.num_rows, 256):
                sid, size, sketch, keys = [], [], [], []
                for text in texts.slice(at, 256).to_pylist():
                    u = shingles(text, width, hashes)
                    s = _set_id(u) if len(u) else None
                    sid.append(s)
                    size.append(len(u))
                    if s is None or s in seen or len(u) < bands.least:
                        sketch.append(None), keys.append(None)
                        continue
                    if len(seen) < SEEN:
                        seen.add(s)
                    sketch.append(bit_sketch(u))
                    keys.append(sum(bands.segments(b)[0] for b in bands.of(len(u))))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), rows.slice(at, 256), pa.array(sid, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.int64())], ["id", "row", "sid", "n", "sketch", "keys"])

    return run


def _keys(width: int, threshold: Fraction):
    """(v, keys) of texts: the segments of each set in its band and, with v's lowest bit set, in the next. They are made
    from the texts once more rather than kept, as they take more room than the texts."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands, seen = WordHashes(), Bands(threshold), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                v, keys = [], []
                for text in batch.column(0).slice(at, 256).to_pylist():
                    u = shingles(text, width, hashes)
                    if len(u) < bands.least or (s := _set_id(u)) in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(s)
                    for up, b in enumerate(bands.of(len(u))):
                        v.append(s | up)
                        keys.append((segment_keys(u, *bands.segments(b), b) & TOLD).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["v", "keys"])

    return run


def _close(threshold: Fraction):
    """Keeps pairs whose sizes and sketches leave the threshold in reach."""
    p, q = threshold.numerator, threshold.denominator

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            sa, sb = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
            keep = (q * np.minimum(na, nb) >= p * np.maximum(na, nb)).tolist()
            for i, good in enumerate(keep):
                if good:
                    keep[i] = hamming(sa[i], sb[i]) * (p + q) <= (q - p) * (int(na[i]) + int(nb[i]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(threshold: Fraction, most: int | None):
    """From (key, v, c, n, sketch, keys) sorted by key: pairs (null key) of different components that sizes and sketches
    leave in reach of the threshold; (key, v, null) for the members of groups of over `most`. Where `keys` lists a
    member's groups, a pair is written in the first group that both are in, not again in the others."""
    p, q = threshold.numerator, threshold.denominator

    def pairs(key: int, v: np.ndarray, c: np.ndarray, n: np.ndarray, sketches: list[bytes], keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        width = min(map(len, sketches)) // 8
        x = np.empty((len(v), width), np.uint64)
        for i, raw in enumerate(sketches):
            row = np.frombuffer(raw, np.uint64)
            while len(row) > width:
                row = row[: len(row) // 2] ^ row[len(row) // 2 :]
            x[i] = row
        ids, count = np.unique(c, return_counts=True)
        main = c == ids[count.argmax()]
        order = np.concatenate((np.flatnonzero(~main), np.flatnonzero(main)))
        v, c, n, x, odd = v[order], c[order], n[order], x[order], int((~main).sum())
        own = lru_cache(1024)(lambda k: set(keys[int(order[k])].as_py()))
        out_a, out_b = [], []
        step = max(1, AT_ONCE // (len(v) * width))
        for at in range(0, odd, step):
            i = np.arange(at, min(odd, at + step))
            far = np.bitwise_count(x[i, None, :] ^ x[None, at:, :]).sum(2, dtype=np.int64)
            ni, nj = n[i, None], n[None, at:]
            good = (far * (p + q) <= (q - p) * (ni + nj)) & (q * np.minimum(ni, nj) >= p * np.maximum(ni, nj)) & (c[i, None] != c[None, at:]) & (i[:, None] < np.arange(at, len(v))[None, :])
            a, b = np.nonzero(good)
            a, b = i[a], at + b
            if keys.null_count < len(keys):
                first = np.array([min(own(x) & own(y)) == key for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
                a, b = a[first], b[first]
            out_a.append(v[a]), out_b.append(v[b])
        return np.concatenate(out_a), np.concatenate(out_b)

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, total = None, [], 0
        found: list[tuple[np.ndarray, np.ndarray]] = []  # pairs of small groups, written together
        ready = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ready
            v, c, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            if (c == c[0]).all():
                return
            _, first = np.unique(v, return_index=True)
            v, c, n = v[first], c[first], n[first]
            sketches, keys = (pa.concat_arrays([h[k] for h in held]).take(pa.array(first)) for k in (3, 4))
            a, b = pairs(int(key), v, c, n, sketches.to_pylist(), keys)
            found.append((np.minimum(a, b), np.maximum(a, b)))
            ready += len(a) + 1
            if ready >= WRITTEN:
                yield out()

        def out() -> pa.RecordBatch:
            nonlocal ready
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            found.clear()
            ready = 0
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["key", "a", "b"])

        def large(k: int, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k)), pa.array(v), pa.nulls(len(v), pa.int64())], ["key", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, c, n = (batch.column(i).to_numpy() for i in range(4))
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            ends = np.append(starts[1:], len(k))
            for s, e in zip(starts, ends, strict=True):
                if k[s] != key:
                    if total > 1 and held:
                        yield from close()
                    key, held, total = k[s], [], 0
                elif e - s == 1 and not total:
                    continue
                total += e - s
                if most is not None and total > most:
                    for h in held:
                        yield large(key, h[0])
                    held = []
                    yield large(key, v[s:e])
                else:
                    held.append((v[s:e], c[s:e], n[s:e], *(batch.column(x).slice(s, e - s) for x in (4, 5))))
        if total > 1 and held:
            yield from close()
        if found:
            yield out()

    return run


def compared(members: DataFrame, nodes: DataFrame, threshold: Fraction, most: int | None) -> DataFrame:
    rows = members.join(nodes.select(F.col("sid").alias("v"), "n", "sketch"), "v")
    return rows.repartition("key").sortWithinPartitions("key").select("key", "v", "c", "n", "sketch", "keys").mapInArrow(_compare(threshold, most), GROUPS)


def _verified(width: int, threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, np.ndarray] = {}

        def of(key: int, text: pa.StringScalar) -> np.ndarray:
            if key not in held:
                if len(held) > 64:
                    held.pop(next(iter(held)))
                held[key] = shingles(text.as_py(), width, hashes)
            return held[key]

        for batch in batches:
            keep = []
            for x, y, s, t in zip(*(batch.column(k) for k in range(4)), strict=True):
                u, v = of(x.as_py(), s), of(y.as_py(), t)
                both = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(q * both >= p * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _again(width: int, threshold: Fraction):
    """New keys for the members of large groups: the old key with a segment of another segmentation."""

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(), Bands(threshold)
        for batch in batches:
            for sid, comp, keys, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                u = shingles(text, width, hashes)
                u = np.sort(mix(u + np.uint64(1)))
                of = np.array(keys, np.int64).view(np.uint64)
                for up, b in enumerate(bands.of(len(u))):
                    new = segment_keys(u, *bands.segments(b), b + 1000)
                    for at in range(0, len(of), max(1, 500_000 // len(new))):
                        k = mix(of[at : at + max(1, 500_000 // len(new)), None] ^ new[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([_signed(k), pa.array(np.full(len(k), sid | up)), pa.array(np.full(len(k), comp))], ["key", "v", "c"])

    return run


def _tokens(width: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for sid, comp, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                u = shingles(text, width, hashes)
                yield pa.RecordBatch.from_arrays([_signed(u), pa.array(np.full(len(u), sid)), pa.array(np.full(len(u), comp))], ["key", "v", "c"])

    return run


def _rarest(tokens: DataFrame, threshold: Fraction) -> DataFrame:
    """Each set's rarest shingles: so many that a set which lacks them all is below the threshold."""
    often = tokens.groupBy("key").count()
    sets = tokens.join(often, "key").groupBy("v", "c").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("all"))
    n = F.size("all")
    most = n - F.floor((n * threshold.numerator + threshold.denominator - 1) / threshold.denominator) + 1
    return sets.select(F.explode(F.slice("all", 1, F.greatest(most, F.lit(1)).cast("int"))).alias("x"), "v", "c").select("x.key", "v", "c")


def _links(rows: DataFrame, nodes: DataFrame, near: DataFrame, ws: Scratch, name: str, width: int, threshold: Fraction) -> DataFrame:
    """The pairs of `near` that the texts confirm."""
    at = nodes.select(F.col("sid").alias("v"), "row")
    ends = ws.save(near.select(F.col("a").alias("v")).unionAll(near.select("b")).distinct().join(at, "v"), f"ends-{name}")
    texts = rows.select("row", "text").where(MayHold(ends, "row").column("row")).join(ends, "row").dropDuplicates(["v"])
    texts = ws.save(texts.select("v", "text"), f"texts-{name}")
    both = near.join(texts.select(F.col("v").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("tb")), "b")
    out = ws.save(both.select("a", "b", "ta", "tb").mapInArrow(_verified(width, threshold), "a long, b long"), f"links-{name}")
    ws.drop(f"ends-{name}", f"texts-{name}")
    return out


def near_pairs(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) that sizes and sketches of nodes (sid, n, sketch) leave in reach of the threshold."""
    side = lambda x: nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_close(threshold), "a long, b long")


def open_members(large: DataFrame, roots: DataFrame, ws: Scratch) -> DataFrame:
    """(key, v, c, keys): the members of large groups (key, v) of several components, with all their groups."""
    members = large.join(roots, "v", "left").select("key", "v", F.coalesce("root", "v").alias("c"))
    open_ = members.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    members = ws.save(members.join(open_, "key"), "members")
    return members.join(members.groupBy("v").agg(F.collect_set("key").alias("keys")), "v")


def _rest(rows: DataFrame, nodes: DataFrame, large: DataFrame, roots: DataFrame, ws: Scratch, width: int, threshold: Fraction, big: int) -> DataFrame:
    """Pairs of different components in large groups that sketches leave in reach of the threshold."""
    members = open_members(large, roots, ws)
    found = ws.save(compared(members, nodes, threshold, big), "compared-1")
    near = found.where("key is null").select("a", "b")
    for level in (2, 3):
        wide = found.where("key is not null").groupBy(F.col("a").alias("v")).agg(F.collect_set("key").alias("keys"))
        wide = ws.save(wide.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("c"), "keys"), f"wide-{level}")
        if wide.isEmpty():
            break
        whose = ws.save(wide.select("v", "c").join(nodes.select(F.col("sid").alias("v"), "row"), "v"), f"whose-{level}")
        texts = rows.select("row", "text").where(MayHold(whose, "row").column("row")).join(whose, "row").dropDuplicates(["v"])
        if level == 2:
            keys = _rarest(texts.select("v", "c", "text").mapInArrow(_tokens(width), "key long, v long, c long"), threshold)
        else:
            keys = texts.join(wide.select("v", "keys"), "v").select("v", "c", "keys", "text").mapInArrow(_again(width, threshold), "key long, v long, c long")
            keys = keys.withColumn("v", F.col("v").bitwiseAND(F.lit(-2)))
        keys = keys.withColumn("keys", F.lit(None).cast("array<long>"))
        found = ws.save(compared(keys, nodes, threshold, big if level == 2 else None), f"compared-{level}")
        near = near.unionAll(found.where("key is null").select("a", "b"))
    return ws.save(near.distinct(), "near-rest")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, threshold: Fraction = Fraction(85, 100), small: int = SMALL, big: int = BIG) -> DataFrame:
    """(id, n_shingles long, component_id) for every row of df: n_shingles is the size of its set of `width`-word
    shingles, component_id the least id that links reach; rows link when the Jaccard similarity of their sets is at
    least `threshold`.

    Null, empty and blank texts have no shingles and no links; a text of fewer words than `width` is one shingle.
    Equal sets (copies) are one vertex, emitted once by each task, so any number of copies costs one set of keys.
    A null id takes part in links but never names a component unless all its members' ids are null. Repeated rows
    come back as often. Other columns are ignored. Sets are told apart by 62-bit hashes."""
    docs, of = _rooted(df, id_col, text_col, width, threshold, small, big)
    names = of.groupBy("root").agg(F.min("least").alias("component_id"))
    names = of.join(names, "root").select("sid", "component_id")
    out = docs.join(names, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _rooted(df: DataFrame, id_col: str, text_col: str, width: int, threshold: Fraction, small: int = SMALL, big: int = BIG) -> tuple[DataFrame, DataFrame]:
    """(DOCS of every row, (sid, least id, first (id, row), root) of every set of shingles): equal roots are one
    component."""
    ws = Scratch(df.sparkSession, "jaccard")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text"))
    docs = ws.save(rows.mapInArrow(_sketches(width, threshold), DOCS), "docs")
    nodes = ws.save(docs.where("sketch is not null").groupBy("sid").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")
    keys = rows.select("text").mapInArrow(_keys(width, threshold), "v long, keys array<long>")
    found = grouped(keys, small, LEADERS, ws, n=docs.select(F.sum("keys")).first()[0] or 0, low=LOW)
    near = ws.save(near_pairs(ws.save(found.where("key is null").select("a", "b").distinct(), "pairs"), nodes, threshold), "near")
    links = _links(rows, nodes, near, ws, "first", width, threshold)
    roots = components(links, ws, "roots-first")
    large = ws.save(found.where("key is not null").select("key", F.col("a").alias("v")).distinct(), "large")
    ws.drop("pairs", "near", "found")
    if not large.isEmpty():
        rest = _rest(rows, nodes, large, roots, ws, width, threshold, big)
        fresh = _links(rows, nodes, rest, ws, "rest", width, threshold)
        if not fresh.isEmpty():
            roots = components(links.unionAll(fresh), ws, "roots-rest")
    of = docs.groupBy("sid").agg(F.min("id").alias("least"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row"))).alias("first")).where("sid is not null")
    return docs, of.join(roots.withColumnRenamed("v", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's classes of all documents: 4-word shingles, Jaccard similarity of 0.85 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: Fraction = Fraction(80, 100)) -> DataFrame:
    """df with one row of each component of jaccard_components: the one with the least id (of several texts with that
    id, one by a hash); rows without shingles or with a null id stay. Rows go by id and text, so a repeated id with
    texts of different components keeps each that is first in its own. Of rows repeated in id and text one stays. All
    columns are kept."""
    ws = Scratch(df.sparkSession, "groups")
    docs, of = _rooted(df, id_col, text_col, width, threshold)
    names = of.select("sid", "root").join(of.groupBy("root").agg(F.min("first").alias("first")), "root").select("sid", "first")
    classes = ws.save(docs.where("id is not null").select("id", "row", "sid").join(names, "sid", "left").select("id", "row", "first"), "classes")
    gone = ws.save(classes.where("id <> first.id or row <> first.row").select("id", "row").distinct(), "gone")
    number, row, may = (free_name(df, x) for x in ("_id", "_row", "_may"))
    keyed = df.withColumns({number: F.col(f"`{id_col}`").cast("long"), row: F.xxhash64(f"`{id_col}`", f"`{text_col}`")}).withColumn(may, MayHold(gone, "row").column(row))
    out = keyed.where(f"not `{may}`").unionAll(keyed.where(may).join(gone, (F.col(number) == gone["id"]) & (F.col(row) == gone["row"]), "left_anti"))
    twice = ws.save(classes.groupBy("id", "row").count().where("count > 1").select("id", "row"), "twice")
    if not twice.isEmpty():
        again = MayHold(twice, "row").column(row) & F.col(number).isNotNull()
        out = out.where(~again).unionAll(out.where(again).dropDuplicates([number, row]))
    return out.select(*[f"`{c}`" for c in df.columns])


#: The contract in SQL: every pair that shares a shingle is counted, links are followed by recursion.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END)) AS g FROM w
), n AS (
  SELECT d.doc_id, count(g.g) AS n FROM documents d LEFT JOIN g USING (doc_id) GROUP BY 1
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2
"""
