"""Fuzzy line dedup: MinHash signatures of character shingles, banding, exact verification, distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MayHold, Scratch, free_name
from .components import components
from .grouping import grouped
from .jaccard import bit_sketch, compared, open_members
from .shingles import mix

#: Characters of a shingle; the similarity from which lines are one.
CHARS, THRESHOLD = 5, Fraction(80, 100)
#: A signature has PASSES one-permutation sketches of BINS minima; ROWS of them make a band. Two lines at the threshold
#: share one of the 16 bands with a probability of 99 percent, at 0.85 of 99.97.
PASSES, BINS, ROWS = 2, 48, 6
BANDS = PASSES * BINS // ROWS
#: Characters whose shingles are hashed at once: as many as a core's cache holds.
AT_ONCE = 50_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What a step to the right adds to the minimum that an empty bin takes.
_FAR = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors that make PASSES hashes of one.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
_P, _P2 = np.uint64(0x100000001B3), np.uint64(0x100000001B3**2 & 0xFFFFFFFFFFFFFFFF)
#: Groups of a band of over this many lines are linked through a leader first.
SMALL = 4


#: White space but for the space and the line's end.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]


def normal_lines(text: str) -> list[str]:
    """The `\\n`-split lines of a text, lower-cased, runs of white space as one space and none at the ends."""
    low = text.lower()
    if "  " in low or any(c in low for c in _SPACES):
        return [" ".join(x.split()) for x in low.split("\n")]
    return [x.strip(" ") for x in low.split("\n")]


def line_id(line: str) -> int:
    """A 62-bit hash of a normalised line, its lowest bit free."""
    return (xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) >> 1) & ~1


def grams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, lines they are of) of all CHARS-character shingles; a shorter line is one shingle."""
    padded = [x.ljust(CHARS, "\0") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = codes[:-1] * _P
    two += codes[1:]
    h = two[:-3] * _P2
    h += two[2:-1]
    h *= _P
    h += codes[4:]
    good = np.ones(len(h), bool)
    ends = np.cumsum(size)[:-1]
    for k in range(1, CHARS):
        good[ends - k] = False
    return mix(h[good]), np.repeat(np.arange(len(lines)), size - CHARS + 1)


#: Lines whose sets are made at once, at most; sets hold the upper 56 bits of hashes, marked by the line in the lowest 8.
MARKED = 200


def marked_sets(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 56-bit shingle hashes below their line's number, sorted; sizes) of the sets of MARKED lines at most."""
    h, of = grams(lines)
    x = (h >> np.uint64(8)) | (of.astype(np.uint64) << np.uint64(56))
    x.sort()
    x = x[np.concatenate(([True], x[1:] != x[:-1]))]
    return x, np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=len(lines))


def in_parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of MARKED lines at most, of about AT_ONCE characters together or of one line."""
    at, total = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if k > at and (k - at >= MARKED or total + n > AT_ONCE):
            yield at, k
            at, total = k, 0
        total += n
    if len(sizes):
        yield at, len(sizes)


def filled(low: np.ndarray) -> None:
    """An empty bin takes the minimum of the next one to its right that has one, marked by the distance; `low` is (lines, BINS)."""
    gone = low == _EMPTY
    rows = np.flatnonzero(gone.any(1))
    if not len(rows):
        return
    bins = np.arange(BINS, dtype=np.int16)
    at = np.where(gone[rows], np.int16(2 * BINS), bins)
    at = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1]
    at = np.where(at < BINS, at, at[:, :1] + np.int16(BINS))  # round the end, to the first
    far = (at - bins).astype(np.uint64)
    own = at.astype(np.int64)
    own[own >= BINS] -= BINS
    far *= _FAR
    low[rows] = np.take_along_axis(low[rows], own, 1) + far


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, bands) keys of the lines' MinHash signatures."""
    n = len(lines)
    h, of = grams(lines)
    of *= BINS
    x, high = np.empty_like(h), np.empty_like(h)  # made once: most of the time would go to memory that comes and goes
    out = []
    for factor in _FACTORS[:PASSES]:
        np.multiply(h, factor, out=x)
        low = np.full(n * BINS, _EMPTY)
        np.right_shift(x, np.uint64(32), out=high)  # its product with BINS names the bin, and orders the values of a bin
        high *= np.uint64(BINS)
        at = (high >> np.uint64(32)).view(np.int64)
        at += of
        high <<= np.uint64(32)
        x &= np.uint64(0xFFFFFFFF)
        high |= x
        np.minimum.at(low, at, high)
        low = low.reshape(n, BINS)
        filled(low)
        out.append(low)
    sig = np.concatenate(out, 1).reshape(n, -1, ROWS)
    key = np.zeros(sig.shape[:2], np.uint64)
    for k in range(ROWS):
        key = mix(key + sig[:, :, k])
    return mix(key + np.arange(sig.shape[1], dtype=np.uint64)[None, :])


OCCURRENCES = "id long, row long, at long, line long, keys array<long>"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with a word, and the band keys of those that this task hasn't seen (as far as the last million tell)."""
    seen: set[int] = set()
    held: tuple[list, ...] = ([], [], [], [])
    fresh: list[int] = []
    texts: list[str] = []
    chars = 0

    def out() -> pa.RecordBatch:
        step = max(1, len(texts) * AT_ONCE // max(1, chars))
        own = [band_keys(texts[at : at + step]).view(np.int64) for at in range(0, len(texts), step)]
        flat = np.concatenate(own) if own else np.empty((0, BANDS), np.int64)
        new = np.zeros(len(held[0]), bool)
        new[fresh] = True
        ends = np.concatenate(([0], np.cumsum(new) * BANDS)).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~new, False)), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in held), keys], ["id", "row", "at", "line", "keys"])

    ids, docs, at, line = held
    for batch in batches:
        for i, row, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            i, row = i.as_py(), row.as_py()
            for k, x in enumerate(normal_lines(text.as_py() or "")):
                if not x:
                    continue
                h = line_id(x)
                ids.append(i), docs.append(row), at.append(k), line.append(h)
                if h not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(h)
                    fresh.append(len(held[0]) - 1), texts.append(x)
                    chars += len(x)
                if chars > 400_000 or len(held[0]) >= 20_000:
                    yield out()
                    held, fresh, texts, chars = ([], [], [], []), [], [], 0
                    ids, docs, at, line = held
    if held[0]:
        yield out()


def _pick(wanted: MayHold):
    """Lines that may be wanted, by their ids; a task gives a line once (as far as the last million tell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                texts = [x for text in batch.column(0).slice(at, 200).to_pylist() for x in normal_lines(text) if x]
                ids = np.fromiter(map(line_id, texts), np.int64, len(texts))
                out: dict[int, str] = {}
                for k in np.flatnonzero(wanted(ids)).tolist():
                    if (h := int(ids[k])) not in seen:
                        seen.add(h)
                        out[h] = texts[k]
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.int64()), pa.array(out.values(), pa.string())], ["sid", "x"])

    return run


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.utf8_length(texts).to_numpy(zero_copy_only=False)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and bit sketch of each line's shingle set."""
    for batch in batches:
        for a, b in in_parts(_lengths(batch.column(1))):
            some = batch.slice(a, b - a)
            x, size = marked_sets(some.column(1).to_pylist())
            sets = np.split(x & np.uint64((1 << 56) - 1), np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size), pa.array(map(bit_sketch, sets), pa.binary())], ["sid", "n", "sketch"])


def shared(xs: list[str], ys: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (xs[of[k]], ys[k]): sizes of both sets and of what they share."""
    left, n = marked_sets(xs)
    right, m = marked_sets(ys)
    n = n[of]
    begin = np.concatenate(([0], np.cumsum(np.bincount((left >> np.uint64(56)).astype(np.int64), minlength=len(xs)))))[of]
    pair = np.repeat(np.arange(len(ys), dtype=np.uint64) << np.uint64(56), n)
    at = np.arange(len(pair)) + np.repeat(begin - np.cumsum(n) + n, n)
    own = left[at]
    own &= np.uint64((1 << 56) - 1)
    own |= pair
    both = np.concatenate((own, right))
    both.sort(kind="stable")  # two sorted runs are merged
    twice = both[1:][both[1:] == both[:-1]]
    return n, m, np.bincount((twice >> np.uint64(56)).astype(np.int64), minlength=len(ys))


def _similar(threshold: Fraction):
    p, q = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # pairs come sorted by a
            keep = [np.empty(0, bool)]
            for at, end in in_parts(_lengths(batch.column("xa")) + _lengths(batch.column("xb"))):
                part = batch.slice(at, end - at)
                a = part.column("a").to_numpy()
                new = np.concatenate(([True], a[1:] != a[:-1]))
                n, m, both = shared(part.column("xa").filter(pa.array(new)).to_pylist(), part.column("xb").to_pylist(), np.cumsum(new) - 1)
                keep.append(q * both >= p * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))

    return run


def _links(near: DataFrame, lines: DataFrame, ws: Scratch, name: str, threshold: Fraction) -> DataFrame:
    """The pairs of `near` that the lines themselves confirm."""
    both = near.join(lines.select(F.col("sid").alias("b"), F.col("x").alias("xb")), "b").join(lines.select(F.col("sid").alias("a"), F.col("x").alias("xa")), "a")
    return ws.save(both.sortWithinPartitions("a").select("a", "b", "xa", "xb").mapInArrow(_similar(threshold), "a long, b long"), f"links-{name}")


def line_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, small: int = SMALL) -> DataFrame:
    """(id, line_no, class_id, class_line, kept) for every line with a word of every whole text.

    Lines (`\\n`-split, lower-cased, white space runs as one space) whose sets of CHARS-character shingles have a Jaccard
    similarity of `threshold` or more are linked; (class_id, class_line) is the first line, by id and number, of the
    component, the one that is kept. Lines shorter than a shingle are compared whole. Null and empty texts have no
    lines; null ids come first; rows equal in id and text are one document; other columns are ignored.
    Candidates are lines that share a band (see ROWS); a band's group of over `small` lines is linked through leaders
    that differ from band to band, and where this leaves several components, sketches decide in the group which lines
    of different components are compared."""
    out = _classes(df, id_col, text_col, threshold, small)
    return out.select(F.col("id").alias(id_col), F.col("at").alias("line_no"), F.col("head_id").alias("class_id"), F.col("head_at").alias("class_line"), "kept")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: Fraction, small: int) -> DataFrame:
    """(id, row, at, head_id, head_at, kept) of every line; row is a hash of id and text."""
    ws = Scratch(df.sparkSession, "lines")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("row"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    keyed = ws.save(rows.mapInArrow(_occurrences, OCCURRENCES), "keyed", repeats=False)
    found = grouped(keyed.select(F.col("line").alias("v"), "keys").where("keys is not null"), small, 1, ws)
    seen = ws.save(keyed.drop("keys"), "seen", repeats=False)
    ws.drop("keyed")
    pairs = ws.save(found.where("key is null").select("a", "b").distinct(), "pairs")
    large = ws.save(found.where("key is not null").select("key", F.col("a").alias("v")), "large")
    ws.drop("found", "found-wide")
    ends = ws.save(pairs.select(F.col("a").alias("line")).unionAll(pairs.select("b")).unionAll(large.select("v")).distinct(), "ends")
    twice = seen.groupBy("line").count().where("count > 1").select("line")
    some = ws.save(twice.unionAll(ends).distinct().withColumn("some", F.lit(True)), "some")
    # Lines that occur once and are like no other are their own class; the others are fewer.
    seen = ws.save(seen.join(some, "line", "left"), "marked", repeats=False)
    ws.drop("seen", "some")
    lines = rows.select("text").mapInArrow(_pick(MayHold(ends, "line")), "sid long, x string")
    lines = ws.save(lines.join(ends.withColumnRenamed("line", "sid"), "sid", "left_semi").dropDuplicates(["sid"]), "lines", repeats=False)
    links = _links(pairs, lines, ws, "first", threshold)
    roots = components(links, ws, "roots-first")
    if not large.isEmpty():
        members = ws.save(open_members(large, roots, ws), "open")
        own = ws.save(members.select(F.col("v").alias("sid")).distinct(), "own")
        own = lines.where(MayHold(own, "sid").column("sid")).join(own, "sid", "left_semi")
        nodes = ws.save(own.select("sid", "x").mapInArrow(_shapes, "sid long, n long, sketch binary"), "nodes")
        rest = compared(members, nodes, threshold, None).select("a", "b").distinct()
        rest = ws.save(rest, "near-rest")
        ends = MayHold(rest.select("a").unionAll(rest.select("b")), "a")
        fresh = _links(rest, lines.where(ends.column("sid")), ws, "rest", threshold)
        if not fresh.isEmpty():
            roots = components(links.unionAll(fresh), ws, "roots-rest")
    place = seen.where("some").join(roots.withColumnRenamed("v", "line"), "line", "left").select("line", "id", "row", "at", F.coalesce("root", "line").alias("root"))
    place = ws.save(place, "rooted")
    heads = ws.save(place.groupBy("root").agg(F.min(F.struct("id", "at", "row")).alias("head")), "heads")
    ws.drop("lines", "pairs", "large", "ends")
    first = F.col("head.id"), F.col("head.at"), F.col("head.row")
    kept = F.col("id").eqNullSafe(first[0]) & (F.col("at") == first[1]) & (F.col("row") == first[2])
    out = place.join(heads, "root").select("id", "row", "at", first[0].alias("head_id"), first[1].alias("head_at"), kept.alias("kept"))
    return seen.where("some is null").select("id", "row", "at", F.col("id").alias("head_id"), F.col("at").alias("head_at"), F.lit(True).alias("kept")).unionAll(out)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: Fraction = THRESHOLD, small: int = SMALL) -> DataFrame:
    """df without the lines that line_classes doesn't keep; blank lines, null and empty texts and all other columns
    (whatever their names) stay as they are.

    Rows are told apart by id and text, so rows of one id (or of a null id) with different texts lose their own lines
    only; a row repeated in both keeps its lines in every copy."""
    lines = _classes(df, id_col, text_col, threshold, small).where("not kept").distinct()
    row, gone = free_name(df, "_row"), free_name(df, "_gone")
    lines = lines.groupBy(F.col("row").alias(row)).agg(F.collect_set("at").alias(gone))
    out = df.withColumn(row, F.xxhash64(f"`{id_col}`", f"`{text_col}`")).join(lines, row, "left")
    parts = F.transform(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x, k: F.struct(x.alias("x"), F.array_contains(F.col(gone), k.cast("long")).alias("gone")))
    keep = F.transform(F.filter(parts, lambda s: ~s["gone"]), lambda s: s["x"])
    text = F.when(F.col(gone).isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(keep, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents with its class, and whether it is the one kept."""
    return line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
