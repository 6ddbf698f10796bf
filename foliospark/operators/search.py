"""Needles in haystacks: which texts hold which needles, exactly or within a few edits."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.match import sellers
from ..functions.text import normalize_text
from ..sources.sinks import written_once

#: Needles, and characters of needles, that one automaton holds in each task; more are found by joins.
PASS_NEEDLES, PASS_CHARS = 50_000, 4_000_000


def pieces(needle: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their places: k edits leave one of them unchanged."""
    cuts = [len(needle) * i // (k + 1) for i in range(k + 2)]
    return [(a, needle[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Finder:
    """Needles in one automaton; calling it gives the numbers of those that a text holds."""

    def __init__(self, needles: list[str], k: int):
        self.needles, self.k, self.machine = needles, k, ahocorasick.Automaton()
        # So few characters are within k edits of anything (with no edits, the empty needle is in every text).
        self.always = {x for x, n in enumerate(needles) if len(n) <= k}
        parts: dict[str, list[tuple[int, int]]] = {}
        for x, n in enumerate(needles):
            if x not in self.always:
                for at, piece in pieces(n, k):
                    parts.setdefault(piece, []).append((x, at + len(piece)))
        for piece, to in parts.items():
            self.machine.add_word(piece, to)
        if parts:
            self.machine.make_automaton()

    def __call__(self, text: str) -> set[int]:
        found = set(self.always) if text or not self.k else set()
        if not len(self.machine):
            return found
        if not self.k:
            return found.union(x for _, to in self.machine.iter(text) for x, _ in to)
        looked: set[tuple[int, int]] = set()
        for end, to in self.machine.iter(text):
            for x, upto in to:
                start = end + 1 - upto  # where the needle begins if nothing before the piece was edited
                if x in found or (x, start) in looked:
                    continue
                looked.add((x, start))
                n = self.needles[x]
                if sellers(text[max(0, start - self.k) : start + len(n) + self.k], n, self.k):
                    found.add(x)
        return found


def _search(held: list[tuple[object, str]], k: int, names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Finder([n for _, n in held], k)
        for batch in batches:
            rows, ids = [], []
            for r, text in enumerate(batch.column(batch.num_columns - 1)):
                for x in sorted(find(text.as_py())):
                    rows.append(r), ids.append(held[x][0])
            kept = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(ids, kind)], names)

    return run


#: Characters of a gram, and grams in a window whose least hash stands for it.
GRAM, WINDOW = 6, 8
#: Bits of the filter that says which keys a table may hold (16 MB, whatever its size).
FILTER_BITS = 1 << 27


class Grams:
    """Hashes of the runs of characters of many texts, all at once."""

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(self.points))  # characters up to the text's end

    def hashes(self, size: int) -> np.ndarray:
        """A 64-bit hash of the `size` characters from each place on; those that go beyond a text's end mean nothing."""
        n = len(self.points) - size + 1
        out = np.full(max(n, 0), size, np.uint64)
        for j in range(size if n > 0 else 0):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.points[j : n + j]
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts, hashes) of all runs of a size."""
        out = self.hashes(size)
        whole = self.left[: len(out)] >= size
        return self.owner[: len(out)][whole], out[whole]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(texts, hashes): the least hash of each window of WINDOW grams, where it isn't that of the window before. Every
        window of a part of a text is one of the text."""
        grams = self.hashes(GRAM)
        n = max(len(grams) - WINDOW + 1, 0)
        least = grams[:n]
        for j in range(1, WINDOW if n else 0):
            least = np.minimum(least, grams[j : n + j])
        at = np.flatnonzero(self.left[:n] >= GRAM + WINDOW - 1)
        owner, least = self.owner[at], least[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        return owner[new], least[new]


def _key_filter(keys: DataFrame):
    """Which of an array of keys (an executor's) the table's column `k` may hold: a filter of fixed size."""
    at = F.shiftrightunsigned("k", 1).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    parts = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for b, x in parts.collect():  # FILTER_BITS / 32,768 rows of 4 KB at most
        bits[(b - 1) * len(x) : b * len(x)] = np.frombuffer(x, np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(bits)

    def may(k: np.ndarray) -> np.ndarray:
        at = (k.view(np.uint64) >> np.uint64(1)) & np.uint64(FILTER_BITS - 1)
        return (held.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    return may


def _pieces_of(max_diffs: int):
    """(k, n, piece) for each mark of a needle's pieces, of a short piece for the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            parts = [piece for body in bodies for _, piece in pieces(body, max_diffs)]
            n, number = np.repeat(names, max_diffs + 1), np.tile(np.arange(max_diffs + 1), len(names))
            grams = Grams(parts)
            found = [grams.marks()]
            for size in np.unique(grams.sizes[grams.sizes < GRAM + WINDOW - 1]).tolist():
                owner, own = grams.runs(size)
                exact = grams.sizes[owner] == size
                found.append((owner[exact], own[exact]))
            owner, keys = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n[owner]), pa.array(number[owner])], ["k", "n", "piece"])

    return run


def _text_keys(lengths: list[int], may):
    """(t, k): the keys of a text that the filter lets through: its marks, and its runs of each of the short lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                names, bodies = (c.to_pylist() for c in batch.slice(at, 200).columns)
                names, grams = np.array(names, np.int64), Grams(bodies)
                for owner, keys in [grams.marks(), *(grams.runs(n) for n in lengths)]:
                    let = may(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(names[owner[let]]), pa.array(keys[let].view(np.int64))], ["t", "k"])

    return run


def _verified(max_diffs: int):
    """Of rows (t, kind, n, body), a text's needles (kind 0) before the text (kind 1, once for each text that is equal):
    (t, n) for the needles that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, needles = None, [], []
        for batch in batches:
            ts, ns = [], []
            for t, kind, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != now:
                    now, names, needles = t, [], []
                if kind == 0:
                    names.append(n), needles.append(body)
                elif names:
                    found = Finder(needles, max_diffs)(body)
                    ts += [t] * len(found)
                    ns += [names[x] for x in found]
                    names = []
            yield pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(ns, pa.int64())], ["t", "n"])

    return run


def find_many(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "text", needle_id: str = "item_id", max_diffs: int = 0) -> DataFrame:
    """What find_needles gives, for any number of needles: none is held on the driver, and no task holds more than those
    that one text may have.

    A needle with max_diffs edits leaves one of its max_diffs + 1 pieces as it is. Of a piece's marks (the least hashes of
    windows of its grams, all of them marks of a text that has the piece) the one that the fewest texts have is its key; a
    piece shorter than a window is a key as a whole. Texts that have a key are candidates of its needles and are
    searched for them, a text at a time. Only keys, and the texts that have one, are shuffled."""
    keep = [c for c in texts.columns if c != text]
    h, t = free_name(texts, "_h"), free_name(texts, "_t")
    rows = texts.withColumn(h, normalize_text(F.col(text))).where(F.col(h).isNotNull()).select(*keep, h).withColumn(t, F.xxhash64(h))
    bodies = rows.select(t, h)
    named = written_once(needles.select(F.col(needle_id).alias("_i"), normalize_text(F.col(needle)).alias("body")).where("body is not null").withColumn("n", F.xxhash64("body")), "needles")
    short = named.where(F.length("body") <= max_diffs)
    long = named.where(F.length("body") > max_diffs).select("n", "body").dropDuplicates(["n"])

    size = F.floor(F.length("body") / (max_diffs + 1))
    least = GRAM + WINDOW - 1
    shorts = long.where(size < least).select(F.explode(F.array(size, size + 1)).alias("x")).where(F.col("x") < least).distinct()
    lengths = sorted(r.x for r in shorts.collect())  # GRAM + WINDOW numbers at most
    keys = written_once(named.where(F.length("body") > max_diffs).select("n", "body").mapInArrow(_pieces_of(max_diffs), "k long, n long, piece long"), "keys")
    counts = bodies.mapInArrow(_text_keys(lengths, _key_filter(keys)), "t long, k long").groupBy("k").agg(F.count("*").alias("texts"))
    best = keys.join(counts, "k").groupBy("n", "piece").agg(F.min_by("k", F.struct("texts", "k")).alias("k"))
    best = written_once(best.select("k", "n").distinct(), "best")
    hits = bodies.mapInArrow(_text_keys(lengths, _key_filter(best)), "t long, k long").join(best, "k").select("t", "n").distinct()
    hits = written_once(hits, "hits")

    may = _key_filter(hits.select(F.col("t").alias("k")))

    @F.arrow_udf("boolean")
    def held(x: pa.Array) -> pa.Array:
        return pa.array(may(x.to_numpy(zero_copy_only=False)))

    wanted = hits.join(long, "n").select("t", F.lit(0).alias("kind"), "n", "body")
    there = rows.where(held(t))
    stream = wanted.unionByName(there.select(F.col(t).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), F.col(h).alias("body")))
    found = stream.repartition("t").sortWithinPartitions("t", "kind").mapInArrow(_verified(max_diffs), "t long, n long")
    pairs = found.join(named.select("n", F.col("_i").alias(needle_id)), "n").select(F.col("t").alias(t), needle_id)
    out = there.join(pairs, t).select(*keep, needle_id)
    # So few characters are within max_diffs edits of anything: they are in all texts (but empty ones, where edits are allowed).
    all_ = rows.where(F.length(h) > 0) if max_diffs else rows
    return out if short.isEmpty() else out.unionByName(all_.crossJoin(short.select(F.col("_i").alias(needle_id))).select(*keep, needle_id))


def find_needles(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "text", needle_id: str = "item_id", max_diffs: int = 0) -> DataFrame:
    """The columns of texts but its text, and needle_id, for every text that holds a needle (both normalised) with at
    most max_diffs edits. Null texts and needles match nothing.

    Up to PASS_NEEDLES needles of PASS_CHARS characters are one automaton (of their pieces, where edits are allowed; what a
    piece hits is then searched with edits), and the texts stream through it without a shuffle. More go through
    find_many."""
    few = needles.select(F.col(needle_id).alias("i"), normalize_text(F.col(needle)).alias("n")).where("n is not null")
    n, chars = few.agg(F.count("*"), F.coalesce(F.sum(F.length("n")), F.lit(0))).first()
    if n > PASS_NEEDLES or chars > PASS_CHARS:
        return find_many(texts, needles, text, needle, needle_id, max_diffs)
    held = [(r["i"], r["n"]) for r in few.collect()]  # PASS_NEEDLES at most
    keep = [c for c in texts.columns if c != text]
    hay = free_name(texts, "_h")
    rows = texts.withColumn(hay, normalize_text(F.col(text))).where(F.col(hay).isNotNull()).select(*keep, hay)
    id_field = T.StructField(needle_id, needles.schema[needle_id].dataType)
    out = T.StructType([*(texts.schema[c] for c in keep), id_field])
    return rows.mapInArrow(_search(held, max_diffs, out.names, to_arrow_type(id_field.dataType)), out)
