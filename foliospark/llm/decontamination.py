"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces; a passage within k edits of it holds at least
one piece unchanged. An Aho-Corasick automaton finds all piece hits in one pass over a text, and Myers' bit-parallel
distance decides about each place that a hit points to."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, freed

#: Edits allowed, as a share of an item's characters.
ERROR_RATE = 0.06
#: A match of an item with fewer characters than this begins and ends at bounds of words; its budget is that of all items.
LEAST_CHARS = 30
#: Characters of items that one pass holds in each task; a larger benchmark is gone through in several passes.
PASS_CHARS = 4_000_000
#: Places that hits point to are looked at in stretches of this many characters, each once for an item.
SPAN = 64
#: Letters of scripts that put no spaces between words.
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of near equal length with their offsets."""
    n = k + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def anchored(eq: dict[str, int], m: int, text: str, ends: set[int], k: int) -> tuple[int, int] | None:
    """(distance, end) of the first best match of a pattern of m characters with at most k edits that begins where text
    begins and ends at one of `ends`."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, found = full, 0, m, None
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full | 1, mh << 1 & full  # the text's characters before the match cost too
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k and j + 1 in ends and (found is None or score < found[0]):
            found = score, j + 1
    return found


def joined(text: str, at: int) -> bool:
    """Whether the characters before and at `at` belong to one word."""
    return 0 < at < len(text) and all((c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M") and not _UNSPACED.match(c) for c in text[at - 1 : at + 1])


class Pattern:
    """Myers' bit-parallel search of one pattern: least edit distance to any substring of a text."""

    def __init__(self, pattern: str):
        self.m, self.eq = len(pattern), {}
        for i, c in enumerate(pattern):
            self.eq[c] = self.eq.get(c, 0) | 1 << i

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """(distance, end) of the first best match with at most k edits, or None."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, found = full, 0, self.m, None
        for j, c in enumerate(text):
            eq = self.eq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score <= k and (found is None or score < found[0]):
                found = score, j + 1
                if not score:
                    break
        return found


class Matcher:
    """All items of a pass: finds, in a normalised text, the best match of each item within its budget. Matches of items
    of fewer than `least_chars` characters begin and end at bounds of words."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 0):
        self.least = least_chars
        self.items = [(i, t, budget(t, rate), Pattern(t)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for x, (_, t, k, _) in enumerate(self.items):
            for at, piece in pieces(t, k):
                where.setdefault(piece, []).append((x, at + len(piece)))
        self.machine = ahocorasick.Automaton()
        for piece, to in where.items():
            self.machine.add_word(piece, to)
        if where:
            self.machine.make_automaton()

    def _words(self, x: int, text: str, at: int) -> tuple[int, int] | None:
        """The best match of item x that begins within its budget of `at` and stands between bounds of words."""
        _, item, k, pattern = self.items[x]
        found = None
        for lo in range(max(0, at - k), min(len(text), at + k + 1)):
            if joined(text, lo):
                continue
            part = text[lo : lo + len(item) + k]
            ends = {n for n in range(max(1, len(item) - k), len(part) + 1) if not joined(text, lo + n)}
            hit = anchored(pattern.eq, pattern.m, part, ends, k)
            if hit and (found is None or (hit[0], lo + hit[1]) < found):
                found = hit[0], lo + hit[1]
        return found

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) for each item found."""
        if not self.items:
            return []
        best: dict[int, tuple[int, int]] = {}
        looked: set[tuple[int, int]] = set()
        for end, to in self.machine.iter(text):
            for x, upto in to:
                if x in best and not best[x][0]:
                    continue
                _, item, k, pattern = self.items[x]
                if len(item) < self.least:
                    if (hit := self._words(x, text, end + 1 - upto)) and hit < best.get(x, (k + 1, 0)):
                        best[x] = hit
                    continue
                # Where the item begins if nothing before the piece was edited; a match begins and ends within k of that.
                part = (end + 1 - upto) // SPAN
                if (x, part) in looked:
                    continue
                looked.add((x, part))
                lo, hi = max(0, part * SPAN - k), (part + 1) * SPAN + len(item) + 2 * k
                at = text.find(item, lo, hi)
                if at >= 0:
                    best[x] = 0, at + len(item)
                elif (hit := pattern.best(text[lo:hi], k)) and (x not in best or hit[0] < best[x][0]):
                    best[x] = hit[0], lo + hit[1]
        out: dict[int | None, tuple[int, int]] = {}
        for x, hit in best.items():
            i = self.items[x][0]
            out[i] = min(out.get(i, hit), hit)
        return [(i, d, e) for i, (d, e) in sorted(out.items(), key=lambda y: (y[0] is None, y[0]))]


def _scan(items: list[tuple[int, str]], rate: float, least: int):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(items, rate, least)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in match(normal(text.as_py())):
                    for to, x in zip(out, (i, *row), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "item", "distance", "stop"])

    return run


def item_passes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[int, bool, list[tuple[int | None, str]]]]:
    """(pass, whether there are several, its items): normalised items of about PASS_CHARS characters in each pass, all
    texts of one id in the same. One pass is on the driver at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    passes = max(1, -(-chars // (PASS_CHARS // 2)))
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == p) if passes > 1 else items
        held = [(r["i"], t) for r in part.collect() if (t := normal(r["t"]))]
        yield p, passes > 1, sorted(held, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(id, item id, distance, stop) for each row of df and each item whose text it holds with at most
    int(error_rate * length) edits: the least distance, and the character of the normalised text where the first such
    match ends. Texts are lower-cased and white space runs count as one space; whole texts are searched.

    The items are gathered in passes of at most PASS_CHARS characters each, however large the benchmark is; there is
    no shuffle of documents. Null or empty texts and items match nothing; matches of items of fewer than `least_chars`
    characters begin and end at bounds of words. Items with equal ids (or null ids) are separate patterns, of which the best match is
    reported. Ties go to the first end. Repeated rows are reported as often as they occur; other columns are ignored; rows with a null id are reported with a null id."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    found, ws = [], Scratch(df.sparkSession, "items")
    for p, more, held in item_passes(benchmark, item_col, item_text_col):
        part = rows.mapInArrow(_scan(held, error_rate, least_chars), "id long, item long, distance long, stop long")
        found.append(ws.save(part, f"pass-{p}") if more else part)
    out = reduce(DataFrame.unionAll, found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "stop")


def clean_documents(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of df that hold no item: the filter runs where the rows are, without a join. A short item, even of one
    word, takes all rows that hold it between bounds of words."""
    rate, least = options.pop("error_rate", ERROR_RATE), options.pop("least_chars", LEAST_CHARS)
    item_col, item_text = options.pop("item_col", "item_id"), options.pop("item_text_col", "text")
    at = df.columns.index(text_col)

    def keep(held: list[tuple[int, str]]):
        @freed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(held, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not match(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        return run

    ws = Scratch(df.sparkSession, "clean")
    for p, more, held in item_passes(benchmark, item_col, item_text):
        df = df.mapInArrow(keep(held), df.schema)
        if more:  # a task never holds two passes' automata
            df = ws.save(df, f"pass-{p}")
            ws.drop(f"pass-{p - 1}")
    return df


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) match over all whole documents."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return contamination(read("documents"), read("benchmark"))
