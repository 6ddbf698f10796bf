"""Exact and bounded-edit matching of a test against a text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import normalize_text, squeeze


def sellers(text: str, pattern: str, k: int) -> bool:
    """Whether a substring of text, of at least one character, is within k edits of pattern: one bit-parallel pass."""
    m = len(pattern)
    if not text:
        return False
    if m <= k:
        return True
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(xh | up)) & full, up & xh
        score += 1 if plus & top else -1 if minus & top else 0
        if score <= k:
            return True
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = (minus | ~(xv | plus)) & full, plus & xv
    return False


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions and replacements that make one text the other; null if one is null."""
    return F.levenshtein(a, b)


@F.pandas_udf(T.BooleanType())
def within_edits(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, pattern, k in batches:
        yield pd.Series([None if a is None or b is None else sellers(a, b, int(n or 0)) for a, b, n in zip(text, pattern, k, strict=True)], dtype="boolean")


def exact(text: Column, needle: Column, normal: Column | None = None) -> Column:
    """Whether the normalised needle occurs in the normalised text (`normal`, where that is there already)."""
    return F.contains(normalize_text(text) if normal is None else normal, normalize_text(needle))


def in_order(text: Column, before: Column, after: Column, normal: Column | None = None) -> Column:
    """Whether both occur and the first starts strictly before the second does (first occurrences)."""
    h = normalize_text(text) if normal is None else normal
    a, b = F.position(normalize_text(before), h), F.position(normalize_text(after), h)
    return (a > 0) & (b > 0) & (a < b)


def cell_near(text: Column, cell: Column, up: Column, down: Column, left: Column, right: Column, heading: Column, normal: Column | None = None) -> Column:
    """Whether a cell occurs, what is above, left or its heading occurs no later, and what is below or right no earlier."""
    h = normalize_text(text) if normal is None else normal
    at = lambda c: F.position(normalize_text(c), h)
    c, ok = at(cell), F.lit(True)
    for x in (up, left, heading):
        ok = ok & (x.isNull() | ((at(x) > 0) & (at(x) <= c)))
    for x in (down, right):
        ok = ok & (x.isNull() | ((at(x) > 0) & (at(x) >= c)))
    return (c > 0) & ok


def formula(text: Column, latex: Column) -> Column:
    return F.contains(squeeze(text), squeeze(latex))


def fuzzy_contains(text: Column, needle: Column, k: Column, normal: Column | None = None) -> Column:
    """Whether the normalised needle occurs with at most k edits. What exact search decides (found, k of 0, an empty
    text) reaches the search with edits as nulls only."""
    h, n = normalize_text(text) if normal is None else normal, normalize_text(needle)
    open_ = ~F.contains(h, n) & (F.coalesce(k, F.lit(0)) > 0) & (F.length(h) > 0)
    return F.coalesce(within_edits(F.when(open_, h), F.when(open_, n), k), F.contains(h, n))
