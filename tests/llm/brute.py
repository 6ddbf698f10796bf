"""Plain-Python answers that the operators are held against."""

from __future__ import annotations

from collections import Counter
from fractions import Fraction


def words(text: str | None) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def shingle_set(text: str | None, width: int) -> set:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def classes(docs: list[tuple[int, str | None]], width: int, t: Fraction) -> dict[int, tuple[int, int]]:
    sets = {i: shingle_set(x, width) for i, x in docs}
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j < i)
        for j, n in shared.items():
            if n >= t * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
