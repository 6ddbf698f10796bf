"""Packing, source divergence and the conversation trie against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import divergence, packing, registry, trie

TOKENIZER = "word_bpe_49k.json"


# 11: best-fit packing


def best_fit_decreasing(sizes, capacity):
    gaps: list[int] = []
    n = 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k < len(gaps):
            rest = gaps.pop(k) - s
        else:
            n, rest = n + 1, capacity - s
        if rest:
            bisect.insort(gaps, rest)
    return n


def whole(places, sizes, capacity):
    """The number of sequences, after it's clear that they hold all pieces once, without gaps or overflow."""
    assert sorted(r.key for r in places) == sorted(sizes)
    of = defaultdict(list)
    for r in places:
        of[r.sequence_id].append((r.offset, sizes[r.key]))
    for parts in of.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return len(of)


SHAPES = {
    "mixed": lambda r: min(100, max(1, int(r.lognormvariate(2.5, 1.2)))),
    "one size": lambda r: 34,  # two a sequence
    "a third alike": lambda r: 41 if r.random() < 0.34 else r.randint(1, 100),
    "small": lambda r: r.randint(1, 4),
    "large": lambda r: r.randint(51, 100),
    "halves": lambda r: r.choice([50, 51, 49]),
    "triplets": lambda r: r.randint(26, 40),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_plans_are_near_best_fit(spark, shape, monkeypatch):
    """Many rounds over several partitions: close to best-fit decreasing, which opens one sequence after another."""
    monkeypatch.setattr(packing, "LAST_ROWS", 60)
    monkeypatch.setattr(packing, "PART_ROWS", 300)
    rng = random.Random(shape)
    sizes = {k * 7: SHAPES[shape](rng) for k in range(1_500)}
    df = spark.createDataFrame(list(sizes.items()), "key long, length int")
    n = whole(packing.plan(df, 100).collect(), sizes, 100)
    assert n <= 1.02 * best_fit_decreasing(sizes.values(), 100) + 1


def test_plan_of_more_rows_than_a_batch(spark):
    """A partition that Arrow cuts into several batches."""
    sizes = {k: 1 + k * 37 % 90 for k in range(25_000)}
    df = spark.createDataFrame(list(sizes.items()), "key long, length int")
    n = whole(packing.plan(df, 100).collect(), sizes, 100)
    assert n <= 1.01 * best_fit_decreasing(sizes.values(), 100)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.lists(st.integers(1, 20), max_size=20))
def test_needed_is_a_lower_bound(pieces, gaps):
    """Never more new sequences than best-fit decreasing opens besides the gaps."""
    count = lambda xs: np.bincount(xs, minlength=21).astype(np.int64)
    left, n = sorted(gaps), 0
    for s in sorted(pieces, reverse=True):
        k = bisect.bisect_left(left, s)
        rest = (left.pop(k) if k < len(left) else (n := n + 1) and 20) - s
        if rest:
            bisect.insort(left, rest)
    assert packing.needed(count(pieces or [0])[:21] * (np.arange(21) > 0), count(gaps or [0])[:21] * (np.arange(21) > 0), 20) <= n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=8))
def test_successors_give_each_gap_to_whom_it_holds(counts):
    """Pieces go in full to gaps before them, none is given twice, none is left while a gap is."""
    parts, high = [], 100
    for p, (pieces, gaps) in enumerate(counts):
        parts.append((p, pieces, high - 5, gaps, high - 9))
        high -= 10
    given_, used = Counter(), Counter()
    for part, a, b, other, first, each in packing.successors(parts):
        least, largest = parts[other][4], parts[part][2]
        assert other < part and each * largest <= least and a == given_[part]
        given_[part] = b
        for r in range(a, b):
            used[other, first + (r - a) // each] += 1
    assert all(n <= max(1, parts[o][4] // 5) and g < parts[o][3] for (o, g), n in used.items())
    for p, n in given_.items():
        assert n <= parts[p][1]
    for p, (_, pieces, _, _, _) in enumerate(parts):
        if given_[p] < pieces:  # nothing before it is free
            assert all(len({g for o, g in used if o == q}) == parts[q][3] for q in range(p))


def test_packed_documents(spark, corpus, clashing, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    machine = Tokenizer.from_file(path)
    for df, capacity, spaced in ((clashing, 4096, True), (corpus, 50, False)):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = machine.encode(r.text or "", add_special_tokens=False).ids + [1]
            for k, a in enumerate(range(0, len(ids), capacity)):
                want[r.doc_id, k, a, tuple(ids[a : a + capacity])] += 1
        got = Counter()
        for s in packing.pack(df, path, 1, capacity=capacity, spaced=spaced).collect():
            ids, at = np.frombuffer(s.ids, "<u4").tolist(), 0
            assert s.length == len(ids) <= capacity
            for p in s.parts:
                assert p.offset == at
                at += p.length
                got[p.id, p.piece, p.start, tuple(ids[p.offset : at])] += 1
            assert at == len(ids)
        assert got == want
    assert packing.pack(empty, path, 1).count() == 0


def test_op11_on_a_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    machine = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for d, e in zip(docs, machine.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d.doc_id, k] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    rows = registry.QUERIES["op11_best_fit"](spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append((r.offset, r.length))
    for parts in of.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(of) <= best_fit_decreasing([w[1] for w in want.values()], 4096) + 1


# 12: source divergence


def plain_divergence(rows, least_docs, top):
    """(lang, source, part, item, value, rank) by plain loops and whole numbers of any size."""
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    words = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in t).split(" ")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for t, lang, s in rows:
        found = [w for w in words(t) if w]
        docs[lang].update(set(found))
        counts[lang, s].update(found)
        groups[lang].add(s)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in docs[lang].items() if n >= least_docs]
        of = {s: {w: counts[lang, s][w] for w in kept} for s in sources}
        of[None] = {w: sum(of[s][w] for s in sources) for w in kept}
        share = {s: {w: 1 + 10**9 * (n[w] + 1) // (sum(n.values()) + len(kept)) for w in kept} for s, n in of.items()}
        for s in sources:
            pairs = [(sum((share[s][w] - share[o][w]) ** 2 // share[o][w] for w in kept), o) for o in sources if o != s]
            terms = [((share[s][w] - share[None][w]) ** 2 // share[None][w], w) for w in kept if of[s][w] and share[s][w] > share[None][w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                for k, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.append((lang, s, part, i, v, k + 1))
    return sorted(out)


@pytest.mark.parametrize("tiles", [(8, 16), (1, 1), (2, 3)])
def test_divergence(spark, clashing, monkeypatch, tiles):
    monkeypatch.setattr(divergence, "SIDE", tiles[0])
    monkeypatch.setattr(divergence, "SPAN", tiles[1])
    monkeypatch.setattr(divergence, "LEAST_CHUNKS", 7)
    rows = [(r.text, r.lang, r.source) for r in clashing.collect()]
    for top in (200, 3):
        got = divergence.divergences(clashing, top=top).collect()
        assert sorted(map(tuple, got)) == plain_divergence(rows, 3, top)


def test_divergence_edges(spark, empty, monkeypatch):
    """Groups without words, languages that keep none, a source alone, words that aren't letters, ties, small flushes."""
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "PENDING", 4)
    assert divergence.divergences(empty).count() == 0
    rows = [("A a\x7fa É é b1c_d", "x", "s"), ("a É", "x", "t"), ("a", "x", None), (None, "x", "u"), ("", None, "s"), ("lonely", "y", "s"), ("123 ...", "z", "p"), ("z", "z", "q"), ("b b b c d", "x", "s"), ("b c", "x", "t"), ("c b d", "x", "t"), ("é" * 100_000 + " a", "x", "v"), ("d", "x", "u")]
    df = spark.createDataFrame(rows * 2, "text string, lang string, source string")
    assert sorted(map(tuple, divergence.divergences(df).collect())) == plain_divergence(rows * 2, 3, 200)


def test_shares_are_whole_numbers_of_any_size():
    for n, total, kept in ((0, 0, 1), (5, 10, 3), (2**40, 2**45, 10**6), (10**15, 8 * 10**15, 10**9)):
        assert int(divergence.shares(np.array([n]), total, kept)[0]) == 1 + 10**9 * (n + 1) // (total + kept)


# 13: conversation trie


def plain_trie(rows):
    """Rows (conv, turns) to nodes by plain loops over all prefixes."""
    members, kids = defaultdict(list), defaultdict(set)
    for conv, turns in rows:
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    full = defaultdict(list)
    for conv, turns in rows:
        full[tuple(turns)].append(conv)

    def below(node):
        mine = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        parts = [below(k) for k in kids[node]]
        return (sum(p[0] for p in parts) or 1, mine + sum(p[1] for p in parts))

    out = []
    for node, convs in members.items():
        leaves, saved = below(node)
        up = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), up, len(convs), len(kids[node]), leaves, saved, hashlib.sha256(",".join(map(str, sorted(full[node]))).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(rng, n, copies=0):
    said = [("user", "a"), ("user", "b"), ("assistant", "é" * 5), (None, None), ("", ""), ("us", "era"), ("user", "<s>")]
    out = []
    for c in range(n):
        base = [rng.choice(said) for _ in range(rng.choice([0, 1, 2, 3, 6, 12]))]
        out.append((c * 3 - 20, base))
    hot = [said[0], said[1], said[2]]
    out += [(10_000 + k, hot) for k in range(copies)] + [(20_000 + k, [*hot, ("user", str(k))]) for k in range(copies // 2)]
    rng.shuffle(out)
    return out


def as_rows(convs):
    return [(c, (None if k == 0 else k * 2), *turn) for c, turns in convs for k, turn in enumerate(turns)]


@pytest.mark.parametrize(("blocks", "copies"), [(1, 0), (3, 90), (40, 90)])
def test_trie(spark, blocks, copies):
    """Groups of copies and a common beginning that lie in many blocks, empty and null turns, nested beginnings."""
    convs = conversations(random.Random(blocks + copies), 120, copies)
    keyed = [(c, [((r or ""), (t or "")) for r, t in turns]) for c, turns in convs if turns]
    df = spark.createDataFrame(as_rows(convs), "conv_id long, turn long, role string, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(blocks))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, trie.prefix_trie(trie.turn_lists(df)).collect()), key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_trie(keyed)


def test_rebuilt_trie(spark):
    """Conversations that take the beginning of their family's first, absent, short and turnless ones included."""
    convs = conversations(random.Random(9), 150)
    df = spark.createDataFrame(as_rows(convs), "conv_id long, turn long, role string, text string")
    own = {c: [((r or ""), (t or "")) for r, t in turns] for c, turns in convs if turns}
    rebuilt = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt.append((c, own.get(c - c % 5, [])[:h] + turns[h:]))
    got = trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(df)))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rebuilt) and any(not t for _, t in rebuilt)


def test_trie_edges(spark):
    shape = "conv_id long, turn long, role string, text string, Conv string, path string, block int"
    rows = [(1, None, "u", "x", "", "", 1), (1, 0, None, None, "", "", 1), (1, 0, "a", "b", "", "", 1), (1, 0, "a", "b", "", "", 1), (None, 0, "u", "left out", "", "", 1), (2, 5, "u", "x", "", "", 1), (3, 0, "u", "y" * 1_000_000, "", "", 1)]
    df = spark.createDataFrame(rows, shape)
    want = plain_trie([(1, [("u", "x"), ("", ""), ("a", "b"), ("a", "b")]), (2, [("u", "x")]), (3, [("u", "y" * 1_000_000)])])
    assert sorted(map(tuple, trie.prefix_trie(trie.turn_lists(df)).collect()), key=repr) == want
    assert trie.prefix_trie(trie.turn_lists(df.limit(0))).count() == 0
    long = spark.range(3_000).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"), F.col("id").cast("string").alias("text"))
    nodes = trie.prefix_trie(trie.turn_lists(long)).agg(F.count("*"), F.max("depth"), F.sum("n_children"), F.max("n_leaves")).first()
    assert tuple(nodes) == (3_001, 3_000, 3_000, 1)
