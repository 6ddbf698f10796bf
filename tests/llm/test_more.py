"""Repeated rows, hot groups, clashing names and places at a text's edges, against plain versions."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import common, decontamination, grouping, licenses, lines, mixing, sharding, tokens


def pairs_by_rule(rows: list[tuple[int, list[int]]], small: int) -> tuple[set, set]:
    """Pairs of small groups and members of large ones."""
    of: dict[int, set[int]] = {}
    for v, keys in rows:
        for k in keys:
            of.setdefault(k, set()).add(v)
    pairs, members = set(), set()
    for k, vs in of.items():
        ids = {}
        for v in sorted(vs):
            ids.setdefault(v & ~1, []).append(v & 1)
        if len(ids) > small:
            members |= {(k, i) for i in ids}
        else:
            # two vertices that both came from the band below aren't paired
            pairs |= {(a, b) for a in ids for b in ids if a < b and not (ids[a] == [1] and ids[b] == [1])}
    return pairs, members


@pytest.mark.parametrize("held", [1 << 21, 40])
def test_packed_groups_are_those_of_the_rows(spark, held):
    rng = random.Random(3)
    key = lambda: rng.choice([rng.randrange(-(1 << 63), 1 << 63), 17, *range(5, 60)])
    rows = [((rng.randrange(1, 400) << 1) | (rng.random() < 0.2), sorted({key() for _ in range(rng.randint(0, 6))})) for _ in range(900)]
    ws = common.Scratch(spark, "test")
    table = ws.save(spark.createDataFrame(rows, "v long, keys array<long>"), "lists")
    got = grouping.grouped(table, 3, 1, ws, held=held).collect()
    pairs, members = pairs_by_rule(rows, 3)
    found = {(r.a, r.b) for r in got if r.key is None}
    assert {(r.key, r.a) for r in got if r.key is not None} == members
    large = {}
    for k, v in members:
        large.setdefault(k, set()).add(v)
    # Small groups give all pairs; what else is found joins two members of one large group.
    assert pairs <= found
    assert all(any({a, b} <= vs for vs in large.values()) for a, b in found - pairs)
    assert all(len({v for p in found for v in p if v in vs}) >= len(vs) - 5 for vs in large.values())


def test_filter_denies_only_what_is_not_there(spark):
    rng = random.Random(2)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)] + [0, -1, (1 << 63) - 1]
    ws = common.Scratch(spark, "test")
    held = common.MayHold(ws.save(spark.createDataFrame([(k,) for k in keys], "k long"), "keys"), "k")
    assert held(np.array(keys)).all()
    others = np.array([rng.randrange(1 << 62) for _ in range(3000)])
    assert held(others).mean() < 0.01
    df = spark.createDataFrame([(keys[0],), (None,), (int(others[0]),)], "k long")
    assert [r[0] for r in df.select(held.column("k")).collect()][:2] == [True, False]
    none = common.MayHold(ws.save(df.where("false"), "none"), "k")
    assert not none(np.array(keys)).any() and df.where(none.column("k")).count() == 0


# 2: line dedup


def test_dedup_lines_of_equal_ids_and_clashing_names(spark, corpus, clashing):
    rows = [(1, "the same opening line of both\nonly here, in the first text"), (1, "quite another line of text\nthe same opening line of both"), (2, "THE same  opening line of both\n\nlast one here"), (None, "quite another line of text\nof nobody"), (3, None), (4, ""), (5, "x\ny"), (5, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"_gone": F.lit(1), "_id": F.lit(2), "_row": F.lit(3), "AT": F.lit(4)})
    out = lines.dedup_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    # Null ids come first, then ids and line numbers.
    assert got == Counter([(1, "the same opening line of both\nonly here, in the first text"), (1, ""), (2, "\nlast one here"), (None, "quite another line of text\nof nobody"), (3, None), (4, ""), (5, "x\ny"), (5, "x\ny")])
    whole = lines.dedup_lines(clashing)
    assert whole.columns == clashing.columns and whole.count() == corpus.count()


def test_line_recall_on_the_whole_table(spark):
    """Links of all lines of 40 to 400 characters that share a shingle, by an exact search, against the classes."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 400")
    found = sorted({x for r in docs.collect() for x in lines.normal_lines(r.text or "") if len(x) >= 5})
    sets = [frozenset(x[k : k + 5] for k in range(len(x) - 4)) for x in found]
    often = Counter(g for s in sets for g in s)
    rare: dict[str, list[int]] = {}
    links = set()
    for i, s in sorted(enumerate(sets), key=lambda z: len(z[1])):
        n = len(s)
        first = sorted(s, key=lambda g: (often[g], g))[: n - -(-n * 4 // 5) + 1]  # similar sets can't all differ in these
        for j in {j for g in first for j in rare.get(g, ())}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (n + len(sets[j]) - both):
                links.add((i, j))
        for g in first:
            rare.setdefault(g, []).append(i)
    classes = {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in lines.line_classes(docs).collect()}
    where = {}
    for r in docs.collect():
        for k, x in enumerate(lines.normal_lines(r.text or "")):
            where.setdefault(x, (r.doc_id, k))
    kept = sum(classes[where[found[i]]] == classes[where[found[j]]] for i, j in links)
    assert len(links) > 30 and kept >= 0.95 * len(links)


def test_marked_sets_count_what_lines_share():
    rng = random.Random(1)
    xs, ys = (["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(30)] for _ in range(2))
    of = np.sort(np.array([rng.randrange(30) for _ in ys]))
    grams = lambda x: {x.ljust(5, "\0")[k : k + 5] for k in range(max(1, len(x) - 4))}
    n, m, both = lines.shared(xs, ys, of)
    want = [(len(grams(xs[i])), len(grams(y)), len(grams(xs[i]) & grams(y))) for i, y in zip(of, ys)]
    assert list(zip(n.tolist(), m.tolist(), both.tolist())) == want
    for text in ("a  b\n c \n\td\xa0e", "A b\n c", "x y\n\x1cz ", ""):
        assert lines.normal_lines(text) == [" ".join(x.split()) for x in text.lower().split("\n")]


# 3: decontamination


def test_equal_item_ids_report_the_best_match(spark):
    base = "it is a truth universally acknowledged that a test item must be long enough"
    bench = spark.createDataFrame([(1, base), (1, base[:-6] + "eneugh"), (None, base), (None, base.upper())], "item_id long, text string")
    docs = spark.createDataFrame([(7, "so " + base + " indeed"), (7, "so " + base + " indeed"), (None, base), (8, None), (9, "z" * 30_000 + base)], "doc_id long, text string").withColumn("item", F.lit(1))
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontamination.contamination(docs, bench).collect())
    assert got == Counter([(7, 1, 0), (7, None, 0)] * 2 + [(None, 1, 0), (None, None, 0), (9, 1, 0), (9, None, 0)])


def test_passes_hold_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_CHARS", 200)
    items = [(k, f"item number {k} of the test says that {k * 7919} is odd") for k in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items] + [(99, "nothing")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(docs, bench).where("distance = 0").collect()} == {(k, k) for k, _ in items}
    assert [r.doc_id for r in decontamination.clean_documents(docs, bench).collect()] == [99]


# 4: licences


def lcs(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("name", [k for k, v in licenses.TEMPLATES.items() if len(v.split()) >= 40])
def test_notices_that_lack_words_are_found_at_the_edges_and_inside(name):
    """Coverage at each place equals that of an unbanded search of the words around it."""
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.COVERAGE)
    w = licenses.TEMPLATES[name].split()
    pad = "word soup without any legal meaning at all".split() * 4
    for lacking in (0, 1, 3, 5):
        for cut in (w[lacking:], w[: len(w) - lacking] if lacking else w):
            for text in (cut, pad + cut, cut + pad, pad + cut + pad):
                got = [r for r in scan(" ".join(text)) if r[0] == name]
                t, x = (licenses._WORD.findall(licenses.lowered(" ".join(y))) for y in (w, text))
                want = lcs(t, x)
                if got:
                    assert max(r[2] for r in got) == want
                elif cut[: len(w) - 8] == w[: len(w) - 8]:  # the name stands in the first words
                    raise AssertionError((name, lacking, len(text)))


# 7 and 9: mixing and sharding


def test_repeated_rows_are_mixed_and_dealt_one_by_one(spark):
    rows = [(1, "four words are here", "a")] * 900 + [(k, "two words", "b") for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, shards=7).collect()
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.mix_size * len(r.mix_copies) for r in own) - own[0].mix_target) <= 2
    shards = Counter(k for r in got for k in r.mix_copies)
    assert len(shards) == 7 and max(shards.values()) - min(shards.values()) <= 1
    assert sorted(shards) == list(range(7)) and all(len(r.mix_order) == len(r.mix_copies) <= 3 for r in got)
    orders = [(k, o) for r in got for k, o in zip(r.mix_copies, r.mix_order)]
    assert len(set(orders)) == len(orders)


def test_mix_query_gives_the_trees_shards(spark):
    out = mixing.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    shards = Counter(k for r in out for k in r.shards)
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 16
    assert all(r.taken == r.size * len(r.shards) for r in out)
    by_source = Counter()
    for r in out:
        by_source[r.target, r.source_size] += r.taken
    assert all(abs(t - target) <= 0.02 * target + 200 for (target, _), t in by_source.items())


def test_shards_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 700 + [(k, "b") for k in range(300)], "doc_id long, text string")
    got = sharding.shard_rows(df, 9).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1000 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s, n in sizes.items() for k in range(n))


# 8: token ids


def test_words_have_the_ids_of_the_whole_tokenizer():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encode = tokens.Encoder(path, True, 2)
    texts = ["<|endoftext|> a", "don't CAN'T we'LL 'sup x's's", "É É İstanbul", "ﬁ ² ½ a\xadb", "a\x1cb \x85c \xa0d", "µm ªº 1a2b 3.14,5", "<|startoftext|>x <|EndOfText|>y", "a'S 'RE''", "​z 你好 ok.ok", "ß ẞ Σς ÿŸ×÷", "", " \t\n"]
    rng = random.Random(8)
    texts += ["".join(rng.choice("aB'é.,1 <|ñ\t́>Σ") for _ in range(40)) for _ in range(300)]
    assert encode([x.encode() for x in texts]) == encode._whole(texts)
    assert isinstance(encode.kept, tokens.Words) and len(encode.kept) <= tokens.KEPT
    assert tokens._borrow(path, True, 2) is tokens._borrow(path, True, 2)


def test_small_tables(spark):
    t = common.small_table(spark, [(1, None, [1, 2], [{"p": 1, "h": 2}])], "a int, b string, c array<long>, d array<struct<p:int,h:long>>")
    assert [tuple(r) for r in t.collect()] == [(1, None, [1, 2], [(1, 2)])]
    assert common.small_table(spark, [], "a int").count() == 0


def test_checkpoint_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        common.shared_folder(Session())
