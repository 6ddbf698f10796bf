"""The ten operators and the pipeline against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import chat, common, decontamination, jaccard, licenses, lines, mixing, quality, registry, sharding, tokens, toxicity

from . import brute
from .conftest import DOCS

# 1: n-gram Jaccard join


@pytest.mark.parametrize("options", [{}, {"small": 1, "big": 3}, {"small": 2, "big": 8}])
def test_jaccard_matches_brute_force(corpus, options):
    rows = [r for r in corpus.select("doc_id", "text").distinct().collect() if r[0] is not None]
    for width, t in ((4, Fraction(85, 100)), (5, Fraction(80, 100))):
        want = brute.classes([tuple(r) for r in rows], width, t)
        got = jaccard.jaccard_components(corpus.where("doc_id is not null"), width=width, threshold=t, **options).collect()
        assert len(got) == corpus.where("doc_id is not null").count()
        assert {r[0]: (r[1], r[2]) for r in got} == want


def test_jaccard_edges(spark, empty, corpus, clashing):
    assert jaccard.jaccard_components(empty).count() == 0
    got = jaccard.jaccard_components(clashing).collect()
    assert len(got) == corpus.count()
    nulls = sorted((r.n_shingles, r.component_id is None) for r in got if r.doc_id is None)
    assert [x[1] for x in nulls] == [False, True] or [x[1] for x in nulls] == [True, False]


def test_one_per_group(corpus, clashing):
    kept = jaccard.one_per_group(clashing)
    assert kept.columns == clashing.columns
    classes = {r[0]: r[2] for r in jaccard.jaccard_components(corpus, width=5, threshold=Fraction(4, 5)).collect()}
    ids = [r[0] for r in kept.select("doc_id").collect() if r[0] is not None]
    assert sorted(ids) == sorted({c for i, c in classes.items() if i is not None})


def test_one_per_group_with_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    near = lambda t: t + " and more"
    # 7 has a near copy of 1's text, a text of its own and the first of a group; 9 has two near copies; 12 comes twice.
    rows = [(1, a), (7, near(a)), (7, b), (7, c), (8, near(c)), (9, d), (9, near(d)), (12, "one two"), (12, "one two"), (12, ""), (12, ""), (None, a)]
    kept = jaccard.one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    nine = {t for i, t in got if i == 9}
    assert len(nine) == 1 and nine <= {d, near(d)}
    assert got == Counter([(1, a), (7, b), (7, c), (9, *nine), (12, "one two"), (12, ""), (None, a)])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=6, max_size=60), st.integers(0, 6), st.integers(0, 6))
def test_similar_sets_share_a_segment(base, drop, add):
    t = Fraction(85, 100)
    a = set(base)
    b = set(sorted(a)[drop:]) | {(x * 7919 + 13) % 2**64 for x in sorted(a)[:add]}
    if not b or Fraction(len(a & b), len(a | b)) < t:
        return
    bands = jaccard.Bands(t)
    keys = lambda s: {(k, int(x)) for k in bands.of(len(s)) for x in jaccard.segment_keys(np.array(sorted(s), np.uint64), *bands.segments(k), k)}
    assert keys(a) & keys(b)
    sketch = lambda s: jaccard.bit_sketch(np.array(sorted(s), np.uint64))
    assert jaccard.hamming(sketch(a), sketch(b)) <= len(a ^ b)


# 2: line dedup


def line_brute(rows: list[tuple[int, str | None]], t: Fraction):
    found = [(i, k, " ".join(x.lower().split())) for i, text in sorted(set(rows)) for k, x in enumerate((text or "").split("\n")) if x.split()]
    grams = {x: {x[j : j + 5] for j in range(max(1, len(x) - 4))} for _, _, x in found}
    names = sorted(grams)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            u, v = grams[names[a]], grams[names[b]]
            both = len(u & v)
            if both >= t * (len(u) + len(v) - both):
                root[find(names[a])] = find(names[b])
    first: dict = {}
    for i, k, x in found:
        first.setdefault(find(x), (i, k))
    return {(i, k): first[find(x)] for i, k, x in found}


@pytest.mark.parametrize("k", [2, 5, 22])
def test_bands_find_lines_at_the_threshold(k):
    # Of 9 k shingles each, 8 k are common: a similarity of exactly 0.8.
    rng = random.Random(k)
    pairs = [(s[: 9 * k + 4], s[k:]) for s in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(10 * k + 4)) for _ in range(500))]
    grams = lambda x: {x[i : i + lines.CHARS] for i in range(len(x) - lines.CHARS + 1)}
    pairs = [(a, b) for a, b in pairs if 10 * len(grams(a) & grams(b)) == 8 * len(grams(a) | grams(b))]
    shared = (lines.band_keys([a for a, _ in pairs]) == lines.band_keys([b for _, b in pairs])).any(1)
    assert len(pairs) > 400 and shared.mean() >= 0.98


def test_line_classes(spark, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    bases = [" ".join(word() for _ in range(12)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(bases) if rng.random() < 0.5 else " ".join(word() for _ in range(8)) for _ in range(5)]
        parts = [p.replace(p[5:7], "zz", 1) if rng.random() < 0.5 else p.upper() for p in parts]
        rows.append((i, "\n".join([*parts, "", "  ", "ab"]), "en", "s", 1))
    rows += [rows[0], (98, None, None, None, None), (99, "", "", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    want = line_brute([r[:2] for r in rows], lines.THRESHOLD)
    for small in (1, 4):
        got = lines.line_classes(df, small=small).collect()
        assert {(r.doc_id, r.line_no): (r.class_id, r.class_line) for r in got} == want
        assert all(r.kept == ((r.doc_id, r.line_no) == (r.class_id, r.class_line)) for r in got)
    assert lines.line_classes(empty).count() == 0
    out = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    for i, text, *_ in rows:
        if text:
            assert out[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want or want[i, k] == (i, k))


# 3: decontamination


def distance(p: str, t: str) -> int:
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for c in t:
        cur = [0]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        best = min(best, prev[-1])
    return best


def whole_distance(p: str, t: str) -> int:
    prev = list(range(len(p) + 1))
    for j, c in enumerate(t, 1):
        cur = [j]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
    return prev[-1]


def test_matcher_finds_all_within_budget():
    rng = random.Random(3)
    for _ in range(60):
        items = [(i, decontamination.normal("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 70))))) for i in range(3)]
        text = "".join(rng.choice("abcdefgh ") for _ in range(90))
        for _ in range(2):
            s = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 10)):
                k, o = rng.randrange(len(s)), rng.random()
                s[k : k + (o < 0.6)] = [] if o < 0.3 else [rng.choice("abcdefgh ")]
            text += "".join(s) + "".join(rng.choice("abcdefgh ") for _ in range(40))
        text = decontamination.normal(text)
        got = {i: d for i, d, _ in decontamination.Matcher(items, 0.12)(text)}
        assert got == {i: d for i, x in items if (d := distance(x, text)) <= decontamination.budget(x, 0.12)}


def test_contamination_on_tables(spark, sf, empty, clashing):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contamination(docs, bench).collect()}
    items = [(r.item_id, decontamination.normal(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, i) for r in docs.collect() for i, x in items if x in decontamination.normal(r.text)}
    assert exact == {k for k, d in got.items() if d == 0} and exact
    clean = decontamination.clean_documents(docs, bench)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {d for d, _ in got}
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.clean_documents(clashing.drop("extra"), bench).columns == clashing.drop("extra").columns
    none = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "item_id long, text string")
    assert decontamination.contamination(docs, none).count() == 0


def test_short_items_have_their_budget_between_word_bounds():
    rng = random.Random(13)
    found = 0
    for _ in range(150):
        items = [(i, x) for i in range(3) if (x := decontamination.normal("".join(rng.choice("abcd, ") for _ in range(rng.randint(9, 29)))))]
        text = "".join(rng.choice("abcd, ") for _ in range(20))
        for _ in range(3):
            s = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                k, o = rng.randrange(len(s)), rng.random()
                s[k : k + (o < 0.6)] = [] if o < 0.3 and len(s) > 1 else [rng.choice("abcd, ")]
            text += rng.choice(["", " "]) + "".join(s) + rng.choice(["", " "]) + "".join(rng.choice("abcd, ") for _ in range(10))
        text = decontamination.normal(text)
        cuts = [x for x in range(len(text) + 1) if not decontamination.joined(text, x)]
        want = {}
        for i, x in items:
            k = decontamination.budget(x, 0.12)
            some = [(whole_distance(x, text[a:b]), b) for a in cuts for b in cuts if a < b and abs(b - a - len(x)) <= k]
            if some and min(some)[0] <= k:
                want[i] = min(some)[0]
        got = decontamination.Matcher(items, 0.12, 30)(text)
        assert {i: d for i, d, _ in got} == want
        for i, d, e in got:
            assert any(whole_distance(dict(items)[i], text[a:e]) == d for a in cuts if a < e) and e in cuts
        found += sum(d > 0 for d in want.values())
    assert found > 20
    match = decontamination.Matcher([(1, "the quick brown fox jumps ov")], 0.06, 30)
    assert match("see the quick brown fax jumps ov here") == [(1, 1, 32)]
    assert match("the quick brown fax jumps over") == [] and match("") == []


def test_short_items_match_exactly_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is  Entropy?"), (2, "cat"), (3, "\u718a\u732b\u5403\u4ec0\u4e48"), (4, " "), (5, "is sand, or")], "item_id long, text string")
    rows = [(1, "Q: what is entropy? A: none"), (2, "what is entropy, then"), (3, "concatenate cats"), (4, "A CAT."), (5, "\u4f60\u77e5\u9053\u718a\u732b\u5403\u4ec0\u4e48\u5417"), (6, "his sand, or this"), (7, "cats, or cat"), (8, "what is entropx?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.stop) for r in decontamination.contamination(docs, bench).collect())
    assert got == [(1, 1, 0, 19), (4, 2, 0, 5), (5, 3, 0, 8), (7, 2, 0, 12)]
    assert sorted(r.doc_id for r in decontamination.clean_documents(docs, bench).collect()) == [2, 3, 6, 8]


# 4: licences


def test_license_scan(spark, empty):
    mit = licenses.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "at no cost").replace("copyright notice", "notice of rights").lower()
    rows = [(1, "x " * 50 + mit + " y" * 50), (2, edited), (3, "All rights reserved. nothing else. ALL RIGHTS, reserved!"), (4, None), (5, ""), (6, "rights all reserved " * 30), (7, mit[: len(mit) // 2]), (7, "Licensed under CC BY-NC 4.0.")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r.doc_id, r.license): r for r in got}
    text = rows[0][1]
    assert by[1, "mit"].coverage == 1 and text[by[1, "mit"].start : by[1, "mit"].stop].startswith("Permission") and text[: by[1, "mit"].stop].endswith("SOFTWARE")
    assert 0.9 < by[2, "mit"].coverage < 1
    assert [(r.start, r.stop) for r in sorted(got, key=lambda r: r.start) if r.doc_id == 3] == [(0, 19), (35, 55)]
    assert not [r for r in got if r.doc_id in (4, 5)] and (7, "mit") not in by and (7, "cc-by-nc-4.0-line") in by
    assert licenses.scan_licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Released under the BSD License.", set()),
        ("Released under the MIT-0 License.", set()),
        ("Released under the BSD License. MIT License follows.", set()),
        ("This work is licensed under the GNU General Public License, version 2.", set()),
        ("This work is licensed under the GNU General Public License, version 3.1.", set()),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", set()),
        ("This work is licensed under the GNU Affero General Public License, version 3.", set()),
        ("Licensed under the Apache License, Version 1.0.", set()),
        ("Licensed under the Apache License, Version 2.0.1.", set()),
        ("Licensed under CC BY-NC 3.0.", set()),
        ("Licensed under CC BY-NC-SA 4.0.", set()),
        ("Some rights reserved. All other rights reserved.", set()),
        (licenses.TEMPLATES["gpl-3.0"].replace("GNU General", "GNU Lesser General"), set()),
        (licenses.TEMPLATES["gpl-3.0"].replace("version 3", "version 2"), set()),
        (licenses.TEMPLATES["apache-2.0"].replace("2.0", "1.1"), set()),
        (re.sub("subject to.*Software[.] THE", "THE", licenses.TEMPLATES["mit"]), set()),
        ("Released under the MIT Licence.", {"mit-line"}),
        ("It is under the MIT License", {"mit-line"}),
        ("This work is licensed under the GNU General Public License v3.", {"gpl-3.0-line"}),
        ("This whole work is hereby licensed under the GNU General Public License, version 3. 1. Begin", {"gpl-3.0-line"}),
        ("Licensed under the Apache License 2.0", {"apache-2.0-line"}),
        ("Licensed under CC-BY-NC-4.0", {"cc-by-nc-4.0-line"}),
        *((t, {k}) for k, t in licenses.TEMPLATES.items()),
    ],
)
def test_look_alike_licenses(text, names):
    ours = ("apache-2.0-line", "mit-line", "gpl-3.0-line", "cc-by-nc-4.0-line", "all-rights-reserved", "mit", "apache-2.0", "gpl-3.0", "bsd-2-clause", "mpl-2.0")
    got = {x[0] for x in licenses.Scanner({k: licenses.TEMPLATES[k] for k in ours}, licenses.COVERAGE)(text)}
    assert got - ({"apache-2.0-line"} if "apache-2.0" in names else set()) == names & set(ours)


def test_short_templates_of_others_stand_whole():
    scan = licenses.Scanner({"acme": "Covered by the Acme Terms, edition 2.1"}, licenses.COVERAGE)
    assert [x[3:] for x in scan("Covered by the ACME terms, edition 2.1.")] == [(0, 38)]
    assert not scan("Covered by the Acme terms, edition 2.1.7") and not scan("Covered by the other Acme terms, edition 2.1") and not scan("Covered by the Acme terms, edition 3.1")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), min_size=1, max_size=12), st.lists(st.sampled_from("abcd"), max_size=20))
def test_alignment_is_no_more_than_the_longest_common_subsequence(t, w):
    table = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
    for i, x in enumerate(t):
        for j, y in enumerate(w):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    m, a, b = licenses.align(t, w, 40)
    assert m <= table[-1][-1] and (not m or (w[a] in t and w[b - 1] in t))


# 5: quality


def measured(text: str | None) -> tuple[int, int, int, int, int]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    seen: list[str] = []
    dup = 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.append(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_base(spark, corpus, sf):
    rows = [(i, t) for i, t in enumerate(["a b c a b c a", "a a a a", "x\n\nx\n x\nx", "é é é\té ## é é", None, "", "\n \n", "a\x0bb\x0cc\x1cd \x85"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s"))
    docs = docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 100))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality(docs).collect():
        want = measured(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.kept and r.base_failed)
    assert quality.quality(corpus).count() == corpus.count()


@pytest.mark.parametrize("size", [5, 24, 60, 99, 100, 140])
def test_quality_groups_lean_on_their_language_the_less_the_larger_they_are(spark, size):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' and text is not null").orderBy("doc_id").collect()]
    texts = [t for t in texts if (m := measured(t))[0] >= 50 and 10 * m[4] < m[0]][:150]
    rows = [(i, t, "en", "plain") for i, t in enumerate(texts)]
    rows += [(1000 + i, re.sub(r"(\S)(?=\s|$)", r"\1#", texts[i % len(texts)]), "en", "own") for i in range(size)]
    got = [r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.doc_id >= 1000]
    assert len(texts) > 110 and not any(r.base_failed for r in got)
    if size < quality.PRIOR_ROWS / 2:  # most rows of the blend are the language's, which have few symbols
        assert all("symbol_ratio high" in r.failed_rules for r in got)
    elif size > quality.PRIOR_ROWS:
        assert sum("symbol_ratio high" in r.failed_rules for r in got) < 20 and sum(r.kept for r in got) > size / 2  # the texts hold some junk


def test_quality_blend_against_weighted_quantiles(spark):
    """Each group's quantiles equal those of its rows, its language's and all, weighed as documented."""
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([0.0, 0.5, 1.0, 2.0, 4.0]) * rng.choice([1.0, 1.0, 3.0])) for _ in range(400)] + [("xx", "only", 7.0)]
    fine = quality.sketches(spark.createDataFrame(rows, "lang string, source string, x double"), ["lang", "source"], ("x",))
    got = {(r["lang"], r["source"]): r for r in quality.quantiles(quality.blended(fine), ["lang", "source"], {"q10": 0.1, "q50": 0.5, "q90": 0.9}).collect()}
    assert set(got) == {r[:2] for r in rows}
    end = lambda x: 0.0 if x < quality.LEAST else quality.GAMMA ** (math.floor(math.log(x) / math.log(quality.GAMMA)) + 1)
    for (lang, source), r in got.items():
        of_lang = [y[2] for y in rows if y[0] == lang]
        weight = Counter()
        for y in rows:
            weight[end(y[2])] += Fraction(25 * 25, (len(of_lang) + 25) * len(rows))
            weight[end(y[2])] += Fraction(25, len(of_lang) + 25) if y[0] == lang else 0
            weight[end(y[2])] += y[:2] == (lang, source)
        for k, q in (("q10", Fraction(1, 10)), ("q50", Fraction(1, 2)), ("q90", Fraction(9, 10))):
            upto, total = 0, sum(weight.values())
            want = next(x for x in sorted(weight) if (upto := upto + weight[x]) >= q * total)
            assert abs(r[k] - want) < 1e-9 * max(1, want)


def test_quality_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.quality(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if not got[r.doc_id].base_failed:
            assert got[r.doc_id].kept == (r.quality == 1)


def test_sketches_merge(spark, empty):
    values = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") / 7 + 0.001).alias("x"))
    one = quality.sketches(values, ["g"], ("x",)).groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    two = quality.sketches(values, [], ("x",))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    got = quality.quantiles(two, [], {"q": 0.5}).first()
    assert abs(got.q - 500 / 7) < 0.03 * 500 / 7
    assert quality.quality(empty).count() == 0


# 6: chats


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<sep>", "\\", "<", "[", "ok", "\n", "é", "😀", "", "$1", "\\1"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", "", "x[/INST]"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(50, 0, None, None), (50, 0, "assistant", None), (None, 1, "user", "u"), (51, 1, "assistant", "b"), (51, 1, "assistant", "a"), (51, None, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), "loss").collect()}
    want: dict = {}
    for c, t, r, x in sorted(rows, key=lambda x: (x[0] is None, x[0], x[1] is not None, x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    for c, r in got.items():
        assert r.learned == "".join(x for role, x in want[c] if role == "assistant")
        assert r.formatted.count("<s>") == r.formatted.count("</s>") == 1 + sum(a[0] != b[0] for a, b in zip(want[c], want[c][1:]))
    assert chat.format_chats(df.where("false")).count() == 0


# 7: mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == [30.0, 1320.0, 660.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]
    for sizes in ([1, 2, 3, 400], [5, 5, 5000]):
        got = mixing.targets(sizes, [5, 2, 1, 5][: len(sizes)])
        assert abs(sum(got) - sum(sizes)) < 1e-6 and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes))


def test_mix(spark, corpus, empty, clashing):
    got = mixing.mix_sources(clashing, shards=5).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_copies").collect()
    assert len(got) == corpus.count()
    totals: Counter = Counter()
    shards: Counter = Counter()
    for r in got:
        totals[r.source] += r.mix_size * len(r.mix_copies)
        shards.update(r.mix_copies)
        assert len(r.mix_copies) <= 3
    names = sorted({r.source for r in got}, key=lambda x: (x is None, x or ""))
    sizes = [sum(r.mix_size for r in got if r.source == n) for n in names]
    want = mixing.targets(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    for n, t in zip(names, want):
        rows = [r for r in got if r.source == n]
        assert abs(rows[0].mix_target - t) < 1e-6 and rows[0].mix_source_size == sizes[names.index(n)]
        assert abs(totals[n] - t) <= max(20, max((r.mix_size for r in rows), default=0) / 2)
    assert max(shards.values()) - min(shards.values()) <= 1
    again = mixing.mix_sources(clashing.repartition(7), shards=5).select("doc_id", "mix_copies").collect()
    key = lambda rows: sorted((str(r.doc_id), tuple(r.mix_copies)) for r in rows)
    assert key(again) == key(got)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0
    mixed = mixing.mixed_rows(clashing, shards=5)
    assert mixed.columns == clashing.columns and mixed.count() == sum(shards.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 7), st.integers(0, 99))
def test_splitting_tree_is_exact(counts, shards, seed):
    n = sum(counts)
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    tree = mixing.splitting_tree(random.Random(seed), counts, sizes)
    assert [sum(x) for x in tree] == sizes and [sum(x) for x in zip(*tree)] == counts and min(map(min, tree)) >= 0


def test_hypergeometric_draws():
    rng = random.Random(1)
    got = Counter(common.hypergeometric(rng, 20, 8, 6) for _ in range(20_000))
    from math import comb

    for k in range(7):
        p = comb(8, k) * comb(12, 6 - k) / comb(20, 6)
        assert abs(got[k] / 20_000 - p) < 0.015
    assert common.hypergeometric(rng, 10, 10, 4) == 4 and common.hypergeometric(rng, 10, 0, 4) == 0


# 8: token ids


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for width, bits in ((2, False), (2, True), (4, False), (4, True)):
        parts = [rng.integers(0, 2 ** (8 * width) - 1, n).astype(f"<u{width}") for n in (0, 1, 5, 20_000, 16_384, 3)]
        keys, back = tokens.unpack(tokens.pack([1, None, 3, 4, 5, -6], parts, width, bits))
        assert keys == [1, None, 3, 4, 5, -6] and all((a == b).all() for a, b in zip(parts, back, strict=True))


def test_token_files(spark, corpus, empty, clashing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    tricky = ["H̱ é.", "<|endoftext|>, a.b,c. X,", " 　\x1c x\x85y", "ΑΣ ς İ 한국", "it's don't 12,3. é,"]
    rows = clashing.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(tricky)], "doc_id long, text string"))
    got = tokens.read_documents(tokens.encode_chunks(rows, path, end=2, spaced=True)).collect()
    assert len(got) == rows.count()
    want = Counter()
    for r in rows.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x))
    assert tokens.read_documents(tokens.encode_chunks(empty, path, end=2)).count() == 0


# 9: sharding


def test_shards(spark, corpus, empty, clashing):
    got = sharding.shard_rows(clashing, 7)
    assert [c.lower() for c in got.columns][-2:] == ["shard", "slot"] and got.count() == corpus.count()
    by: dict = {}
    for r in got.select("doc_id", "shard", "slot").collect():
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(v) for v in by.values()]
    assert len(by) == 7 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda df: sorted((str(r.doc_id), r.shard, r.slot) for r in df.select("doc_id", "shard", "slot").collect())
    assert key(got) == key(sharding.shard_rows(clashing.repartition(5), 7))
    assert sharding.shard_rows(empty, 7).count() == 0
    copies = spark.range(2000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text"))
    counts = [r[1] for r in sharding.shard_rows(copies, 24).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) - min(counts) <= 1


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(1, 6), st.integers(0, 99))
def test_communication_matrix_is_exact(blocks, shards, seed):
    n = sum(blocks)
    cells = [n // shards + (k < n % shards) for k in range(shards)]
    m = sharding.communication_matrix(blocks, cells, seed)
    assert [sum(r) for r in m] == blocks and [sum(c) for c in zip(*m)] == cells


def test_shuffle_is_uniform(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"))
    got = sharding.shard_rows(rows, 4).withColumn("quarter", F.floor(F.col("doc_id") / 1500)).groupBy("quarter", "shard").count().collect()
    assert sum((r["count"] - 375) ** 2 / 375 for r in got) < 35


# 10: toxicity


def sums(g, text: str) -> list[float]:
    return [round(float(np.expm1(x)), 6) for x in g.features(text)[:5]]


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 3.0, "scum*": 2.0})
    assert sums(g, "you are an idiot") == [3, 0, 0, 3, 0]
    assert sums(g, "An idiot. You are here.") == [3, 0, 0, 0, 0]
    assert sums(g, "he is not an idiot") == [0, 3, 0, 3, 0]
    assert sums(g, "not one of all these an idiot") == [3, 0, 0, 0, 0]
    assert sums(g, "not here. an idiot") == [3, 0, 0, 0, 0]
    assert sums(g, "mary said idiot") == [0, 0, 3, 0, 0]
    assert sums(g, "“idiot” scummy") == [2, 0, 3, 0, 0]
    assert sums(g, "“Go away. You idiot.” Scummy") == [2, 0, 3, 3, 0]  # a quotation goes on over sentences
    assert sums(g, "“an open mark\nidiot") == [3, 0, 0, 0, 0]
    assert sums(g, "kill you")[4] == 1 and sums(g, "kill time")[4] == 0 and sums(g, "never kill you")[4] == 0
    assert g.symbol("scummiest")[1] == 2 and g.symbol("scum")[1] == 0
    assert g.score("You idiot. You idiot!") > g.score("He said idiot.") > g.score("A fine day") and 0 <= g.score(None) <= 1 and g.score("") < 0.5


def by_rule(symbols: list[str]) -> list[str]:
    """What the five transducers say together, written as one rule for each place."""
    out = []
    for at, x in enumerate(symbols):
        clause = max((k + 1 for k in range(at) if symbols[k] in ("stop", "line")), default=0)
        line = max((k + 1 for k in range(at) if symbols[k] == "line"), default=0)
        last = max((k for k in range(clause, at) if symbols[k] == "not"), default=None)
        denied = last is not None and sum(y != "quote" for y in symbols[last + 1 : at]) < toxicity.NEGATION_SCOPE
        told = symbols[line:at].count("quote") % 2 == 1 or "says" in symbols[clause:at]
        if x == "insult":
            out.append("reported" if told else "negated" if denied else "asserted")
        elif x == "danger":
            out.append("other" if told or denied else "threat")
        elif x in ("stop", "line"):
            out.append("aimed" if "whom" in symbols[clause:at] else "unaimed")
        else:
            out.append("other")
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=25))
def test_composed_transducers_follow_the_rules(symbols):
    to, out, state = toxicity.compiled()
    got = []
    for x in symbols:
        k = toxicity.SYMBOLS.index(x)
        got.append(toxicity.OUT[out[state][k]])
        state = to[state][k]
    assert got == by_rule(symbols)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op10_toxicity(spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = sum(r.predicted for r in rows if r.toxic) / sum(r.toxic for r in rows)
    assert right > 0.97 and found > 0.85
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got.limit(500).collect())


def test_toxicity_edges(spark, corpus, empty, clashing):
    labels = spark.createDataFrame([(0, None, 1), (1, 1, None), (None, 1, 1), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    g = toxicity.learn(corpus, labels)
    out = toxicity.score_toxicity(clashing.drop("extra"), g)
    assert out.count() == corpus.count() and out.where("toxicity is null").count() == 0
    assert toxicity.learn(empty, labels.where("false")).patterns == {}
    assert toxicity.remove_toxic(clashing.drop("extra"), labels.where("false")).columns == clashing.drop("extra").columns


# All of it


def test_pipeline_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    ws = common.Scratch(spark, "test")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = ws.save(stage(spark, docs, sf), name)
        before, after = ({r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in (docs, out))
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        if k < 4:
            assert out.columns == columns
        if name == "ngram_jaccard":
            classes = brute.classes(list(before.items()), 5, Fraction(4, 5))
            assert set(after) == {c for _, c in classes.values()}
        if name == "decontamination":
            items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert not any(x in decontamination.normal(t) for t in after.values() for x in items)
        if name == "sharding":
            assert out.count() == docs.count()
        docs = out
    run = corpus_pipeline.run(spark, sf).groupBy("doc_id", "shard", "slot").count().collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, docs.groupBy("doc_id", "shard", "slot").count().collect()))


def test_registry_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, sf, name):
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = c.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert sorted(tuple(r[x] for x in cols) for r in df.collect()) == sorted(tuple(r[names.index(x)] for x in cols) for r in got.fetchall())


def test_map_columns_pass_through(spark, clashing, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontamination.clean_documents(clashing, bench).schema == clashing.schema
    assert toxicity.score_toxicity(clashing, toxicity.Grammar({})).select("extra").first().extra == {"k": 1}
