"""How far the sources of a language are from each other in their words.

Words are counted in the tasks that read the texts; counts meet by vocabulary chunk, where each (language, source) group
gets a packed vector of its counts. A language's groups are cut into blocks of SIDE; vectors are replicated to the tiles
(block by block, by span of chunks) and each tile sums its pairs over its chunks, one chunk at a time. A pair's value
where neither group has a word is the same for all such words, so a tile adds only what the chunk's words change."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Parts of one: shares are whole numbers of them.
UNIT = 10**9
#: A language keeps the words of so many of its documents at least.
LEAST_DOCS = 3
#: Words that a group reports at most.
TOP = 200
#: Groups of a block, chunks of a span.
SIDE, SPAN = 8, 16
#: Documents for each vocabulary chunk, and the least and most chunks: how finely work is cut, not what is counted.
CHUNK_DOCS, LEAST_CHUNKS, MOST_CHUNKS = 2_000, 64, 65_536
#: Words that a task holds before it hands its counts on; rows of a batch.
HELD, ROWS = 300_000, 20_000
#: Bytes of a text as bytes of words: A-Z lower-cased, white space for all below U+0080 but letters.
_WORD = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, and of characters from U+0080 on."""
    return text.translate(_WORD).split()


def _counted(most: int):
    """(lang, source, term, n, docs): the counts of a task, in parts where it holds more than `most` words."""

    def out(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for at in range(0, len(terms), ROWS):
                some = terms[at : at + ROWS]
                k = len(some)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.repeat(source, k), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        groups.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                found = words(text.as_py())
                if found:
                    n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                    held -= len(n)
                    n.update(found)
                    docs.update(set(found))
                    held += len(n)
                    if held > most:
                        yield from out(groups)
                        held = 0
        yield from out(groups)

    return run


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(UNIT (count + 1) / (total + kept)), by long division, three digits at a time (totals below 9 * 10^15)."""
    whole, left = np.divmod(counts.astype(np.int64) + 1, total + kept)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, total + kept)
        whole = whole * 1000 + digits
    return whole + 1


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return t.rename_columns([c.removesuffix("_sum") for c in t.column_names]).select(["lang", "source", "term", "n", "docs"])


#: Rows of counts that a task of vectors holds before it adds them up.
PENDING = 1_000_000
VECTOR = "chunk int, lang string, source string, kept long, total long, places binary, counts binary"


def _vectors(least_docs: int, pending: int):
    """Of rows (chunk, lang, source, term, n, docs) in the order of chunks: for each language and chunk with kept words,
    a row without source (places: the words, in UTF-8 order, joined by line ends; counts: the language's) and a row for
    each source that has some (places: which, counts: how often)."""

    def chunk_rows(chunk: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for lang in pc.unique(t["lang"]).to_pylist():
            own = t.filter(pc.equal(t["lang"], lang)).combine_chunks()
            terms = own["term"].cast(pa.binary()).dictionary_encode().combine_chunks()
            names, codes = terms.dictionary, terms.indices.to_numpy()
            n, docs = own["n"].to_numpy(), own["docs"].to_numpy()
            inside = np.zeros(len(names), np.int64)
            np.add.at(inside, codes, docs)
            order = pc.sort_indices(names).to_numpy()
            order = order[inside[order] >= least_docs]
            if not len(order):
                continue
            place = np.full(len(names), -1, np.int64)
            place[order] = np.arange(len(order))
            at = place[codes]
            own, at, n = own.select(["source"]).filter(pa.array(at >= 0)), at[at >= 0], n[at >= 0]
            all_ = np.zeros(len(order), np.int64)
            np.add.at(all_, at, n)
            rows = [(None, len(order), int(all_.sum()), b"\n".join(names.take(pa.array(order)).to_pylist()), all_.astype("<i8").tobytes())]
            sources = own["source"].combine_chunks().dictionary_encode()
            which = sources.indices.to_numpy()
            for k, source in enumerate(sources.dictionary.to_pylist()):
                mine = np.flatnonzero(which == k)
                mine = mine[np.argsort(at[mine])]
                rows.append((source, len(order), int(n[mine].sum()), at[mine].astype("<u4").tobytes(), n[mine].astype("<i8").tobytes()))
            cols = list(zip(*rows, strict=True))
            packed = [pa.array([press.compress(x) for x in c], pa.binary()) for c in cols[3:]]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(chunk, pa.int32()), len(rows)), pa.repeat(lang, len(rows)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), *packed], ["chunk", "lang", "source", "kept", "total", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, [], 0
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1), len(chunks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if chunks[a] != now:
                    if held:
                        yield from chunk_rows(int(now), _added(held))
                    now, held, rows = chunks[a], [], 0
                part = batch.slice(a, b - a)
                held.append(pa.Table.from_arrays(part.columns[1:], part.schema.names[1:]))
                rows += b - a
                if rows > pending:
                    held = [_added(held)]
                    rows = min(held[0].num_rows, pending // 2)
        if held:
            yield from chunk_rows(int(now), _added(held))

    return run


def _dense(places: bytes, counts: bytes, size: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    out = np.zeros(size, np.int64)
    out[np.frombuffer(open_.decompress(places), "<u4")] = np.frombuffer(open_.decompress(counts), "<i8")
    return out


TILE = "lang string, i int, j int, span int, chunk int, slot int, source string, kept long, total long, size long, places binary, counts binary"
PAIR = "lang string, source string, item string, value long"


class Tile:
    """The pairs of two blocks of groups of a language over a span of chunks."""

    def __init__(self, side: int, lang: str, i: int, j: int, span: int):
        self.side, self.lang, self.i, self.j, self.first = side, lang, i, j, span == 0
        self.groups: dict[int, tuple[str, int, int]] = {}
        self.none: dict[int, int] = {}
        self.chunk, self.size, self.got = -1, 0, {}
        self.sums: dict[tuple[int, int], int] = {}

    def group(self, slot: int, source: str, kept: int, total: int) -> None:
        """A group of the tile, told of before any of its vectors."""
        self.groups[slot] = source, kept, total
        self.none[slot] = int(shares(np.zeros(1, np.int64), total, kept)[0]) if kept else 1

    def vector(self, chunk: int, slot: int, size: int, places: bytes, counts: bytes) -> None:
        if chunk != self.chunk:
            self.add_up()
            self.chunk, self.size = chunk, size
        self.got[slot] = _dense(places, counts, size)

    def alike(self, a: int, b: int) -> int:
        """The value of a word that neither group has."""
        return (self.none[a] - self.none[b]) ** 2 // self.none[b]

    def partners(self) -> Iterator[tuple[int, list[int]]]:
        slots = sorted(self.groups)
        for a in slots:
            if a // self.side == self.i and (others := [b for b in slots if b // self.side == self.j and b > a]):
                yield a, others

    def add_up(self) -> None:
        """Adds what the chunk's words have, less what each would have if neither group had it."""
        if not self.got:
            return
        nothing = np.zeros(self.size, np.int64)
        matrix = {s: shares(self.got.get(s, nothing), total, kept) for s, (_, kept, total) in self.groups.items()}
        for a, others in self.partners():
            p, q = matrix[a], np.stack([matrix[b] for b in others])
            d = (p - q) ** 2
            for b, x, y in zip(others, (d // q).sum(axis=1).tolist(), (d // p).sum(axis=1).tolist(), strict=True):
                self.sums[a, b] = self.sums.get((a, b), 0) + x - self.size * self.alike(a, b)
                self.sums[b, a] = self.sums.get((b, a), 0) + y - self.size * self.alike(b, a)
        self.got = {}

    def given(self) -> pa.RecordBatch:
        self.add_up()
        rows = []
        for a, others in self.partners():
            for x, y in [(a, b) for b in others] + [(b, a) for b in others]:
                all_ = self.groups[x][1] * self.alike(x, y) if self.first else 0
                rows.append((self.lang, self.groups[x][0], self.groups[y][0], self.sums.get((x, y), 0) + all_))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, [pa.string()] * 3 + [pa.int64()], strict=True)], ["lang", "source", "item", "value"])


def _tiles(side: int):
    """Of rows of TILE, a tile's together, its groups (chunk -1) before its vectors in the order of chunks: its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            for *at, chunk, slot, source, kept, total, size, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if tile:
                        yield tile.given()
                    key, tile = at, Tile(side, *at)
                if chunk < 0:
                    tile.group(slot, source, kept, total)
                else:
                    tile.vector(chunk, slot, size, places, counts)
        if tile:
            yield tile.given()

    return run


SCORED = "lang string, block int, chunk int, slot int, source string, kept long, total long, size long, places binary, counts binary"


def _scored(top: int):
    """Of rows of SCORED, a language's vector of a chunk (slot -1) before those of a block's groups: each group's words
    that it uses more than the language, the `top` first of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        terms, usual = [], np.empty(0, np.int64)
        for batch in batches:
            for lang, _, _, slot, source, kept, total, size, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if slot < 0:
                    terms = open_.decompress(places).split(b"\n")
                    usual = shares(np.frombuffer(open_.decompress(counts), "<i8"), total, kept)
                    continue
                n = _dense(places, counts, size)
                p = shares(n, total, kept)
                at = np.flatnonzero((n > 0) & (p > usual))
                value = (p[at] - usual[at]) ** 2 // usual[at]
                best = np.lexsort((at, -value))[:top]
                k = len(best)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.repeat(source, k), pa.array([terms[x] for x in at[best]], pa.binary()).cast(pa.string()), pa.array(value[best], pa.int64())], ["lang", "source", "item", "value"])

    return run


def divergences(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (language, source) group of docs.

    A language keeps the words (see words) of at least least_docs of its documents, V of them. A group's share p of a
    word, in parts of 10^9, is 1 + floor(10^9 (count + 1) / (N + V)), N its count of all kept words. Part pair: each other
    source of the language, value the sum over kept words of floor((p - q)^2 / q), q the other's share (0 if V is 0), all
    of them. Part term: each word that the group has and whose share is above the language's, q, with floor((p - q)^2 /
    q), the `top` first. Ranks count from 1 by falling value, then rising UTF-8 bytes of the item.

    Null texts, languages and sources are empty ones; groups without words count; repeated rows are documents of their
    own; a source alone in its language has no pair; other columns are ignored whatever their names; an empty table
    gives an empty one. All of it is whole-number arithmetic."""
    spark = docs.sparkSession
    ws = Scratch(spark, "divergence")
    c = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
    docs = docs.select(c(lang_col).alias("lang"), c(source_col).alias("source"), c(text_col).alias("text"))
    chunks = min(MOST_CHUNKS, max(LEAST_CHUNKS, docs.count() // CHUNK_DOCS))
    rows = docs.mapInArrow(_counted(HELD), "lang string, source string, term string, n long, docs long")
    rows = rows.select(F.pmod(F.xxhash64("lang", "term"), F.lit(chunks)).cast("int").alias("chunk"), "*")
    vectors = ws.save(rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_vectors(least_docs, PENDING), VECTOR), "vectors", repeats=False)

    kept = vectors.where("source is null").groupBy("lang").agg(F.sum("kept").alias("kept"), F.sum("total").alias("lang_total"))
    totals = vectors.where("source is not null").groupBy("lang", "source").agg(F.sum("total").alias("total"))
    w = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(w.orderBy("source")) - 1).alias("slot"), F.count("*").over(w).alias("n"))
    groups = groups.withColumn("block", F.floor(F.col("slot") / SIDE).cast("int")).withColumn("blocks", F.ceil(F.col("n") / SIDE).cast("int"))
    groups = ws.save(groups.drop("n"), "groups")

    # Pairs: heads and vectors go to all tiles of their block.
    spans = -(-chunks // SPAN)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    i, j = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    null = F.lit(None)
    heads = groups.select("*", other).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))
    heads = heads.select("lang", i, j, "span", F.lit(-1).alias("chunk"), "slot", "source", "kept", "total", F.lit(0).cast("long").alias("size"), null.cast("binary").alias("places"), null.cast("binary").alias("counts"))
    placed = vectors.where("source is not null").withColumnRenamed("kept", "size").drop("total").join(groups, ["lang", "source"])
    tiles = placed.select("*", other).select("lang", i, j, F.floor(F.col("chunk") / SPAN).cast("int").alias("span"), "chunk", "slot", null.cast("string").alias("source"), null.cast("long").alias("kept"), null.cast("long").alias("total"), "size", "places", "counts")
    key = ["lang", "i", "j", "span"]
    pairs = heads.unionByName(tiles).repartition(*key).sortWithinPartitions(*key, "chunk", "slot").mapInArrow(_tiles(SIDE), PAIR)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    # Words: a language's vectors go to each of its blocks.
    whole = groups.select("lang", "block", "kept").distinct().join(kept.select("lang", "lang_total"), "lang")
    usual = vectors.where("source is null").select("lang", "chunk", F.col("kept").alias("size"), "places", "counts").join(whole, "lang")
    usual = usual.select("lang", "block", "chunk", F.lit(-1).alias("slot"), null.cast("string").alias("source"), "kept", F.col("lang_total").alias("total"), "size", "places", "counts")
    key = ["lang", "block", "chunk"]
    own = placed.select("lang", "block", "chunk", "slot", "source", "kept", "total", "size", "places", "counts")
    terms = usual.unionByName(own).repartition(*key).sortWithinPartitions(*key, "slot").mapInArrow(_scored(top), PAIR)

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and words of all groups of documents."""
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT g.lang, count(k.term)::HUGEINT AS v FROM (SELECT DISTINCT lang FROM docs) g LEFT JOIN kept k USING (lang) GROUP BY g.lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v.v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), usual AS (
  SELECT k.lang, k.term, 1 + 1000000000 * (sum(c.n)::HUGEINT + 1) // (any_value(t.total) + any_value(v.v)) AS q
  FROM kept k JOIN counts c USING (lang, term) JOIN v USING (lang) JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM groups GROUP BY lang) t USING (lang)
  GROUP BY k.lang, k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p.p - u.q) * (p.p - u.q) // u.q)::BIGINT FROM p JOIN usual u USING (lang, term) WHERE p.n > 0 AND p.p > u.q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 200
"""
