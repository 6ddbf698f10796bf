"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps each word of a text to a symbol, with a weight if it is an insult; sentence ends, line ends and
quotation marks are symbols too. Five transducers, each a table of arcs over such symbols, follow: negation (marks what
its scope reaches), reported speech (marks what is quoted, over several sentences too, or said by others), insult and
threat (name what is left of them) and target (closes a clause as aimed at somebody or not). They are composed once
into one table, which is run over a text. Its outputs say of each insult whether it is asserted, negated or reported,
and of each clause whether it is aimed; a clause with a target and an asserted insult or threat is a full match. What
insults weigh (words and word beginnings), and what a clause counts without a target, is learned."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, free_name, freed

#: Labelled rows that the grammar is learned from: all of them up to this many, beyond that a random part of about this size.
MAX_LABELLED = 12_000
#: Words that negation reaches over.
NEGATION_SCOPE = 3
#: Lengths of word beginnings that are tried as patterns.
BEGINNINGS = (4, 5, 6, 7)
#: What a pattern must show: distinct contexts in toxic texts, log-likelihood ratio, odds of toxic over clean contexts.
LEAST_CONTEXTS, LEAST_RATIO, LEAST_ODDS = 3, 12.0, 3.0

# Closed word classes of the grammar, in English, German, French and Spanish.
NEGATION = frozenset("not no never nor neither isn aren wasn don doesn nicht kein keine keinen nie niemals ne pas jamais aucun ni nunca jamás tampoco".split())
REPORT = frozenset("said says say wrote writes claimed claims reported reports called quoted quote allegedly sagte sagt schrieb behauptet angeblich dit disait écrit déclaré rapporte dijo dice escribió afirmó".split())
TARGET = frozenset("you your yours yourself u he she they them him her his their du dich dir ihr euch sie er tu te toi vous ton ta il elle ils eux tú te ti usted ustedes él ella ellos".split())
THREAT = frozenset("kill killed murder hurt destroy shoot stab beat burn hang töten töte umbringen schlagen tuer tuerai frapper détruire brûler matar mataré golpear destruir quemar".split())

_WORD = re.compile(r"\w+|[\"“”„«»]")
_TOKEN = re.compile(r"\w+|[\"“”„«»]|[.!?;]+|\n+")
_QUOTES = frozenset("\"“”„«»")
FEATURES = ("asserted", "negated", "reported", "targeted", "threats", "strongest", "length", "one")
#: Where the fit starts from and is drawn to: what each sum is worth without data.
PRIOR = np.array([1.0, 0.3, 0.3, 0.4, 1.5, 0.8, -0.5, -4.0])

# Input symbols: other word, negation, reporting word, target, threat, insult, quotation mark, sentence end, line end.
OTHER, NOT, SAYS, WHOM, DANGER, INSULT, QUOTE, STOP, LINE = "other", "not", "says", "whom", "danger", "insult", "quote", "stop", "line"
SYMBOLS = (OTHER, NOT, SAYS, WHOM, DANGER, INSULT, QUOTE, STOP, LINE)
# What negation and reported speech make of an insult or a threat, and what comes out at last.
DENIED, TOLD = "denied ", "told "
OUT = (OTHER, "asserted", "negated", "reported", "threat", "aimed", "unaimed")


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: arcs[state, input symbol] = (next state, output symbol)."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str]]

    def __matmul__(self, then: Transducer) -> Transducer:
        """Composition: what self puts out goes into `then`; only states that can be reached are kept."""
        inputs: dict[object, list[str]] = {}
        for state, x in self.arcs:
            inputs.setdefault(state, []).append(x)
        start, arcs = (self.start, then.start), {}
        todo, seen = [start], {start}
        while todo:
            a, b = todo.pop()
            for x in inputs[a]:
                a2, middle = self.arcs[a, x]
                b2, out = then.arcs[b, middle]
                arcs[(a, b), x] = (a2, b2), out
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)


def negation(scope: int) -> Transducer:
    """States: words that a negation still reaches over. A sentence's end ends it."""
    arcs = {}
    for left in range(scope + 1):
        for x in SYMBOLS:
            to = scope if x == NOT else 0 if x in (STOP, LINE) else left if x == QUOTE else max(0, left - 1)
            arcs[left, x] = to, DENIED + x if left and x in (INSULT, DANGER) else x
    return Transducer(0, arcs)


def reported() -> Transducer:
    """States: whether a quotation is open, and whether somebody was said to speak in this clause. A quotation goes on
    over sentences, to its closing mark or the end of the line."""
    arcs = {}
    for quoted in (False, True):
        for told in (False, True):
            for x in (*SYMBOLS, DENIED + INSULT, DENIED + DANGER):
                to = (quoted != (x == QUOTE) and x != LINE, (told or x == SAYS) and x not in (STOP, LINE))
                arcs[(quoted, told), x] = to, TOLD + x.removeprefix(DENIED) if (quoted or told) and x.endswith((INSULT, DANGER)) else x
    return Transducer((False, False), arcs)


def insult() -> Transducer:
    named = {INSULT: "asserted", DENIED + INSULT: "negated", TOLD + INSULT: "reported"}
    return Transducer(0, {(0, x): (0, named.get(x, x)) for x in (*SYMBOLS, *named, DENIED + DANGER, TOLD + DANGER)})


def threat() -> Transducer:
    """Only threats that are neither denied nor reported are left."""
    named = {DANGER: "threat", DENIED + DANGER: OTHER, TOLD + DANGER: OTHER}
    return Transducer(0, {(0, x): (0, named.get(x, x)) for x in (*SYMBOLS, *named, "asserted", "negated", "reported")})


def target() -> Transducer:
    """State: whether the clause has named somebody. A clause's end is put out as aimed or unaimed."""
    arcs = {}
    for named in (False, True):
        for x in SYMBOLS:
            arcs[named, x] = (False, "aimed" if named else "unaimed") if x in (STOP, LINE) else (named or x == WHOM, OTHER)
        arcs |= {(named, x): (named, x) for x in ("asserted", "negated", "reported", "threat")}
    return Transducer(False, arcs)


@cache
def compiled() -> tuple[list[list[int]], list[list[int]], int]:
    """(next state, output) by state and input symbol of the five composed, and the first state, as numbers."""
    whole = negation(NEGATION_SCOPE) @ reported() @ insult() @ threat() @ target()
    number: dict[object, int] = {}
    for state, _ in whole.arcs:
        number.setdefault(state, len(number))
    to, out = ([[0] * len(SYMBOLS) for _ in number] for _ in range(2))
    for (state, x), (state2, y) in whole.arcs.items():
        to[number[state]][SYMBOLS.index(x)] = number[state2]
        out[number[state]][SYMBOLS.index(x)] = OUT.index(y)
    return to, out, number[whole.start]


@dataclass
class Grammar:
    """Insult patterns (`word`, or `beginning*`) with weights, and the weights of the clause sums."""

    patterns: dict[str, float]
    weights: list[float] = field(default_factory=lambda: PRIOR.tolist())

    def __post_init__(self) -> None:
        self.known: dict[str, tuple[int, float]] = {}

    def symbol(self, word: str) -> tuple[int, float]:
        """The lexical transducer: a token's symbol, and its weight as an insult (of the word, or its longest known beginning)."""
        got = self.known.get(word)
        if got is None:
            w = self.patterns.get(word)
            if w is None:
                w = next((x for n in reversed(BEGINNINGS) if len(word) > n and (x := self.patterns.get(word[:n] + "*")) is not None), 0.0)
            kind = QUOTE if word in _QUOTES else LINE if word[0] == "\n" else STOP if word[0] in ".!?;" else DANGER if word in THREAT else INSULT if w > 0 else NOT if word in NEGATION else SAYS if word in REPORT else WHOM if word in TARGET else OTHER
            got = SYMBOLS.index(kind), w
            if len(self.known) < 100_000:
                self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        """Sums over clauses: asserted, negated and reported insults, all of aimed clauses, threats of aimed clauses;
        the strongest insult; the text's length."""
        tokens = _TOKEN.findall(text.lower()) if text else []
        symbols = [*map(self.symbol, tokens), (SYMBOLS.index(LINE), 0.0)]
        sums, strongest = [0.0] * 5, 0.0
        if any(x > 0 or s == _DANGER for s, x in symbols):
            to, out, state = compiled()
            weight, threats = 0.0, 0
            for s, x in symbols:
                y, state = out[state][s], to[state][s]
                if not y:
                    continue
                if y <= 3:  # asserted, negated, reported
                    sums[y - 1] += x
                    weight += x
                    strongest = max(strongest, x)
                elif y == 4:  # a threat, perhaps with an insult's weight
                    threats += 1
                    sums[0] += x
                    weight += x
                    strongest = max(strongest, x)
                else:
                    if y == 5:
                        sums[3] += weight
                        sums[4] += threats
                    weight, threats = 0.0, 0
        words = sum(s < _QUOTE for s, _ in symbols)
        return [*(math.log1p(x) for x in sums), strongest, math.log1p(words) / 5, 1.0]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


_DANGER, _QUOTE = SYMBOLS.index(DANGER), SYMBOLS.index(QUOTE)


def _patterns(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


@freed
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pattern of toxic texts with a hash of its neighbours: copies of a text add nothing."""
    for batch in batches:
        seen: set[tuple[str, int]] = set()
        for text in batch.column(0).to_pylist():
            w = ["", *_WORD.findall(text.lower()), ""]
            for i in range(1, len(w) - 1):
                if len(w[i]) > 2:
                    near = xxhash.xxh3_64_intdigest(f"{w[i - 1]} {w[i]} {w[i + 1]}") >> 1
                    seen.update((p, near) for p in _patterns(w[i]))
            if len(seen) > 200_000:
                yield _pairs(seen)
                seen = set()
        yield _pairs(seen)


def _pairs(seen: set[tuple[str, int]]) -> pa.RecordBatch:
    rows = sorted(seen)
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["pattern", "near"])


def _clean_counts(wanted: frozenset[str]):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = [x for x in _WORD.findall(text.lower()) if len(x) > 2]
                total += len(w)
                for x, n in Counter(w).items():
                    for p in _patterns(x):
                        if p in wanted:
                            counts[p] += n
        counts["\n"] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])

    return run


def _features(patterns: dict[str, float]):
    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(patterns)
        for batch in batches:
            f = [g.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), batch.column(1)], ["f", "y"])

    return run


def held_out(id_col: str) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(weights_rows: list[tuple[list[float], int]], prior: np.ndarray = PRIOR, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Logistic regression drawn to `prior`, by Newton's method."""
    if not weights_rows:
        return prior.tolist()
    x, y = np.array([f for f, _ in weights_rows]), np.array([t for _, t in weights_rows], float)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Grammar:
    """A grammar learned from the labelled rows that aren't held out, at most about `max_labelled` of them.

    Three quarters give the insult patterns: a pattern's evidence is the number of distinct contexts (neighbouring
    words) in toxic texts, so copies count once, against its occurrences in clean texts. The last quarter gives the
    weights of the clause sums. Null labels and texts are left out; of several labels of one id the highest counts;
    without toxic labels the grammar has no patterns and scores low everywhere."""
    ws = Scratch(docs.sparkSession, "toxicity")
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y is not null")
    marks = marks.where(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    part = F.pmod(F.xxhash64(F.lit(5), F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    marks = marks.where(part < max_labelled / max(1, n))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(marks), "id")  # about max_labelled rows of two numbers
    fold = F.pmod(F.xxhash64(F.lit(6), F.col("id").cast("string")), F.lit(4))
    rows = ws.save(rows.select("text", "y", fold.alias("fold")), "rows")
    lexical = rows.where("fold > 0")
    near = lexical.where("y > 0").select("text").mapInArrow(_contexts, "pattern string, near long").distinct()
    toxic = near.groupBy("pattern").count()
    p = {r[0]: r[1] for r in toxic.where(F.col("count") >= LEAST_CONTEXTS).collect()}  # of MAX_LABELLED texts at most
    clean = lexical.where("y = 0").select("text").mapInArrow(_clean_counts(frozenset(p)), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    c = {r[0]: r[1] for r in clean.collect()}
    all_c, all_p = max(1, c.pop("\n", 0)), max(1, sum(x for k, x in p.items() if not k.endswith("*")))
    found = []
    for k, a in p.items():
        b = c.get(k, 0)
        ea, eb = (a + b) * all_p / (all_p + all_c), (a + b) * all_c / (all_p + all_c)
        if a > ea:
            ratio = 2 * (a * math.log(a / ea) + (b * math.log(b / eb) if b else 0))
            if ratio >= LEAST_RATIO and a + 0.5 >= LEAST_ODDS * (b + 0.5):
                found.append((ratio, k, math.log((a + 0.5) / (b + 0.5))))
    found.sort(key=lambda x: (-x[0], x[1]))
    patterns = {k: w for _, k, w in found}
    seen = rows.where("fold = 0").select("text", "y").mapInArrow(_features(patterns), "f array<double>, y int").collect()
    ws.drop("rows")
    return Grammar(patterns, fit([(r["f"], min(1, r["y"])) for r in seen]))


def score_toxicity(df: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """df with a score from 0 to 1 for each whole text (null and empty texts too); a column of that name is replaced.
    A row's score depends on its text alone, so repeated rows have one score and ties stay ties."""
    df = df.drop(*[c for c in df.columns if c.lower() == score_col.lower()])
    at, schema = df.columns.index(text_col), T.StructType([*df.schema.fields, T.StructField(score_col, T.DoubleType())])
    patterns, weights = grammar.patterns, grammar.weights

    @freed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(patterns, weights)
        for batch in batches:
            scores = pa.array([g.score(t.as_py()) for t in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, score_col])

    return df.mapInArrow(run, schema)


def remove_toxic(df: DataFrame, labels: DataFrame, limit: float = 0.5, **options) -> DataFrame:
    """The rows of df that score below `limit` under a grammar learned from the labelled ones among them."""
    name = free_name(df, "toxicity")
    out = score_toxicity(df, learn(df, labels, **options), score_col=name)
    return out.where(F.col(name) < limit).select(*[f"`{c}`" for c in df.columns])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of all documents; a fifth of them is held out from learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs.select("doc_id", "text"), grammar, score_col="score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
