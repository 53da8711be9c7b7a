"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words as weighted symbols (insult, threat, target, negation, reported speech, quotation
mark, clause end, other). Five more transducers are composed with it. Three mark what is read: what stands within a few
words after a negation; what stands in reported or quoted speech; what stands after a target. Two accept: whether the
clause has had an insult, and whether it has had a threat. The composition reads a text once. Where a clause
ends, its last state says whether it is a match (an insult, or a threat with a target on either side) and what holds for
all of it (a target, a verb of reporting, on either side), and the clause is scored: the weights along its path,
each lowered by its context, are combined to the chance that the clause is meant.

The insults are learned from labelled rows, whole words and word beginnings; how far a context lowers a weight
starts from a prior and is corrected by what the labels say. What the clauses of a text amount to, taken together, is put
on the scale of the labels by logistic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, product
from math import exp, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Remembered
from .common import batch, cut, map_batches

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END = range(8)
_OTHER, _QUOTE, _END = (OTHER, 0.0), (QUOTE, 0.0), (END, 0.0)

# Small closed word classes of four languages.
TARGETS = "you your yours u ur he she they them him her his their everyone nobody du dich dir dein ihr euch euer er sie tu toi te ton vous votre il elle ils elles usted ustedes ti tus vosotros ellos ellas".split()
NEGATIONS = "not no never none without isn aren wasn don doesn didn nicht kein keine nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin tampoco".split()
REPORTS = "said says say wrote writes claimed claims quoted quotes reported reports according alleged called sagte sagt schrieb behauptete laut dit disait écrit selon dijo dice escribió según".split()
THREATS = "kill hurt destroy murder stab shoot töten umbringen erschießen tuer détruire matar destruir".split()

_WORD = re.compile(r"\w+")
_TOKEN = re.compile(r"\w+|[.!?;\n]|[\"“”«»„]")
#: Share of matches in a context that are meant, before any labels are seen.
PRIOR = {"plain": 0.9, "aimed": 0.97, "negated": 0.3, "reported": 0.4}
PRIOR_ROWS = 10
#: Bits of a context.
NEGATED, REPORTED, AIMED, THREATENED = 1, 2, 4, 8
#: The weight of a threat, and how many insults it is as grave as.
THREAT_WEIGHT, THREAT_GRAVITY = 0.9975, 2.0


class Transducer:
    """Deterministic: (state, symbol) -> (state, mark); ``mark`` is a bit set given to what is read."""

    def __init__(self, states: int, step):
        self.states = states
        self.arcs = [[step(s, x) for x in range(8)] for s in range(states)]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Both at once: the states are pairs, the marks are joined."""
        n = other.states
        joined = Transducer(0, None)
        joined.states = self.states * n
        joined.arcs = [[(a[x][0] * n + b[x][0], a[x][1] | b[x][1]) for x in range(8)] for a, b in product(self.arcs, other.arcs)]
        return joined


def negation(reach: int = 3) -> Transducer:
    def step(s: int, x: int) -> tuple[int, int]:
        if x == NEGATION:
            return reach, 0
        if x == END:
            return 0, 0
        return max(0, s - 1), 1 if s else 0

    return Transducer(reach + 1, step)


def reported() -> Transducer:
    def step(s: int, x: int) -> tuple[int, int]:
        """0: own words; 1: after a verb of reporting, to the end of the clause; 2: between quotation marks."""
        if x == QUOTE:
            return (0 if s == 2 else 2), 0
        if x == REPORT:
            return s or 1, 0
        if x == END:
            return (2 if s == 2 else 0), 0
        return s, 2 if s else 0

    return Transducer(3, step)


def targeted() -> Transducer:
    def step(s: int, x: int) -> tuple[int, int]:
        return (0, 0) if x == END else (1, 0) if x == TARGET else (s, 4 if s else 0)

    return Transducer(2, step)


def seen(symbol: int) -> Transducer:
    """Accepts clauses that have the symbol: state 1 once it was read."""
    return Transducer(2, lambda s, x: (0 if x == END else int(s == 1 or x == symbol), 0))


GRAMMAR = negation() @ reported() @ targeted() @ seen(INSULT) @ seen(THREAT)


def prior(mark: int) -> float:
    return PRIOR["aimed" if mark & AIMED else "plain"] * (PRIOR["negated"] if mark & NEGATED else 1) * (PRIOR["reported"] if mark & REPORTED else 1)


class Clause(NamedTuple):
    """A clause that the grammar accepts: (symbol, context, weight) of its insults and threats."""

    parts: tuple[tuple[int, int, float], ...]


@dataclass
class Model:
    words: dict[str, float]
    beginnings: dict[str, float]
    contexts: dict[int, float] = field(default_factory=lambda: {m: prior(m) for m in range(16)})
    scale: tuple[float, float] = (2.0, -2.0)

    def __post_init__(self):
        closed = {w: s for s, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
        lengths = sorted({len(b) for b in self.beginnings}, reverse=True)

        def symbol(token: str) -> tuple[int, float]:
            if (p := self.words.get(token)) is not None:
                return INSULT, p
            for n in lengths:
                if len(token) >= n and (p := self.beginnings.get(token[:n])) is not None:
                    return INSULT, p
            if token in closed:
                return closed[token], THREAT_WEIGHT
            return _QUOTE if token in '"“”«»„' else _END if token in ".!?;\n" else _OTHER

        self.symbol = Remembered(symbol)

    def __reduce__(self):
        return Model, (self.words, self.beginnings, self.contexts, self.scale)

    def clauses(self, text: str | None) -> list[Clause]:
        """The clauses of a text that the grammar accepts, in text order."""
        low = (text or "").lower()
        read = self.symbol.__getitem__
        if not any(s in (INSULT, THREAT) for s, _ in map(read, _WORD.findall(low))):
            return []
        found, held, state, arcs = [], [], 0, GRAMMAR.arcs
        for s, p in chain(map(read, _TOKEN.findall(low)), [_END]):
            if s == END and held:
                rest, threat = divmod(state, 2)
                rest, insult = divmod(rest, 2)
                rest, target = divmod(rest, 2)
                whole = AIMED * target | REPORTED * (rest % 3 == 1)
                if threat and target:
                    found.append(Clause(tuple((x, m | whole, w) for x, m, w in held)))
                elif insult:  # a threat without a target is none
                    found.append(Clause(tuple((x, m | whole, w) for x, m, w in held if x == INSULT)))
                held = []
            state, mark = arcs[state][s]
            if s == INSULT or s == THREAT:
                held.append((s, mark, p))
        return found

    def matches(self, text: str | None) -> list[tuple[int, float]]:
        """(context, weight) of all that is part of an accepted clause, in text order."""
        return [(m, w) for c in self.clauses(text) for _, m, w in c.parts]

    clause_matches = matches

    def meant(self, clause: Clause) -> float:
        """Minus the log of the chance that nothing in a clause is meant: weights and contexts multiply along its path."""
        total = 0.0
        for symbol, mark, weight in clause.parts:
            threat = symbol == THREAT
            total -= (THREAT_GRAVITY if threat else 1.0) * log(1.0 - weight * self.contexts[mark | THREATENED * threat])
        return total

    def clause_score(self, clause: Clause) -> float:
        """The chance that something in a clause is meant."""
        return 1.0 - exp(-self.meant(clause))

    def evidence(self, text: str | None) -> float:
        """What the clauses of a text amount to."""
        return sum(map(self.meant, self.clauses(text)))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + exp(-max(-30.0, min(30.0, self.scale[0] * self.evidence(text) + self.scale[1]))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, least_support: int = 8, least_precision: float = 0.85, shortest: int = 4, longest: int = 10, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns insults and the weight of contexts from ``labels`` (id, label), of which ``sample_rows`` are
    used, chosen by a hash of the id; an id with several labels has the largest, null labels and ids are left out.
    Terms are words, and word beginnings of ``shortest`` to ``longest`` letters, that ``least_support`` different words
    precede in toxic rows; all of them are kept. Only they, counts by context and two numbers a sampled row come to the driver.

    Support is counted in distinct preceding words, so that copies of one text do not count again and again. Without
    toxic rows nothing is learned, and all texts score as if empty unless they threaten.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y")).orderBy(F.xxhash64("k", F.lit("draw")), "k").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen), "k").select("y", "t")  # bounded by sample_rows
    rows = cut(rows)  # so the documents are read once
    words = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}\p{M}_]+"), lambda w: w != "")
    pairs = rows.select("y", words.alias("w")).select("y", F.explode(F.transform("w", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.element_at("w", i)).otherwise("").alias("b")))).alias("p")).select("y", "p.w", "p.b")
    counted = pairs.distinct().groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    good = (F.col("pos") >= least_support) & (F.col("pos") >= least_precision * (F.col("pos") + F.col("neg")))
    counted = counted.cache()
    try:
        terms = lambda df, name: {r[name]: (r["pos"], r["neg"]) for r in df.where(good).collect()}  # noqa: E731  bounded by the sample
        found = terms(counted, "w")
        lengths = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.greatest(F.lit(shortest), F.length("w"))))
        starts = counted.where("pos > 0 or neg > 0").select(F.explode(F.transform(lengths, lambda n: F.substring("w", F.lit(1), n))).alias("s"), "pos", "neg").where(F.length("s") >= shortest)
        begun = terms(starts.groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "s")
    finally:
        counted.unpersist()
    # of a chain of beginnings with nearly the same support the longest says most
    most: dict[str, int] = {}  # of what goes on with one letter more
    for x, (pos, _) in begun.items():
        most[x[:-1]] = max(most.get(x[:-1], 0), pos)
    begun = {s: c for s, c in begun.items() if most.get(s, 0) < 0.95 * c[0] and not (s in found and found[s][0] >= 0.95 * c[0])}
    chance = lambda c: (c[0] + 1) / (c[0] + c[1] + 1.2)
    model = Model({w: chance(c) for w, c in found.items()}, {s: chance(c) for s, c in begun.items()})
    schema = pa.schema([("mark", pa.int32()), ("y", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times: dict[tuple[int, int], int] = {}
            for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for symbol, mark, _ in chain.from_iterable(c.parts for c in model.clauses(t.as_py())):
                    at = mark | THREATENED * (symbol == THREAT), y
                    times[at] = times.get(at, 0) + 1
            if times:
                yield batch(schema, [[m for m, _ in times], [y for _, y in times], list(times.values())])

    totals = {(r["mark"], r["y"]): r["n"] for r in map_batches(rows, run, "mark int, y int, n long").groupBy("mark", "y").agg(F.sum("n").alias("n")).collect()}
    for m in range(16):
        pos, neg = totals.get((m, 1), 0), totals.get((m, 0), 0)
        model.contexts[m] = (pos + PRIOR_ROWS * prior(m)) / (pos + neg + PRIOR_ROWS)
    gauged = pa.schema([("e", pa.float64()), ("y", pa.int32())])

    def gauge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(gauged, [[model.evidence(t.as_py()) for t in b.column(1)], b.column(0)])

    seen = [(r["e"], r["y"]) for r in map_batches(rows, gauge, "e double, y int").limit(4 * sample_rows).collect()]
    model.scale = _logistic(np.array([e for e, _ in seen]), np.array([y for _, y in seen], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y | x) by Newton's method, with ten rows in favour of the default."""
    x, y, weight = np.concatenate([x, [4.0, 0.0]]), np.concatenate([y, [1.0, 0.0]]), np.concatenate([np.ones(len(x)), [10.0, 10.0]])
    a, b = 1.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weight * p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(weight * (y - p) * x).sum() - 0.1 * (a - 1), (weight * (y - p)).sum()])
        step = np.clip(step, -1, 1)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 0.05), float(b)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, score, predicted) for every row: map-only. Null and empty texts score what a text without matches does; a long
    text is read whole, in time and memory in proportion to it; repeated rows and ids give a row each, a null id
    a null id; an empty table gives none. A score equal to the threshold is predicted toxic."""
    schema = pa.schema([(id_col, pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("toxicity")
        for b in batches:
            found = [model.score(t.as_py()) for t in b.column(1)]
            yield batch(schema, [b.column(0).cast(pa.int64()), found, [int(x >= threshold) for x in found]])

    return map_batches(df.select(id_col, text_col), run, f"{id_col} long, score double, predicted int")


def accepted(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, with all their columns, that score below the threshold; as ``score`` for nulls, empty and
    repeated rows."""
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Remembered.claim("toxicity")
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(place)], pa.bool_()))

    return map_batches(df, run, df.schema)
