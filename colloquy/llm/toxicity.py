"""Toxicity by a weighted finite-state pattern grammar.

Five small transducers read the words of a clause as marks: one says what a target is near to, one what a negation holds for, one what is
reported speech, one weighs insults and one threats. They are composed by product construction into one machine whose table drives
the scoring. Targets that follow are seen by the same target transducer, run from the end of the clause beforehand. Each matched
insult or threat falls under a pattern (kind, aimed, negated, reported) with the weight of its arc and its word; a document's
score is a logistic function of what its clauses add up to under each pattern. Insults are arcs that are learned from labelled rows
(whole words and word beginnings), as are the weights of the patterns; the other word lists are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.arrow import map_columns, slices
from colloquy.llm.bpe import Memo, claim

# Fixed word lists: English, French, German, Spanish.
INSULTS = "idiot moron loser scum imbecile stupid pathetic worthless disgusting connard imbécile abruti trottel dummkopf abschaum estúpido imbécil escoria".split()
THREATS = "kill hurt destroy beat stab shoot tuer frapper détruire töten umbringen zerstören schlagen matar golpear destruir".split()
TARGETS = "you your you're he she they him her them this these those tu te toi vous ton ta cet cette ces il elle ils du dich dir dein deine ihr euch er sie dieser diese usted tú eres ese esa esos ellos".split()
NEGATIONS = "not no never isn't aren't don't pas jamais non aucun nicht kein keine nie nunca jamás ningún".split()
REPORTS = "said says called quoted wrote claimed reported told dit appelé écrit cité sagte nannte schrieb zitierte dijo llamó escribió citó".split()
#: Marks of words, as bits of a symbol; the transducers add the last three.
INSULT, THREAT, TARGET, NEGATION, REPORT, AIMED, NEGATED, REPORTED = (1 << i for i in range(8))
#: Marks that a machine reads at first: the words' own, and targets ahead.
INPUTS = range(2 * AIMED)
#: How many words after it a negation holds, and how near a target stands.
REACH, NEAR = 3, 4
#: Weight of the first insult or threat of a clause, and of each further one.
ONCE, AGAIN = 1.0, 0.5
CLAUSE = re.compile(r"[.!?;\n]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Lengths of word beginnings that may be learned as insults of their own.
STEMS = (3, 4, 5, 6, 7, 8)
#: Weight of a listed insult or threat, before any label is seen; learned insults have their log odds.
LISTED = 3.5
#: Patterns: kind (insult, threat) x aimed x negated x reported.
PATTERNS = [(k, a, n, r) for k in (INSULT, THREAT) for a in (0, 1) for n in (0, 1) for r in (0, 1)]
PLACE = {p: i for i, p in enumerate(PATTERNS)}
SIZE = len(PATTERNS)


def prior(kind: int, aimed: int, negated: int, reported: int) -> float:
    """Weight of a pattern before any label is seen."""
    return (3.0 if kind == INSULT else 1.0) * (1.3 if aimed else 1.0) * (0.3 if negated else 1.0) * (0.4 if reported else 1.0)


PRIOR = np.array([prior(*p) for p in PATTERNS])
BIAS = -3.0


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] is (next state, symbol put out, weight); it starts in state 0, and every state may be the last."""

    arcs: tuple[dict[int, tuple[int, int, float]], ...]

    def run(self, symbols) -> list[tuple[int, float]]:
        state, out = 0, []
        for x in symbols:
            state, y, w = self.arcs[state][x]
            out.append((y, w))
        return out


def machine(states: int, step: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
    """The table of a step from state and symbol."""
    return Transducer(tuple({x: step(s, x) for x in range(2 * REPORTED)} for s in range(states)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """One machine that does what `b` does to what `a` puts out: its states are the pairs that can be reached; weights add up."""
    known, queue, arcs = {(0, 0): 0}, [(0, 0)], []
    for p, q in queue:
        row = {}
        for x, (p2, y, v) in a.arcs[p].items():
            q2, z, w = b.arcs[q][y]
            if (p2, q2) not in known:
                known[p2, q2] = len(known)
                queue.append((p2, q2))
            row[x] = (known[p2, q2], z, v + w)
        arcs.append(row)
    return Transducer(tuple(arcs))


def within(mark: int, adds: int, reach: int) -> Transducer:
    """Adds a mark to the `reach` words after each word with that mark; the state is how many words are left."""
    return machine(reach + 1, lambda s, x: (reach if x & mark else max(0, s - 1), x | (adds if s else 0), 0.0))


def after(mark: int, adds: int) -> Transducer:
    """Adds a mark to all words after a word with that mark."""
    return machine(2, lambda s, x: (1 if x & mark else s, x | (adds if s else 0), 0.0))


def weighed(mark: int) -> Transducer:
    """Weighs words with that mark: the first in full, further ones less."""
    return machine(2, lambda s, x: (1, x, AGAIN if s else ONCE) if x & mark else (s, x, 0.0))


TARGETING, NEGATING, REPORTING, INSULTING, THREATENING = within(TARGET, AIMED, NEAR), within(NEGATION, NEGATED, REACH), after(REPORT, REPORTED), weighed(INSULT), weighed(THREAT)


def composed() -> Transducer:
    """The five in a row, for symbols of a clause's words with targets ahead."""
    first = Transducer(tuple({x: row[x] for x in INPUTS} for row in TARGETING.arcs))
    for other in (NEGATING, REPORTING, INSULTING, THREATENING):
        first = compose(first, other)
    return first


@dataclass(frozen=True)
class Lexicon:
    """Arcs of the insult transducer that are learned: whole words and word beginnings, with their weights (log odds)."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


class Grammar:
    """The composed machine over one lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.fixed: dict[str, int] = {}
        for words, bit in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
            for w in words:
                self.fixed[w] = self.fixed.get(w, 0) | bit
        self.marks = Memo(self.mark, 100_000)
        self.machine = composed()

    def mark(self, word: str) -> tuple[int, float]:
        """Marks of a word, and its weight as an insult."""
        weight = self.lexicon.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                weight = max(weight, self.lexicon.stems.get(word[:n], 0.0))
        return self.fixed.get(word, 0) | (INSULT if weight > 0 else 0), weight

    def clause(self, words: list[str]) -> Iterator[tuple[tuple[int, int, int, int], float]]:
        """(pattern, weight) of each match in one clause."""
        marks = [self.marks[w] for w in words]
        if not any(m & (INSULT | THREAT) for m, _ in marks):
            return
        ahead = TARGETING.run(m for m, _ in reversed(marks))
        symbols = [m | (x & AIMED) for (m, _), (x, _) in zip(marks, reversed(ahead))]
        for (x, arc), (m, weight) in zip(self.machine.run(symbols), marks):
            flags = (int(bool(x & AIMED)), int(bool(x & NEGATED)), int(bool(x & REPORTED)))
            if m & INSULT:
                yield (INSULT, *flags), arc * weight
            if m & THREAT:
                yield (THREAT, *flags), arc * LISTED

    def patterns(self, text: str | None) -> list[float] | None:
        """log(1 + what the clauses' matches add up to) under each pattern; None if nothing matches."""
        text = (text or "").lower()
        marks = self.marks
        if not any(marks[w][0] & (INSULT | THREAT) for w in set(WORD.findall(text))):
            return None
        found = [0.0] * SIZE
        for clause in CLAUSE.split(text):
            for pattern, weight in self.clause(WORD.findall(clause)):
                found[PLACE[pattern]] += weight
        return [math.log1p(x) for x in found]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float

    def score(self, patterns: list[float] | None) -> float:
        z = self.bias + (sum(w * x for w, x in zip(self.weights, patterns)) if patterns else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def units(text: str | None) -> set[str]:
    """What may be learned as an insult: 'w' + a word, 's' + a word beginning."""
    words = set(WORD.findall((text or "").lower()))
    return {"w" + w for w in words} | {"s" + w[:n] for w in words for n in STEMS if len(w) >= n}


def longest(stems: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of word beginnings (toxic rows, weight) without those that a longer one with as many toxic rows explains."""
    explained = {s[:-1] for s, (n, w) in stems.items() if s[:-1] in stems and stems[s[:-1]][0] == n and stems[s[:-1]][1] <= w}
    return {s: w for s, (_, w) in stems.items() if s not in explained}


def unit_counts(sample: DataFrame) -> DataFrame:
    """unit, pos, neg: in how many toxic and other rows of the sample each unit stands; summed in tasks first."""
    schema = pa.schema([("unit", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

    def run(batches):
        claim(__name__)
        for part in slices(batches, 4 << 20):  # a part's units are counted in memory
            counts = {0: Counter(), 1: Counter()}
            for text, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts[y].update(units(text))
            # a unit of which this part has no toxic row matters only with those of other parts
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[y][k] for k in keys], pa.int64()) for y in (1, 0))], schema=schema)

    made = sample.select("text", "toxic").mapInArrow(run, "unit string, pos long, neg long")
    return made.groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0, steps: int = 30, stands_for: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's steps, drawn to the prior weights; no pattern may speak for a clean text.

    `stands_for`: how many rows each row stands for; 1 by default.
    """
    each = np.ones(len(x)) if stands_for is None else stands_for
    x1, sign = np.hstack([x, np.ones((len(x), 1))]), 1 - 2 * y
    at = mean = np.append(PRIOR, BIAS)

    def loss(w: np.ndarray) -> float:
        return float(each @ np.logaddexp(0, sign * (x1 @ w)) + strength / 2 * ((w - mean) ** 2).sum())

    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x1 @ at, -30, 30)))
        slope = x1.T @ (each * (p - y)) + strength * (at - mean)
        curve = (x1 * (each * p * (1 - p))[:, None]).T @ x1 + strength * np.eye(len(at))
        step, before = np.linalg.solve(curve, slope), loss(at)
        for halved in range(40):  # a full step may overshoot
            new = at - step / 2**halved
            new[:-1] = np.maximum(new[:-1], 0.0)
            if loss(new) < before:
                break
        else:
            break
        at = new
    return at[:-1], float(at[-1])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = 6000, least_share: float = 0.005, least_log_odds: float = LISTED, least_evidence: float = 11.0) -> Model:
    """A model from labelled rows.

    Labels with crc32(doc_id as text) mod 5 = 0 are held out; a document with several labels is toxic if one of them says so. Of the
    rest, the `per_class` rows of each class with the least hash of doc_id are the sample: a bound on the work and on what the driver
    gets (their patterns and the learned units), whatever the number of labels. In the fit, each row stands for all training
    labels of its class, so the weights and the bias hold for their natural shares. A unit is learned if it stands in `least_share`
    of the sample's toxic rows (3 at least), its smoothed log odds are `least_log_odds` or more, and its rows speak against chance by
    `least_evidence` nats (their number times the divergence of their toxic share from the sample's): of a million units that stand in
    rows at random, some twenty pass. Of a word beginning and a longer one in as many toxic rows, the longer one is learned. Null
    labels or ids are left out; without toxic labels the fixed lists and weights hold.
    """
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    every = dict(own.groupBy("toxic").count().collect())
    first = [own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(first[0].unionByName(first[1])), "doc_id").persist()  # 2 * per_class ids and labels
    try:
        n = dict(sample.groupBy("toxic").count().collect())
        n_pos, n_neg = n.get(1, 0), n.get(0, 0)
        counted = unit_counts(sample)
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        share, base = F.col("pos") / (F.col("pos") + F.col("neg")), n_pos / max(n_pos + n_neg, 1)
        rest = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - base))).otherwise(0.0) if base < 1 else F.lit(0.0)
        evidence = (F.col("pos") + F.col("neg")) * (share * F.log(share / F.lit(max(base, 1e-9))) + rest)
        chosen = counted.where(F.col("pos") >= max(3, least_share * n_pos)).withColumn("w", odds).where((F.col("w") >= least_log_odds) & (evidence >= least_evidence))
        rows = chosen.select("unit", "pos", "neg", "w").collect()  # bounded as the sample is
        seeds = dict.fromkeys(INSULTS, LISTED)
        lexicon = Lexicon(seeds | {r.unit[1:]: r.w for r in rows if r.unit[0] == "w"}, longest({r.unit[1:]: (r.pos, r.w) for r in rows if r.unit[0] == "s"}))
        seen = sample.select("text", "toxic").repartition(sample.sparkSession.sparkContext.defaultParallelism)
        fitted = map_columns(seen, {"text": "text", "toxic": "toxic"}, lambda texts, ys, g=Lazy(lexicon): {"x": [g.get().patterns(t) or [0.0] * SIZE for t in texts], "y": ys}, "x array<double>, y int").collect()
    finally:
        sample.unpersist()
    x, y = np.array([r.x for r in fitted]).reshape(-1, SIZE), np.array([r.y for r in fitted], dtype=float)
    times = [max(1.0, every.get(c, 0) / per_class) for c in (0, 1)]
    weights, bias = fit_weights(x, y, stands_for=np.where(y == 1, times[1], times[0]))
    return Model(lexicon, tuple(weights.tolist()), bias)


class Lazy:
    """A grammar that each task builds when it first needs it."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.made = lexicon, None

    def get(self) -> Grammar:
        if self.made is None:
            self.made = Grammar(self.lexicon)
        return self.made

    def __reduce__(self):
        return Lazy, (self.lexicon,)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and matches (patterns found) of whole texts.

    Null and empty texts match nothing and get the model's base score. Rows are independent, and so are null ids; an empty table gives no rows.
    """
    lazy = Lazy(model.lexicon)

    def run(ids, texts):
        found = [lazy.get().patterns(t) for t in texts]
        scores = [model.score(f) for f in found]
        return {"doc_id": ids, "score": scores, "predicted": [int(s >= 0.5) for s in scores], "matches": [f is not None for f in found]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_columns(docs, {"doc_id": id_col, "text": text_col}, run, f"doc_id {kind}, score double, predicted int, matches boolean")


def clean(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below 0.5, with all their columns; null and empty texts have the base score. An empty table stays empty."""
    lazy = Lazy(model.lexicon)

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        claim(__name__)
        return pd.Series([model.score(lazy.get().patterns(t)) for t in texts], dtype=float)

    return docs.where(scores(F.col(f"`{text_col}`")) < 0.5)
