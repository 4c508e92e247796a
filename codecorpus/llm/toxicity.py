"""Operator 10: toxicity by a weighted finite-state pattern grammar.

Five weighted transducers read the words of a clause. The insult transducer
(a trie of learnt words and word stems) writes a word's weight on an insult
tape, the threat transducer (fixed verbs of harm) writes on a threat tape;
three more rescale both tapes by what they have read:

* target: fixed words of address; a clause with one strengthens insults and
  arms threats. Whether one follows is guessed at the clause's start and the
  guess has to come true, so the address may come last;
* negation: a fixed word damps what follows within three words;
* reported speech: a fixed verb of saying damps the rest of the clause.

The transducers are composed: a state of the grammar is one state of each, an
arc's factors are the products of theirs. Their factors are fitted with the
calibration on the training rows.

A clause scores what its composed path sums to; a document's evidence is the
sum over its matched clauses, turned into a score of 0 to 1 by a logistic
calibration. The insult arcs and the calibration are learnt from a bounded,
documented sample of labelled rows of the training fold. Every document is
scored on its whole text in one narrow pass, without a shuffle.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns, held_out

# The closed word classes of the grammar.
THREATS = frozenset("kill hurt destroy beat shoot stab burn punish töten schlagen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yourself he she they them him her du dich euch ihr sie tu te toi vous tú te usted".split())
NEGATIONS = frozenset("not never isn't aren't nobody nicht kein keine jamais nunca jamás".split())
REPORTS = frozenset("said says called reported quoted claimed sagte nannte disait appelé dijo llamó".split())

#: Class of a word, as bits.
THREAT, TARGET, NEGATION, REPORT = 1, 2, 4, 8
NEGATION_REACH = 3
#: Starting values of the fitted factors, and what the fit may choose from.
THREAT_WEIGHT, TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 3.0, 1.25, 0.5, 0.5
CHOICES = {"threat": (1.0, 2.0, 3.0, 4.5), "target": (1.0, 1.25, 1.5, 2.0), "negation": (0.1, 0.25, 0.5, 0.75),
           "report": (0.1, 0.25, 0.5, 0.75)}
STEM_LENGTHS = range(5, 11)

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE_END = re.compile(r"[.!?;:,\n]")


def word_class(word: str) -> int:
    return (THREAT * (word in THREATS) | TARGET * (word in TARGETS) | NEGATION * (word in NEGATIONS)
            | REPORT * (word in REPORTS))


@dataclass(frozen=True)
class Transducer:
    """A weighted transducer over word classes: ``step(state, word class)`` is
    the next state and the factors of the two tapes at this word. A path
    counts if it ends in one of ``finals``."""

    starts: tuple[int, ...]
    finals: frozenset[int]
    step: Callable[[int, int], tuple[int, float, float]]

    def __matmul__(self, other: "Transducer") -> "Transducer":
        """Composition: a pair of states, factors multiplied. States of the
        pair are numbered ``self`` * 64 + ``other``'s."""
        def step(state: int, word: int) -> tuple[int, float, float]:
            a, x, y = self.step(state // 64, word)
            b, u, v = other.step(state % 64, word)
            return a * 64 + b, x * u, y * v
        return Transducer(tuple(a * 64 + b for a in self.starts for b in other.starts),
                          frozenset(a * 64 + b for a in self.finals for b in other.finals), step)


def insults_and_threats(threat: float) -> Transducer:
    """The two tapes as the trie and the threat verbs write them."""
    return Transducer((0,), frozenset([0]), lambda state, word: (0, 1.0, threat if word & THREAT else 0.0))


def targets(factor: float) -> Transducer:
    """0: one will follow, 1: one was read, 2: none comes (threats are idle)."""
    def step(state: int, word: int) -> tuple[int, float, float]:
        if state == 2:
            return (3 if word & TARGET else 2), 1.0, 0.0
        if state == 3:
            return 3, 0.0, 0.0  # the guess was wrong
        return (1 if state or word & TARGET else 0), factor, 1.0
    return Transducer((0, 2), frozenset([1, 2]), step)


def negations(factor: float) -> Transducer:
    """The state counts the words that are still damped."""
    def step(state: int, word: int) -> tuple[int, float, float]:
        left = NEGATION_REACH + 1 if word & NEGATION else state
        f = factor if left else 1.0
        return max(0, left - 1), f, f
    return Transducer((0,), frozenset(range(NEGATION_REACH + 2)), step)


def reports(factor: float) -> Transducer:
    """1 from the verb of saying on."""
    def step(state: int, word: int) -> tuple[int, float, float]:
        after = 1 if word & REPORT else state
        f = factor if after else 1.0
        return after, f, f
    return Transducer((0,), frozenset([0, 1]), step)


@dataclass
class Grammar:
    """Learnt arcs (``=word`` for whole words, otherwise stems) with their
    weights, the fitted factors of the transducers, and the calibration of a
    document's features."""

    arcs: dict[str, float] = field(default_factory=dict)
    coef: tuple[float, ...] = (-4.0, 2.0, 1.0)
    factors: dict[str, float] = field(default_factory=lambda: {
        "threat": THREAT_WEIGHT, "target": TARGET_FACTOR, "negation": NEGATION_FACTOR, "report": REPORT_FACTOR})

    def automaton(self):
        """The trie of the insult arcs, and the threat verbs to find their clauses."""
        import ahocorasick
        a = ahocorasick.Automaton()
        for arc, weight in self.arcs.items():
            a.add_word(arc.removeprefix("="), (arc.removeprefix("="), arc.startswith("="), weight))
        for word in THREATS:
            if word not in a:
                a.add_word(word, (word, True, 0.0))
        a.make_automaton()
        return a

    def composed(self) -> "Clauses":
        f = self.factors
        return Clauses(insults_and_threats(f["threat"]) @ targets(f["target"]) @ negations(f["negation"]) @ reports(f["report"]))


class Clauses:
    """The composed grammar; arcs that were walked are remembered."""

    def __init__(self, grammar: Transducer):
        self.grammar, self.arcs = grammar, {}

    def score(self, words: list[int], weights: dict[int, float]) -> float:
        """Best accepted path over a clause, given as word classes; ``weights``
        holds the insult weight of each matching word's position."""
        best = 0.0
        for state in self.grammar.starts:
            total = 0.0
            for i, word in enumerate(words):
                arc = self.arcs.get((state, word))
                if arc is None:
                    arc = self.arcs[state, word] = self.grammar.step(state, word)
                state, insult, threat = arc
                total += weights.get(i, 0.0) * insult + threat
            if state in self.grammar.finals:
                best = max(best, total)
        return best


def clauses(text: str | None, automaton) -> list[tuple[list[int], dict[int, float]]]:
    """The clauses of a whole text that hold a match: word classes, and the
    insult weight of each matching word's position."""
    if not text:
        return []
    low = text.lower()
    best: dict[int, float] = {}
    n = len(low)
    for end, (pattern, whole, weight) in automaton.iter(low):
        start = end - len(pattern) + 1
        if start and (low[start - 1].isalnum() or low[start - 1] == "'"):
            continue
        if whole and end + 1 < n and low[end + 1].isalnum():
            continue
        best[start] = max(best.get(start, 0.0), weight)
    out, done = [], -1
    for start in sorted(best):
        if start < done:
            continue
        left = start
        while left and not _CLAUSE_END.match(low[left - 1]):
            left -= 1
        end_match = _CLAUSE_END.search(low, start)
        done = end_match.start() if end_match else n
        words, weights = [], {}
        for i, m in enumerate(_WORD.finditer(low, left, done)):
            words.append(word_class(m.group()))
            if best.get(m.start()):
                weights[i] = best[m.start()]
        out.append((words, weights))
    return out


def evidence(text: str | None, automaton, grammar: Clauses) -> tuple[float, float]:
    """(summed, largest) clause score of one whole text; (0, 0) without a
    match."""
    found = [grammar.score(*c) for c in clauses(text, automaton)]
    return sum(found), max(found, default=0.0)


def features(total: float, strongest: float) -> list[float]:
    """Constant, summed evidence and the strongest clause, both damped."""
    return [1.0, math.log1p(total), math.log1p(strongest)]


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - l2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _cover(docs: list[list[int]], weights: list[float], least: int, demand: int = 6) -> list[int]:
    """Greedy multi-cover: keep the arcs that explain the toxic training
    texts, each text asking for ``demand`` matches; arcs that only repeat
    what others explain (words of one copied text) are left out."""
    left = [demand] * len(docs)
    by_arc: dict[int, list[int]] = {}
    for d, arcs in enumerate(docs):
        for a in arcs:
            by_arc.setdefault(a, []).append(d)
    kept: list[int] = []
    while by_arc:
        gains = {a: sum(left[d] > 0 for d in ds) for a, ds in by_arc.items()}
        top = max(gains, key=lambda a: (gains[a], weights[a], -a))
        if gains[top] < least:
            break
        kept.append(top)
        for d in by_arc.pop(top):
            left[d] -= 1
        by_arc = {a: ds for a, ds in by_arc.items() if gains[a] >= least}
    return kept


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_labelled: int = 20_000, max_arcs: int = 1_500, min_support: int = 3,
          seed: int = 0) -> Grammar:
    """Learn the insult arcs and the calibration.

    Only rows outside the held-out fold are read, at most ``max_labelled``
    of them (smallest seeded hash of the id); a document with contradicting
    labels counts as toxic. Arcs are whole words and stems of 5 to 10
    letters, weighted by the lower bound of their log odds between toxic and
    clean texts (equal texts count once); at most ``max_arcs`` candidates, the
    heaviest, reach the driver. An arc stays if it covers ``min_support`` texts
    that others leave open, at every size of the sample. An id with several
    texts is one row, its smallest text. Without toxic and clean rows the grammar has no arcs
    and the calibration stays at its default."""
    spark = documents.sparkSession
    marks = (columns(labels, _id=id_col, _y=label_col).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
             .where(~held_out("_id")).groupBy("_id").agg(F.max("_y").cast("int").alias("_y")))
    marks = bounded_sample(marks, "_id", max_labelled, seed)
    docs = columns(documents, _id=id_col, _text=text_col).where(F.col("_text").isNotNull())
    train = docs.join(F.broadcast(marks), "_id").groupBy("_id").agg(F.min("_text").alias("_text"), F.first("_y").alias("_y"))
    words = (train.select("_y", F.lower("_text").alias("_t"))
             .groupBy("_t").agg(F.max("_y").alias("_y"))
             .select("_y", F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
                     .alias("_w"))
             .groupBy("_w").agg(F.sum("_y").alias("_n1"), F.sum(1 - F.col("_y")).alias("_n0")))
    stems = F.transform(F.filter(F.array(*[F.lit(k) for k in STEM_LENGTHS]), lambda k: k <= F.length("_w")),
                        lambda k: F.substring(F.col("_w"), F.lit(1), k))
    arcs = (words.select(F.explode(F.concat(F.array(F.concat(F.lit("="), F.col("_w"))), stems)).alias("arc"),
                         "_n1", "_n0")
            .groupBy("arc").agg(F.sum("_n1").alias("n1"), F.sum("_n0").alias("n0"))
            .where(F.col("n1") >= min_support))
    sizes = words.agg(F.sum("_n1"), F.sum("_n0")).first()
    if not sizes or not sizes[0] or not sizes[1]:
        return Grammar()
    odds = (F.log((F.col("n1") + 0.5) / F.lit(float(sizes[0]))) - F.log((F.col("n0") + 0.5) / F.lit(float(sizes[1])))
            - 1.64 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5)))
    top = (arcs.withColumn("w", odds).where(F.col("w") >= 1.5)
           .orderBy(F.desc("w"), F.desc("n1"), "arc").limit(max_arcs).collect())
    names, weights = [r["arc"] for r in top], [float(r["w"]) for r in top]
    grammar = Grammar(dict(zip(names, weights)))
    index = {a: i for i, a in enumerate(names)}

    def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in b["_text"]:
                ws = set(_WORD.findall(t.lower()))
                found.append(sorted({index[a] for w in ws for a in (f"={w}", *(w[:k] for k in STEM_LENGTHS))
                                     if a in index}))
            yield pd.DataFrame({"_t": b["_text"], "a": found})

    toxic = [r["a"] for r in train.where("_y = 1").mapInPandas(matches, "_t string, a array<int>")
             .dropDuplicates(["_t"]).select("a").collect()]
    kept = _cover(toxic, weights, min_support)
    grammar.arcs = {names[i]: weights[i] for i in kept}
    # the sample's matched clauses, a bounded number of rows; all fits run on them
    rows = train.mapInPandas(_matched(grammar), "_y int, found string").collect()
    found = [[(c, {int(i): w for i, w in x.items()}) for c, x in json.loads(r["found"])] for r in rows]
    y = np.array([r["_y"] for r in rows], float)
    if 0 < y.sum() < len(y):
        fit_factors(grammar, found, y)
    return grammar


def fit_factors(grammar: Grammar, found: list[list], y: np.ndarray, gain: float = 1.0) -> None:
    """Factors and calibration by the likelihood of the training labels: one
    factor after the other takes the choice that raises it most, if by more
    than ``gain``."""
    def fitted(factors: dict[str, float]) -> tuple[float, np.ndarray]:
        composed = Grammar(factors=factors).composed()
        sums = [[composed.score(*c) for c in one] for one in found]
        x = np.array([features(sum(v), max(v, default=0.0)) for v in sums])
        w = logistic(x, y)
        z = np.clip(x @ w, -30, 30)
        return float((y * z - np.log1p(np.exp(z))).sum()), w
    best, coef = fitted(grammar.factors)
    for name, choices in CHOICES.items():
        tried = [(fitted({**grammar.factors, name: c}), c) for c in choices if c != grammar.factors[name]]
        (value, w), choice = max(tried, key=lambda t: t[0][0])
        if value > best + gain:
            best, coef = value, w
            grammar.factors = {**grammar.factors, name: choice}
    grammar.coef = tuple(float(v) for v in coef)


def _matched(grammar: Grammar):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = grammar.automaton()
        for b in batches:
            yield pd.DataFrame({"_y": b["_y"], "found": [json.dumps(clauses(t, automaton)) for t in b["_text"]]})
    return run


def scores(documents: DataFrame, grammar: Grammar, text_col: str = "text", name: str = "toxicity") -> DataFrame:
    """``documents`` with a ``name`` column: the toxicity of each whole text
    from 0 to 1. Null and empty texts score like a text without a match."""
    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, composed = grammar.automaton(), grammar.composed()
        for s in texts:
            x = np.array([features(*evidence(t, automaton, composed)) for t in s]).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ np.array(grammar.coef), -30, 30))))
    return documents.withColumn(name, score(F.col(text_col)))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = 0.7, **learning) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Repeated rows are scored each; a null id is not held out; an empty table
    gives no rows; extra columns are ignored."""
    grammar = learn(documents, labels, id_col, text_col, **learning)
    docs = columns(documents, doc_id=id_col, _text=text_col)
    return (scores(docs, grammar, "_text", "score")
            .select("doc_id", held_out("doc_id").alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
