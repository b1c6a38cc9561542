"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses. Each word of a clause is read by word-level transducers, which write a symbol with a weight:

- insult: words and word stems learned from labels, and a fixed list; weight = log odds,
- threat: verbs of harm; target: second and third persons; negation; reported speech: verbs and quotation marks.

The composed automaton walks the symbols of a clause. Its states remember what the next words act upon: after a
negation an insult counts little, after a verb of speech it is a quotation and counts less, next to a target it counts
more, and a threat counts only with a target after it. A matched clause scores what its best path collects; a
text's score is the logistic of the clauses' damped sum, with two numbers fitted on the labels.

Training counts words per document in Spark and may use a bounded sample of the labelled rows (``MAX_ROWS`` of a class); the lexicon holds at most
``max_entries`` entries. Scoring reads every whole text, one clause at a time.

Defined results: null or empty text scores like a text without matches. Without labels the fixed lists alone decide. Repeated rows
each get their score. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_tasks, sample_share

# Word lists of the grammar.
INSULTS = ("idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting dumb fool imbecile jerk "
           "bastard bitch asshole fuck fucking shit crap vermin retard clown liar coward").split()
THREATS = "kill murder destroy hurt beat shoot stab strangle burn smash punish hang".split()
TARGETS = "you your yours yourself u ur he him his she her they them their these those people all".split()
NEGATIONS = "not no never none neither nor without isn't aren't wasn't don't doesn't didn't won't can't".split()
REPORTS = "said says say called calls call wrote writes claimed claims reported reports quoted quote quotes alleged accused word".split()

CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»]")
#: Lengths of learned stems: words that begin alike are one entry.
STEMS = (4, 5, 6)
#: Most labelled rows of a class that training uses.
MAX_ROWS = 15_000
#: What context does to an insult's weight.
NEGATED, QUOTED, AIMED, FIXED_WEIGHT, THREAT_WEIGHT = 0.3, 0.5, 1.25, 3.0, 4.0
#: Words over which negation and a target act.
REACH = 3

PLAIN, NEGATION, REPORT, TARGET, THREAT, QUOTE = range(6)


@dataclass
class Grammar:
    """The transducers' tables and the logistic's two numbers."""

    lexicon: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 1.5
    offset: float = -3.0

    def __post_init__(self):
        self.symbols: dict[str, int] = {}
        for words, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), ('"“”«»', QUOTE)):
            self.symbols |= dict.fromkeys(words, symbol)
        self.known = dict.fromkeys(INSULTS, FIXED_WEIGHT) | self.lexicon

    def weight(self, word: str) -> float:
        """The insult transducer: a word's entry, else that of its longest known stem."""
        w = self.known.get(word)
        if w is None:
            w = 0.0
            for n in STEMS[::-1]:
                if len(word) >= n and (s := self.stems.get(word[:n])) is not None:
                    return s
        return w

    def clause(self, words: list[str]) -> float:
        """The weight of the path of one clause."""
        total = 0.0
        negated = aimed = threat = -10  # where the last word of the kind stood
        reported = quoted = False
        last_insult, last_gain = -10, 0.0
        for i, word in enumerate(words):
            symbol = self.symbols.get(word, PLAIN)
            if symbol == NEGATION:
                negated = i
            elif symbol == REPORT:
                reported = True
            elif symbol == QUOTE:
                quoted = not quoted
            elif symbol == TARGET:
                aimed = i
                if i - threat <= REACH:
                    total += THREAT_WEIGHT * self._context(i - negated <= REACH + 1, reported or quoted)
                    threat = -10
                if i - last_insult <= REACH:
                    total += (AIMED - 1) * last_gain
                    last_insult = -10
            elif symbol == THREAT:
                threat = i
            w = self.weight(word)
            if w:
                gain = w * self._context(i - negated <= REACH, reported or quoted)
                if i - aimed <= REACH:
                    gain *= AIMED
                    last_insult = -10
                else:
                    last_insult, last_gain = i, gain
                total += gain
        return total

    @staticmethod
    def _context(negated: bool, quoted: bool) -> float:
        return (NEGATED if negated else 1.0) * (QUOTED if quoted else 1.0)

    def evidence(self, text: str | None) -> float:
        """Sum of the three strongest clauses and the logarithm of what all others add, so that every matched clause counts but a long text of weak
        matches is not a strong one."""
        if not text:
            return 0.0
        best, rest = [0.0, 0.0, 0.0], 0.0
        for part in CLAUSE.split(text.lower()):
            words = TOKEN.findall(part)
            if words:
                s = self.clause(words)
                if s > best[0]:
                    best, s = sorted([s, *best[1:]]), best[0]
                rest += s
        return sum(best) + math.log1p(rest)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.evidence(text) + self.offset))))


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature, both classes weighing the same, by Newton steps."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    slope, offset = 0.5, -1.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - 0.05 * slope, (weight * (y - p)).sum() - 0.05 * offset])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.05, (v * x).sum()], [(v * x).sum(), v.sum() + 0.05]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + np.clip(step[0], -1, 1), offset + np.clip(step[1], -1, 1)
    return float(slope), float(offset)


#: An entry is taken if it is so many times as common in toxic texts, and the log likelihood ratio of its count is at least this.
RATIO, EVIDENCE = 4.5, 14.0


def _entries(each: DataFrame, n_toxic: int, n_clean: int, most: int, least: int) -> dict[str, float]:
    """Half the log odds of the ``e`` in ``each(e, toxic)`` that are clearly more common in toxic texts, at most 3."""
    counted = each.groupBy("e").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).filter(F.col("t") >= least)
    expected = (F.col("c") + 0.5) * (n_toxic / n_clean)
    ratio = (F.col("t") + 0.5) / expected
    evidence = F.col("t") * F.log(F.col("t") / expected) - (F.col("t") - expected)
    chosen = counted.filter((ratio >= RATIO) & (evidence >= EVIDENCE)).orderBy(F.desc(evidence), "e").limit(most)
    return {r.e: min(3.0, r.w / 2) for r in chosen.select("e", F.log(ratio).alias("w")).collect()}


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(text, toxic)`` of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks. Of more than ``max_rows`` ids of a class about that many
    are used, chosen by a hash, so the side that is broadcast is bounded. Of an id with several labels the largest counts."""
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, max_rows / sizes.get(1, 1))).otherwise(min(1.0, max_rows / sizes.get(0, 1)))
    chosen = known.filter(sample_share(F.col("doc_id")) < share)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def train(rows: DataFrame, max_entries: int = 5_000, least: int = 5) -> Grammar:
    """Learn from ``rows(text, toxic)``. An entry needs ``least`` toxic documents. Runs jobs that count; the fit sees counts of
    rounded evidence."""
    rows = rows.filter("text IS NOT NULL")
    n_toxic, n_clean = rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not n_toxic or not n_clean:
        return Grammar()
    words = rows.select("toxic", F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))

    limits = (n_toxic, n_clean, max_entries, least)
    lexicon = _entries(words.select("toxic", F.explode("w").alias("e")).filter("e != ''"), *limits)
    long_words = F.filter("w", lambda x: F.length(x) >= STEMS[0])
    stems = _entries(words.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(long_words, lambda x: F.filter(F.array(
        *[F.when(F.length(x) >= n, F.substring(x, 1, n)) for n in STEMS]), lambda s: s.isNotNull()))))).alias("e")), *limits)
    grammar = Grammar(lexicon, stems)
    python_tasks(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.evidence(t) for t in texts], dtype=float)

    found = rows.select("toxic", evidence("text").alias("x")).groupBy("toxic", F.round("x", 1).alias("x")).count().collect()
    x = np.repeat([r.x for r in found], [r["count"] for r in found])
    y = np.repeat([r.toxic for r in found], [r["count"] for r in found])
    slope, offset = _fit(x, y)
    return Grammar(lexicon, stems, slope, offset)


def judge(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    python_tasks(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        g = shared.value
        return pd.Series([g.score(t) for t in texts], dtype=float)

    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.withColumn("_score", score(F.col(text))).select(*kept, F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
