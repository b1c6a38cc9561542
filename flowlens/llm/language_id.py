"""Language identification, word first.

A word known from training is scored by its log frequency in each language. An unseen word falls back
to the character n-grams it contains, the longest order that has a known one first. The
scores of all words of a text are summed; the softmax of the sums is the confidence.

Training counts words and n-grams in Spark. It may use a bounded sample of the labelled rows
(``rows_per_language``), and keeps the ``max_words`` and, for each order, the ``max_ngrams`` most
frequent entries. So the model has a proven size, and is what tasks receive. Prediction reads every whole text.

Defined results: text null or without a letter: ``und``, score 0. No training rows: every text is
``und``. Ties go to the language that sorts first. Columns of the input named like an output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_tasks, sample_share

#: Signs of the basic plane that count as word characters but are neither letters nor decimal digits, such as fractions and Roman numerals.
_SIGNS = "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: A word is a run of letters, here and in training: the plain case, all of the basic plane, and any text.
_ASCII, _BASIC, _OTHERS, _ANY = re.compile("[a-z]+"), re.compile(rf"[^\W\d_{_SIGNS}]+"), re.compile("[\U00010000-\U0010FFFF]"), regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_ASCII if text.isascii() else _ANY if _OTHERS.search(text) else _BASIC).findall(text)


ORDERS = (4, 3, 2, 1)
#: Each step of the fall-back counts less than the one before.
BACKOFF = 0.7
#: Unseen words whose scores a worker keeps; when it is full it starts anew.
MEMO = 200_000


@dataclass
class LanguageModel:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    ngrams: dict[str, int]
    ngram_scores: np.ndarray
    _memo: dict[str, int] = field(default_factory=dict)
    _extra: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "_memo": {}, "_extra": None}

    def unseen(self, word: str) -> np.ndarray:
        """Mean score of the longest known n-grams; a short word is padded, so its ends count."""
        padded, weight = f"<{word}>", BACKOFF
        for n in ORDERS:
            found = [k for k in (self.ngrams.get(padded[i:i + n]) for i in range(len(padded) - n + 1)) if k is not None]
            if found:
                return weight * self.ngram_scores[found].mean(axis=0)
            weight *= BACKOFF
        return np.zeros(len(self.languages), np.float32)

    def _of_unseen(self, words: list[str]) -> np.ndarray:
        """Summed scores of at most MEMO words; those met before are remembered."""
        memo = self._memo
        if self._extra is None:
            self._extra = np.zeros((2 * MEMO, len(self.languages)), np.float32)
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                self._extra[len(memo)] = self.unseen(w)
                memo[w] = len(memo)
        return self._extra[list(map(memo.__getitem__, words))].sum(axis=0, dtype=np.float64)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.languages:
            return "und", 0.0
        rows = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        total = self.word_scores[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        unseen = np.flatnonzero(rows < 0).tolist()
        for a in range(0, len(unseen), MEMO):
            total = total + self._of_unseen([words[i] for i in unseen[a:a + MEMO]])
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def _scores(counts: DataFrame, key: str, languages: list[str], most: int) -> tuple[dict[str, int], np.ndarray]:
    """Log frequencies per language of the frequent keys of ``counts(key, lang, n)``, less their mean over the languages, which changes no comparison and makes an unknown
    key worth nothing. Each language chooses an equal share of the ``most`` keys, so none loses its words to a larger one."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), key)
    chosen = counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most // len(languages)).select(key).distinct()
    counts = counts.join(chosen, key, "left_semi")
    per = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"l{i}") for i, x in enumerate(languages)]
    rows = counts.groupBy(key).agg(F.sum("n").alias("n"), *per).orderBy(F.desc("n"), key).collect()  # ``most`` at most
    if not rows:
        return {}, np.zeros((0, len(languages)), np.float32)
    c = np.array([r[2:] for r in rows], np.float64)
    logs = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * len(rows)))
    return {r[0]: i for i, r in enumerate(rows)}, (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)


def train(labelled: DataFrame, key: str = "doc_id", rows_per_language: int = 4_000, max_words: int = 60_000,
          max_ngrams: int = 20_000) -> LanguageModel:
    """Learn from ``labelled(key, text, lang)``. Of a language with more than ``rows_per_language`` rows, about
    so many are taken, chosen by a hash of the key. Runs jobs that count."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col(key).alias("k"), "text", "lang")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])
    rows = labelled.filter(sample_share(F.coalesce(F.col("k").cast("string"), F.lit(""))) < F.element_at(share, F.col("lang")))
    words = (rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
             .filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n")).cache())
    languages = sorted(sizes)
    known, known_scores = _scores(words, "word", languages, max_words)
    ngrams: dict[str, int] = {}
    scores = []
    for n in ORDERS:
        padded = F.concat(F.lit("<"), "word", F.lit(">"))
        gram = words.select("lang", "n", padded.alias("p")).filter(F.length("p") >= n).select(
            "lang", "n", F.explode(F.expr(f"transform(sequence(1, length(p) - {n - 1}), i -> substr(p, i, {n}))")).alias("gram"))
        index, table = _scores(gram.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram", languages, max_ngrams)
        ngrams |= {k: i + sum(map(len, scores)) for k, i in index.items()}
        scores.append(table)
    words.unpersist()
    return LanguageModel(languages, known, known_scores, ngrams, np.concatenate(scores))


def language(model: LanguageModel, spark, text: str = "text") -> Column:
    """A struct ``(lang_pred, score)`` for a text column."""
    python_tasks(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict.asNondeterministic()(F.col(text))  # so that a filter on the result does not evaluate it a second time


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_found", language(model, docs.sparkSession, text)).select(*kept, "_found.lang_pred", "_found.score")
