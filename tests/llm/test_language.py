"""Language identification against a plain version, and what is a letter."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from flowlens.llm import language_id
from flowlens.llm.queries import QUERIES

ORDERS = (4, 3, 2, 1)


def words(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def plain_model(labelled):
    """Tables ``key -> score of each language`` for words and for each length of n-grams."""
    languages = sorted({lang for _, lang in labelled})
    counts = {lang: Counter(w for text, x in labelled if x == lang for w in words(text)) for lang in languages}

    def scores(per):
        keys = {k for c in per.values() for k in c}
        total = {x: sum(per[x].values()) for x in languages}
        out = {}
        for k in keys:
            logs = [math.log((per[x][k] + .5) / (total[x] + .5 * len(keys))) for x in languages]
            out[k] = [v - sum(logs) / len(logs) for v in logs]
        return out

    grams = {}
    for n in ORDERS:
        per = {x: Counter() for x in languages}
        for x, c in counts.items():
            for w, times in c.items():
                for i in range(len(w) + 2 - n + 1):
                    per[x][f"<{w}>"[i:i + n]] += times
        grams |= scores(per)
    return languages, scores(counts), grams


def plain_predict(model, text):
    languages, known, grams = model
    total, found = [0.0] * len(languages), words(text)
    if not found or not languages:
        return "und", 0.0
    for w in found:
        score = known.get(w)
        if score is None:
            weight = language_id.BACKOFF
            for n in ORDERS:
                hits = [grams[g] for g in (f"<{w}>"[i:i + n] for i in range(len(w) + 2 - n + 1)) if g in grams]
                if hits:
                    score = [weight * sum(c) / len(hits) for c in zip(*hits)]
                    break
                weight *= language_id.BACKOFF
        total = [a + b for a, b in zip(total, score or [0.0] * len(languages))]
    best = max(range(len(languages)), key=lambda i: (total[i], -i))
    return languages[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_op1(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {r.doc_id: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    model = plain_model([(r.text, r.lang) for r in rows if r.lang and r.text is not None and not held[r.doc_id]])
    want = defaultdict(list)
    for r in rows:
        want[r.doc_id].append((held[r.doc_id], *plain_predict(model, r.text)))
    got = QUERIES["op1_language_id"](spark, tables).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(r.held_out == h and r.lang_pred == lang and r.score == pytest.approx(s, abs=2e-3) for h, lang, s in want[r.doc_id]), (r, want[r.doc_id])


def test_only_letters_make_words():
    model = language_id.LanguageModel(["en"], {}, np.zeros((0, 1), np.float32), {"<": 0}, np.zeros((1, 1), np.float32))
    for text in ("½ ½", "²", "Ⅷ ⑳", "٣٤", "𐄇 𐏒", "12_3", "", None, " \n", "!?"):
        assert model.predict(text) == ("und", 0.0)
    assert model.predict("x²")[0] == "en"
    for text in ("naïve²x½ Ⅷß 中文_ª", "plain words 12", "𝐛old 𐄇x 𐤀é²"):
        assert language_id.words_of(text) == regex.findall(r"\p{L}+", text)


def test_small_languages_keep_their_words(spark):
    """The table is shared equally: the frequent words of one language do not drive out those of another."""
    rows = [(k, " ".join(f"{'abcdefghij'[(k + j) % 10]}{'klmnopqrst'[j % 10]}big" for j in range(200)), "big") for k in range(50)] + [(99, "eins zwei drei", "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, max_words=6, max_ngrams=40)
    assert {"eins", "zwei", "drei"} <= set(model.words) and len(model.words) == 6
    assert model.predict("zwei eins")[0] == "small"
