"""Naive Bayes against a version with dictionaries, and texts longer than a piece."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid


def sequence(text):
    """Lower-case letters, with one space for each run of anything else that follows a letter."""
    out = []
    for c in text:
        if c.isalpha():
            out.append(c.lower() if len(c.lower()) == 1 else c)
        elif out and out[-1] != " ":
            out.append(" ")
    return out


def counts(text):
    s = sequence(text)
    return Counter("".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1))


def bucket(gram):
    m, h = langid._MULTIPLIERS, 0
    for c in gram:
        h = (h * m[0] + ord(c) * m[1]) % 2**64
    return ((h ^ h >> 29) * m[2] + len(gram) * m[0]) % 2**64 >> 64 - langid.BUCKET_BITS


def test_prediction_equals_naive_bayes_by_hand(spark):
    r = random.Random(3)
    words = {"en": "the of and house water".split(), "de": "der und nicht haus wasser".split(), "fr": "les des maison avec eau".split()}
    rows = []
    for i in range(60):
        lang = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[lang if r.random() < 0.8 else "en"]) for _ in range(r.randint(1, 4))), lang if i % 7 else None))
    rows += [(100, None, "en"), (101, "12 !?", "en"), (102, "", None), (103, "the WATER", None), (103, "the WATER", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where(~langid.held_out()))
    held = {x["doc_id"] for x in df.where(langid.held_out()).collect()}
    table, n = {}, Counter()
    for i, t, lang in rows:
        if i not in held and t is not None and lang is not None:
            n[lang] += 1
            own = table.setdefault(lang, Counter())
            for g, k in counts(t).items():
                own[bucket(g)] += k
    size = 1 << langid.BUCKET_BITS
    for x in langid.predict(df, model).collect():
        text = next(t for i, t, _ in rows if i == x["doc_id"])
        if not text or not any(c.isalpha() for c in text):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        log = {
            lang: math.log(n[lang] / sum(n.values()))
            + sum(k * math.log((table[lang][bucket(g)] + langid.SMOOTHING) / (sum(table[lang].values()) + size * langid.SMOOTHING)) for g, k in counts(text).items())
            for lang in table
        }
        best = max(sorted(log), key=log.get)
        total = sum(math.exp(v - log[best]) for v in log.values())
        assert x["score"] == pytest.approx(1 / total, rel=1e-3)
        assert x["lang_pred"] == best or 1 / total < 0.51


def test_cuts_lose_nothing(monkeypatch):
    r = random.Random(4)
    texts = ["".join(r.choice(("a", "B", "é", " ", "  ", "1", ". ", "ß", "日")) for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, "", "....", "a" * 99]
    whole = [Counter(bucket(g) for g in counts(t or "").elements()) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(langid, "PIECE_CHARS", size)
        got = [Counter() for _ in texts]
        for group in langid.pieces(texts):
            for piece, i, sign in group:
                for b in langid.grams([piece])[0].tolist():
                    got[i][b] += sign
        assert [Counter({k: v for k, v in c.items() if v}) for c in got] == whole


def test_long_text_counts_as_a_whole(spark):
    text = "häuser und wasser, " * 110_000
    b, _, _ = langid.grams([text])
    want = np.bincount(b, minlength=1 << langid.BUCKET_BITS)
    model = langid.fit(spark.createDataFrame([(1, text, "de")], "doc_id long, text string, lang string"))
    p = want + langid.SMOOTHING
    assert np.allclose(model.matrix[:, 0], np.log(p / p.sum()), atol=1e-6)


def test_sample_is_bounded_by_rows_not_by_texts(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one text for all").alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(df, max_rows=400)
    assert model.languages == ["en"]
    # every row has one x, and smoothing is known: the share of its bucket tells how many rows taught
    share = math.exp(model.matrix[bucket("x"), 0])
    grams = sum(counts("one text for all").values())
    size = (1 << langid.BUCKET_BITS) * langid.SMOOTHING
    taught = (share * size - langid.SMOOTHING) / (1 - share * grams)
    assert 300 < taught < 500
    with pytest.raises(ValueError):
        langid.predict(df, model, carry=("score",))
