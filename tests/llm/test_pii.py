"""Method spans against a plain Python version, long spans, and many matches in a text."""

import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from lodestone.llm import pii


def spans_of(spark, texts, model=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["spans"]] for x in pii.with_spans(df, model or pii.fit(spark)).collect()}


def luhn(d):
    return bool(d) and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_features(gen, s, before, after):
    count = lambda p, t=s: len(regex.findall(p, t))
    has = lambda p, t: float(bool(regex.search(p, t)))
    digits = regex.sub("[^0-9]", "", s)
    out = {
        "gen": float(pii.GENERATORS.index(gen)), "length": len(s), "digits": count("[0-9]"), "upper": count("[A-Z]"), "lower": count("[a-z]"), "separators": count("[^0-9A-Za-z]"),
        "switches": count("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), "distinct": len(set(s)), "luhn": float(luhn(digits) and len(digits) >= 12), "hex": has(r"\A(?:[0-9a-f]+|[0-9A-F]+)\Z", s),
        "quoted": float(bool(regex.search("[\"'`]\\Z", before)) and bool(regex.match("[\"'`]", after))), "assigned": has("[:=][\x20\t]{0,3}[\"'`]?\\Z", before),
        "glued_before": has(r"[0-9A-Za-z./_]\Z", before), "glued_after": has(r"\A[0-9A-Za-z/_@]", after), "year": has(r"\A(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}", s), "unbroken": has(r"\A[0-9]+\Z", s),
    }
    out |= {k: has(p, before) for k, p in pii.CONTEXT_WORDS.items()}
    return [float(out[k]) for k in pii.FEATURES]


def plain_spans(text, model, base):
    """The spans by direct search of each generator, and a greedy choice by score."""
    found = []
    for gen, p in pii.PATTERNS.items():
        if not regex.search(pii.GUARDS[gen], text):
            continue
        ms = list(regex.finditer(p, text))
        for i, m in enumerate(ms):
            since, until = ms[i - 1].end() if i else 0, ms[i + 1].start() if i + 1 < len(ms) else len(text)
            if any(m.start() < e and s < m.end() for s, _, e in base):
                continue
            row = plain_features(gen, m[0], text[since : m.start()][-pii.CONTEXT_BEFORE :], text[m.end() : until][: pii.CONTEXT_AFTER])
            score = model.start + sum(pii.tree_value(t, row) for t in model.forest)
            if score >= model.thresholds[gen]:
                found.append((-score, m.start(), m.end(), gen))
    out = list(base)
    chosen = []
    for _, a, b, gen in sorted(found):
        if not any(a < e and s < b for s, e in chosen):
            chosen.append((a, b))
            out.append((a, pii.KINDS.index(pii.KIND_OF[gen]), b))
    return sorted(out)


def test_method_spans_equal_a_plain_version(spark):
    r = random.Random(31)
    model = pii.fit(spark)
    glue = [" ", ", ", "\n", "", " x@y.example ", " 10.0.0.1 ", "; token: ", " +1 212 555 0199 "]
    texts = ["".join(x["text"] + r.choice(glue) for x in pii.snippets(r.randint(1, 6), seed=1000 + i)) for i in range(300)]
    got = spans_of(spark, texts)
    assert sum(k >= 4 for s in got.values() for _, k, _ in s) > 300
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t, model, [s for s in got[i] if s[1] < 4]), t


def test_long_spans_are_whole(spark):
    r = random.Random(32)
    key = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(5000))
    late = "x" * 70 + key[:200]
    texts = [f'api_key = "{key}" end', f"see {late} end", f"write to {'a' * 100}.{'b' * 30} [at] {'c' * 80} [dot] com now"]
    got = spans_of(spark, texts)
    assert got[0] == [(11, pii.KINDS.index("secret"), 5011)]
    df = spark.createDataFrame([(0, texts[0])], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == 'api_key = "<SECRET>" end'
    proposed = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", F.explode(pii.candidates(F.col("t"))).alias("c")).collect()
    assert any(x["i"] == 1 and x["c"]["s"] == late for x in proposed)
    assert any(x["i"] == 2 and x["c"]["gen"] == "contact" and x["c"]["s"].startswith("aaaa") for x in proposed)


def test_many_matches(spark):
    """A hundred thousand spans in a text, found and replaced in seconds."""
    pii.fit(spark)
    n = 100_000
    text = " ".join(f"a{i}@b.example tel 555-{i % 900 + 100:03d}-1234" for i in range(n // 2))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.perf_counter()
    out = pii.redact(df).first()["text"]
    took = time.perf_counter() - began
    assert out.count("<EMAIL>") == n // 2 and "@" not in out and out.endswith("-1234") != out.endswith(">")
    assert took < 60, took


def test_name_of_result(spark):
    with pytest.raises(ValueError):
        pii.with_spans(spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, spans int"), pii.fit(spark))
