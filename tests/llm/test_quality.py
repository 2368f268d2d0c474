"""Verdicts against a plain version, long texts in arrays, rows of any shape."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import quality

DOCS = "doc_id long, text string, lang string"


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    return len({j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)})


@pytest.mark.parametrize("seed", range(4))
def test_repeats_in_arrays(seed, monkeypatch):
    r = random.Random(seed)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(0, 60))] for _ in range(200)]
    want = [brute_repeats(t) for t in texts]
    assert [quality.repeat_words(t) for t in texts] == want
    monkeypatch.setattr(quality, "MANY_WORDS", 5)
    assert [quality.repeat_words(t) for t in texts] == want


def plain_distance(counts, reference):
    total = max(sum(counts), 1)
    d = 0.0
    for c, q in zip(counts, reference):
        p = c / total
        m = (p + q) / 2
        d += (p * math.log2(p / m) if p > 0 else 0) + (q * math.log2(q / m) if q > 0 else 0)
    return math.sqrt(min(max(d / 2, 0), 1))


def test_kept_by_a_plain_version(spark):
    r = random.Random(7)
    words = "the of and to in lamp river stone quiet garden window letter morning paper house bridge that for with".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    rows = [(i, prose(r.randint(5, 400)), r.choice(["en", "en", None, "xx"])) for i in range(120)]
    rows += [(200 + i, "".join(r.choice("#*$%&|<> 0123456789=zq") for _ in range(r.randint(100, 900))), "en") for i in range(40)]
    rows += [(300 + i, " ".join(r.choice(["zork", "blat", "quux", "vim", "nerf"]) + str(r.randint(0, 999)) for _ in range(r.randint(30, 200))), "en") for i in range(40)]
    rows += [(400, None, "en"), (401, "", None), (402, prose(60), "en"), (402, prose(60), "en")]
    df = spark.createDataFrame(rows, DOCS)
    # references by hand
    sums: dict[str, list[list[float]]] = {}
    for _, t, lang in rows:
        base, classes, common = quality.features(t)
        if lang is not None and base[0] >= quality.MIN_WORDS:
            own = sums.setdefault(lang, [[0.0] * len(classes), [0.0] * len(common)])
            for k, h in enumerate((classes, common)):
                for i, c in enumerate(h):
                    own[k][i] += c / max(1, sum(h))
    refs = {x: [[v / sum(h) for v in h] for h in hs] for x, hs in sums.items()}

    def verdict(t, lang):
        (n, chars, _, _, repeats), classes, common = quality.features(t)
        if n < 10 or 100 * repeats > 20 * n:
            return False
        if n < quality.MIN_WORDS or chars < quality.MIN_CHARS:
            return True
        near = [lang] if lang in refs else sorted(refs)
        class_d = min(plain_distance(classes, refs[x][0]) for x in near)
        word_d = [plain_distance(common, refs[x][1]) for x in near]
        ref = refs[near[word_d.index(min(word_d))]][1]
        none = [1] + [0] * (len(common) - 1)
        limit = quality.MAX_WORD_SHARE * plain_distance(none, ref) if n * (1 - ref[0]) >= quality.EXPECTED_WORDS else 1.0
        wider = math.sqrt(max(1, quality.BOTH_WORDS / n))
        both = class_d > quality.BOTH_CLASS_DISTANCE * wider and min(word_d) > quality.BOTH_WORD_DISTANCE * wider
        return not (class_d > quality.MAX_CLASS_DISTANCE or min(word_d) > limit or both)

    want = sorted((i, verdict(t, lang)) for i, t, lang in rows)
    got = sorted((x["doc_id"], x["kept"]) for x in quality.judge(df).collect())
    assert got == want and 60 < sum(k for _, k in want) < 150
    kept = sorted(x["doc_id"] for x in quality.keep_good(df).collect())
    assert kept == sorted(i for i, k in want if k)


def test_rows_of_any_shape(spark):
    text = "the lamp of the river and the stone in a quiet garden to the morning " * 3
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (None, text + "x", None)], DOCS)
    df = df.withColumns({"row": F.lit(1), "kept": F.lit("mine"), "n_words": F.lit(None).cast("int"), "a b": F.array(F.lit(1)), "words": F.struct(F.lit(2).alias("x y"))})
    out = quality.keep_good(df, min_words=1000)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    assert quality.keep_good(df.limit(0)).count() == 0
    assert out.count() == sum(quality.verdict(x["text"], x["lang"], {}, quality.LIMITS | {"min_words": 1000}) for x in df.collect())
