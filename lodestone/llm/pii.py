"""Personal data: candidates from high-recall patterns, selected by gradient-boosted trees.

Base patterns (email, ip, card, phone) give spans that always stay. Further generators propose overlapping spans;
features of their form and of the text around them go to boosted trees, and thresholds calibrated for each
generator select. All of it is SQL expressions on the row of the document: no shuffle, no Python on executors.

The trees are fitted on the driver from synthetic labelled snippets (``TRAIN_SNIPPETS`` of them, from a seed), whose
features come from the same SQL expressions.

Null text counts as empty: no spans. A text of any length is searched whole, spans may have any length, and the work
is all but linear in a text and its matches. Repeated rows give equal spans; extra columns are kept; a column that has
the name of the result is an error.
"""

from __future__ import annotations

import json
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import free_name

BASE_KINDS = ("email", "ip", "card", "phone")
METHOD_KINDS = ("secret", "number", "contact", "iban", "ipv6")
KINDS = BASE_KINDS + METHOD_KINDS

# A match can only begin where a run of its first class begins or where the last match ended (\G); saying so, and
# taking runs possessively, finds the same matches in linear time. A card's run is tested whole.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SECRET_WORD = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|bearer|credential)"
PATTERNS = {
    # after a word for secrets; only in documents that have such a word
    "secret_named": rf"(?i)(?<={_SECRET_WORD}[\"']{{0,1}}[\x20\t]{{0,3}}[:=][\x20\t]{{0,3}}[\"']{{0,1}})[A-Za-z0-9_./+~-]{{6,512}}+",
    "secret_form": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+",
    "number": r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9])",
    "contact": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(](?:at|@)[\])]\x20?[a-z0-9-]++(?:\x20?(?:[\[(](?:dot|\.)[\])]|\.)\x20?[a-z0-9-]{2,}+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
}
KIND_OF = {"secret_named": "secret", "secret_form": "secret", "number": "number", "contact": "contact", "iban": "iban", "ipv6": "ipv6"}
GENERATORS = tuple(PATTERNS)
#: A generator's pattern is only tried in documents where this cheaper one is found.
GUARDS = {
    "email": "@",
    "phone": r"\+[0-9]",
    "ip": r"[0-9]\.[0-9]",
    "card": "[0-9]",
    "secret_named": rf"(?i){_SECRET_WORD}[\"']?[\x20\t]{{0,3}}[:=]",
    "secret_form": "[0-9]",
    "number": "[0-9]",
    "contact": r"(?i)[\[(](?:at|@)[\])]",
    "iban": "[A-Z]{2}[0-9]{2}",
    "ipv6": "[0-9A-Fa-f]:[0-9A-Fa-f]",
}
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 16


def _let(value: Column, use) -> Column:
    """``use(value)``, the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Elements that one step of a running value may copy.
RUN_BLOCK = 128


def _running(values: Column, op) -> Column:
    """For n integers from 0 on: n + 1 running values of ``op`` (sum or greatest), the first one 0. Long arrays in blocks, so n * sqrt(n) at the most."""

    def run(x: Column, start: Column) -> Column:
        return F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(op(F.element_at(acc, -1), v))))

    def blocks(x: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN_BLOCK).cast("int"))
        part = lambda b: F.slice(x, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK))
        tops = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), op))
        inner = lambda since: F.flatten(F.transform(numbers, lambda b: _let(run(part(b), F.get(since, b)), lambda r: F.slice(r, F.lit(2), F.size(r) - 1))))
        return _let(run(tops, F.lit(0)), lambda since: F.concat(F.array(F.lit(0)), inner(since)))

    return F.when(F.size(values) <= RUN_BLOCK, run(values, F.lit(0))).otherwise(blocks(values))


def matches(text: Column, pattern: str, guard: str, tag: str) -> Column:
    """All leftmost non-overlapping matches: array of (gen, start, end, s, before, after), in code points.

    The pieces between the matches give the positions and the context.
    """

    def located(pieces: Column, found: Column) -> Column:
        each = F.sequence(F.lit(0), F.size(found) - 1)
        steps = F.transform(each, lambda i: F.length(F.get(pieces, i)) + F.length(F.get(found, i)))
        span = lambda ends, i: F.struct(
            F.lit(tag).alias("gen"), (F.get(ends, i) + F.length(F.get(pieces, i))).alias("start"), F.get(ends, i + 1).alias("end"), F.get(found, i).alias("s"),
            F.right(F.get(pieces, i), F.lit(CONTEXT_BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(CONTEXT_AFTER)).alias("after"),
        )
        return _let(_running(steps, lambda x, y: x + y), lambda ends: F.transform(each, lambda i: span(ends, i)))

    def of(pieces: Column) -> Column:
        return F.when(F.size(pieces) > 1, _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: located(pieces, found)))

    searched = F.when(text.rlike(guard), _let(F.split(text, pattern, -1), of))
    return F.coalesce(searched, F.array().cast(_SPANS))


_SPANS = "array<struct<gen:string,start:int,end:int,s:string,before:string,after:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """Spans of the base kinds that pass their tests."""
    tests = {
        "email": lambda c: F.lit(True),
        "ip": lambda c: F.forall(F.split(c["s"], r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"\A(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z")),
        "card": lambda c: F.call_function("luhn_check", _digits(c["s"])),
        "phone": lambda c: F.length(_digits(c["s"])).between(10, 15),
    }
    return F.concat(*[F.filter(matches(text, BASE_PATTERNS[k], GUARDS[k], k), tests[k]) for k in BASE_KINDS])


def candidates(text: Column) -> Column:
    """What the generators propose, overlaps included."""
    return F.concat(*[matches(text, PATTERNS[g], GUARDS[g], g) for g in GENERATORS])


def _count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


#: Words of the text before (or right after) a candidate that speak for or against it.
CONTEXT_WORDS = {
    "secret_word": rf"(?i){_SECRET_WORD}",
    "phone_word": r"(?i)(?:phone|tel|call|mobile|fax|cell|whatsapp|sms|dial)",
    "money_word": r"(?i)(?:account|acct|card|iban|bank|visa|credit|debit|payment|swift)",
    "id_word": r"(?i)(?:ssn|social|passport|licen[cs]e no|insurance|national id|tax|patient|employee|member)",
    "plain_word": r"(?i)(?:version|isbn|order|page|section|commit|figure|sha|checksum|digest|model|part|rfc|issue|ticket|build|total|population|hash)",
}
FEATURES = (
    "gen", "length", "digits", "upper", "lower", "separators", "switches", "distinct", "luhn", "hex", "quoted",
    "assigned", "glued_before", "glued_after", "year", "unbroken", *CONTEXT_WORDS,
)


def features(c: Column) -> dict[str, Column]:
    """Numbers that describe a candidate's form and context."""
    s, before, after = c["s"], c["before"], c["after"]
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    gen = reduce(lambda acc, g: F.when(c["gen"] == g, F.lit(float(GENERATORS.index(g)))).otherwise(acc), GENERATORS, F.lit(-1.0))
    out = {
        "gen": gen,
        "length": F.length(s),
        "digits": _count(s, "[0-9]"),
        "upper": _count(s, "[A-Z]"),
        "lower": _count(s, "[a-z]"),
        "separators": _count(s, r"[^0-9A-Za-z]"),
        "switches": _count(s, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"),
        "distinct": F.size(F.array_distinct(F.split(s, ""))),
        "luhn": flag(F.call_function("luhn_check", _digits(s)) & (F.length(_digits(s)) >= 12)),
        "hex": flag(s.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")),
        "quoted": flag(before.rlike(r"[\"'`]\z") & after.rlike(r"\A[\"'`]")),
        "assigned": flag(before.rlike(r"[:=][\x20\t]{0,3}[\"'`]?\z")),
        "glued_before": flag(before.rlike(r"[0-9A-Za-z./_]\z")),
        "glued_after": flag(after.rlike(r"\A[0-9A-Za-z/_@]")),
        "year": flag(s.rlike(r"\A(?:19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}")),
        "unbroken": flag(s.rlike(r"\A[0-9]+\z")),
    }
    out |= {k: flag(before.rlike(p)) for k, p in CONTEXT_WORDS.items()}
    return {k: out[k].cast("double") for k in FEATURES}


# ---- boosted trees, fitted on the driver from a bounded table


TRAIN_SNIPPETS = 3_000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 24
#: Thresholds are the lowest whose picks are right this often on the snippets that are not trained on.
PRECISION = 0.97


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> tuple[float, list]:
    """Gradient boosting for the logistic loss: the start value and nested (feature, cut, low, high) or leaf values."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    at = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best = (1e-3, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for j in range(x.shape[1]) if left else ():
            for cut in cuts[j]:
                low = x[rows, j] <= cut
                n = low.sum()
                if 5 <= n <= len(rows) - 5:
                    a, b = rows[low], rows[~low]
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - total
                    if gain > best[0]:
                        best = (gain, (j, float(cut), a, b))
        if best[1] is None:
            value = round(rate * float(g[rows].sum() / (h[rows].sum() + 1)), 6)
            at[rows] += value
            return value
        j, cut, a, b = best[1]
        return (j, cut, grow(a, g, h, left - 1), grow(b, g, h, left - 1))

    forest = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        forest.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return start, forest


def tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        j, cut, low, high = tree
        tree = low if row[j] <= cut else high
    return tree


def tree_sql(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    j, cut, low, high = tree
    return F.when(f[FEATURES[j]] <= cut, tree_sql(low, f)).otherwise(tree_sql(high, f))


def snippets(n: int = TRAIN_SNIPPETS, seed: int = 7) -> list[dict]:
    """Synthetic labelled texts: the private pieces are known, look-alikes are not private."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "ti", "es", "or", "la", "que", "ein", "ció", "ou", "mi")) for _ in range(r.randint(1, 4)))
    words = lambda k: " ".join(word() for _ in range(k))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mixed = lambda k, a: "".join(r.choice(a) for _ in range(k))
    hexa, base64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

    def case() -> tuple[str, str, str, bool]:
        """Text before, piece, text after, private or not."""
        quote = r.choice(('"', "'", ""))
        kinds = (
            lambda: (f"{r.choice(('token', 'secret', 'password', 'api_key', 'TOKEN', 'access-key', 'pwd'))}{r.choice((' = ', '=', ': ', ':'))}{quote}", mixed(r.randint(8, 48), r.choice((hexa, hexa.upper(), base64))), quote, True),
            lambda: (r.choice(("bearer ", "key ", "")), mixed(r.randint(32, 64), r.choice((hexa, base64))), "", True),
            lambda: (r.choice(("call ", "tel ", "phone: ", "fax ", "mobile ")), f"{digits(3)}{r.choice('-. ')}{digits(3)}{r.choice('-. ')}{digits(4)}", "", True),
            lambda: (r.choice(("account ", "card ", "bank account: ", "")), digits(r.randint(13, 19)), "", True),
            lambda: (r.choice(("ssn ", "social security ", "national id ", "")), f"{digits(3)}-{digits(2)}-{digits(4)}", "", True),
            lambda: (r.choice(("iban ", "", "bank ")), f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)}", "", True),
            lambda: (r.choice(("write to ", "", "contact ")), f"{word()}.{digits(2)} {r.choice(('[at]', '(at)'))} {word()} {r.choice(('[dot]', '(dot)'))} com", "", True),
            lambda: (r.choice(("from ", "host ", "")), ":".join(mixed(4, hexa) for _ in range(8)), "", True),
            lambda: (r.choice(("version ", "build ", "release ")), f"{digits(2)}.{digits(2)}.{digits(4)}", "", False),
            lambda: ("", f"{r.choice(('19', '20'))}{digits(2)}-{digits(2)}-{digits(2)}", "", False),
            lambda: (r.choice(("isbn ", "ISBN: ")), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", "", False),
            lambda: (r.choice(("order ", "page ", "part ", "total ", "population ", "")), digits(r.randint(7, 10)), "", False),
            lambda: (r.choice(("commit ", "sha ", "checksum ", "digest ")), mixed(40, hexa), "", False),
            lambda: ("", f"{word()}-{word()}-{word()}{r.choice('-/_')}{word()}{digits(1)}{word()}{word()}", "", False),
            lambda: (f"/{word()}/", f"{word()}_{digits(4)}_{digits(2)}_{word()}{word()}{word()}", ".html", False),
            lambda: ("", f"{digits(2)} {digits(3)} {digits(2)} {digits(2)}", f" {digits(2)} {digits(3)}", False),
            lambda: (r.choice(("password: ", "token = ")), word() + word(), " " + word(), False),
            lambda: ("at ", ":".join(digits(2) for _ in range(4)), "", False),
        )
        return r.choice(kinds)()

    out = []
    for _ in range(n):
        lead, piece, tail, private = case()
        front = f"{words(r.randint(0, 8))}{r.choice((' ', '. ', ', ', chr(10)))}{lead}"
        out.append({"text": f"{front}{piece}{tail} {words(r.randint(0, 6))}", "start": len(front), "end": len(front) + len(piece), "private": private})
    return out


class Model:
    """The trees and each generator's threshold on their sum."""

    def __init__(self, start: float, forest: list, thresholds: dict[str, float]):
        self.start, self.forest, self.thresholds = start, forest, thresholds

    def score(self, f: Column) -> Column:
        return reduce(lambda a, t: a + tree_sql(t, f), self.forest, F.lit(self.start))

    def selects(self, gen: Column, score: Column) -> Column:
        return reduce(lambda acc, g: F.when(gen == g, score >= self.thresholds[g]).otherwise(acc), self.thresholds, F.lit(False))


_models: dict[tuple[int, int], Model] = {}


def fit(spark: SparkSession, n: int = TRAIN_SNIPPETS, seed: int = 7) -> Model:
    """The model of the synthetic snippets; fitted once in a process. The driver gets their candidates only."""
    if (n, seed) in _models:
        return _models[n, seed]
    rows = F.from_json(F.lit(json.dumps(snippets(n, seed))), "array<struct<text:string,start:int,end:int,private:boolean>>")
    table = spark.range(1).select(F.posexplode(rows).alias("row", "x")).select("row", "x.*")
    found = (
        table.select("row", F.col("start").alias("from"), F.col("end").alias("to"), "private", F.explode(candidates(F.col("text"))).alias("c"))
        .select("row", "from", "to", "private", F.col("c.start").alias("s"), F.col("c.end").alias("e"), *[v.alias(f"f_{k}") for k, v in features(F.col("c")).items()])
        .collect()
    )
    x = np.array([[r[f"f_{k}"] for k in FEATURES] for r in found])
    overlap = np.array([min(r["e"], r["to"]) - max(r["s"], r["from"]) for r in found])
    size = np.array([max(r["e"] - r["s"], r["to"] - r["from"]) for r in found])
    y = (np.array([r["private"] for r in found]) & (overlap >= 0.6 * size)).astype(float)
    test = np.array([r["row"] % 4 == 0 for r in found])
    start, forest = fit_trees(x[~test], y[~test])
    score = np.array([start + sum(tree_value(t, row) for t in forest) for row in x[test]])
    _models[n, seed] = Model(start, forest, thresholds(score, y[test], x[test, 0]))
    return _models[n, seed]


def thresholds(score: np.ndarray, y: np.ndarray, gen: np.ndarray, precision: float = PRECISION) -> dict[str, float]:
    """By generator, the lowest score from which on the picks are right often enough; none without such a score."""
    out = {}
    for i, g in enumerate(GENERATORS):
        s, t = score[gen == i], y[gen == i]
        # equal scores are picked together; an even chance is the least that is asked for
        good = [x for x in np.unique(s) if x >= 0 and t[s >= x].mean() >= precision]
        out[g] = round(float(min(good)) - 1e-6, 6) if good else 1e9
    return out


# ---- selection and redaction


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


_FOUND = "array<struct<start:int,kind:int,end:int,score:double>>"


def _islands(spans: Column, of) -> Column:
    """``of`` each group of spans that hang together by overlaps, in order; ``spans`` are sorted by start."""

    def cut(reach: Column) -> Column:
        # a group begins where a span starts at or after the end of all before it
        n = F.size(spans)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(spans, i)["start"] >= F.get(reach, i))
        upto = lambda b, k: F.coalesce(F.get(b, k + 1), n)
        return _let(begins, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 1), lambda k: _let(F.slice(spans, F.get(b, k) + 1, upto(b, k) - F.get(b, k)), of)))

    return _let(_running(F.transform(spans, lambda c: c["end"]), lambda x, y: F.greatest(x, y)), cut)


def with_spans(df: DataFrame, model: Model, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds ``out``: all spans as (start, kind number in KINDS, end, score), by start, then kind.

    Base spans may overlap each other. A selected span overlaps no base span and no selected one of a higher score;
    of equal scores the first one counts. A column named ``out`` is an error.
    """
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {out}")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    numbers = {k: KINDS.index(k) for k in BASE_KINDS} | {g: KINDS.index(k) for g, k in KIND_OF.items()}

    def kind(gen: Column) -> Column:
        return reduce(lambda acc, g: F.when(gen == g, F.lit(numbers[g])).otherwise(acc), numbers, F.lit(-1))

    def named(c: Column, score: Column) -> Column:
        return F.struct(c["start"].alias("start"), kind(c["gen"]).alias("kind"), c["end"].alias("end"), score.alias("score"))

    is_base = lambda c: c["gen"].isin(*BASE_KINDS)

    def chosen(group: Column) -> Column:
        kept = F.filter(group, is_base)
        base = F.transform(kept, lambda c: named(c, F.lit(None).cast("double"))).cast(_FOUND)
        free = F.filter(group, lambda c: ~is_base(c) & ~F.exists(kept, lambda b: _overlaps(b, c)))
        scored = F.transform(free, lambda c: _let(F.struct(*[v.alias(k) for k, v in features(c).items()]), lambda f: F.struct(
            (-model.score(f)).alias("order"), c["start"].alias("start"), c["end"].alias("end"), c["gen"].alias("gen"))))
        picked = F.array_sort(F.filter(scored, lambda c: model.selects(c["gen"], -c["order"])))
        picked = F.transform(picked, lambda c: named(c, -c["order"])).cast(_FOUND)
        best = F.aggregate(picked, F.array().cast(_FOUND), lambda acc, c: F.when(F.exists(acc, lambda b: _overlaps(b, c)), acc).otherwise(F.concat(acc, F.array(c))))
        return F.concat(base, F.when(F.size(free) == 0, F.array().cast(_FOUND)).otherwise(best))

    def sorted_by_start(found: Column) -> Column:
        by = F.transform(found, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["gen"].alias("gen"), c["s"].alias("s"), c["before"].alias("before"), c["after"].alias("after")))
        return F.array_sort(by)

    empty = F.array().cast(_FOUND)
    found = F.concat(base_spans(body), candidates(body))
    spans = _let(sorted_by_start(found), lambda a: F.when(F.size(a) == 0, empty).otherwise(F.flatten(_islands(a, chosen))))
    # documents without a digit, @ or a bracketed sign can hold nothing that any pattern finds, but for named secrets
    maybe = body.rlike(r"[0-9@:=\[(]")
    return df.withColumn(out, F.array_sort(F.coalesce(F.when(maybe, spans), empty)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"], c["end"])), ",")


def redact(df: DataFrame, model: Model | None = None, text: str = "text", n_chars: str | None = None) -> DataFrame:
    """The same rows and columns with ``<KIND>`` in place of each span; of overlapping spans, the first names the whole.

    A null text stays null. ``n_chars`` names a column that is set to the new length.
    """
    model = model or fit(df.sparkSession)
    names, spans = df.columns, free_name(df, "_spans")
    found = with_spans(df, model, text, spans)
    body = F.col(f"`{text}`").cast("string")
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    # overlapping spans are one: it has the name of the first and reaches to the last end
    whole = lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("start"), F.get(g, F.lit(0))["kind"].alias("kind"), F.array_max(F.transform(g, lambda c: c["end"])).alias("end"))
    merged = _islands(F.col(spans), whole)

    def rebuilt(m: Column) -> Column:
        """The text in parts of RUN_BLOCK spans, so that no part is looked for from the beginning of a long text."""

        def part(b: Column) -> Column:
            since = F.when(b > 0, F.get(m, b * RUN_BLOCK - 1)["end"]).otherwise(F.lit(0))
            until = F.get(m, F.least((b + 1) * RUN_BLOCK, F.size(m)) - 1)["end"]
            own = F.slice(m, b * RUN_BLOCK + 1, F.lit(RUN_BLOCK))
            gap = lambda t, s, x, i: F.concat(
                _let(F.when(i > 0, F.get(x, i - 1)["end"]).otherwise(s), lambda a: F.substr(t, a - s + 1, F.get(x, i)["start"] - a)), F.get(tags, F.get(x, i)["kind"]))
            joined = lambda t, s, x: F.array_join(F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: gap(t, s, x, i)), "")
            return _let(since, lambda s: _let(F.substr(body, s + 1, until - s), lambda t: _let(own, lambda x: joined(t, s, x))))

        numbers = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN_BLOCK).cast("int"))
        return F.concat(F.array_join(F.transform(numbers, part), ""), F.substr(body, F.element_at(m, -1)["end"] + 1))

    out = found.withColumn(text, F.when(F.size(spans) > 0, _let(merged, rebuilt)).otherwise(body))
    if n_chars:
        out = out.withColumn(n_chars, F.length(F.col(f"`{text}`")).cast("long"))
    return out.select(*[F.col(f"`{c}`") for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: spans and base counts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_spans(docs, fit(spark)).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda c: c["kind"] == k)).cast("long")
    base = F.filter("spans", lambda c: c["kind"] < len(BASE_KINDS))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )
