"""Column functions on text: normalisation, search units, versions, slugs, search terms."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that say nothing about an item.
GENERIC_UNITS = ("animation", "effect", "motion", "style", "ui", "动效", "动画", "效果", "风格")
#: Fixed patterns: runs of Latin search characters and of CJK characters.
LATIN_RUN = "[a-z0-9][a-z0-9.+#-]*"
CJK_RUN = "[\u3400-\u9fff]+"
#: Error messages that mean a page's content did not load.
ERROR_PATTERNS = (
    "(?i)error fetching data",
    "(?i)project[^\\n]*(?:not found|does not exist|unavailable)",
    "(?i)failed to load resource[^\\n]*(?:404|410)",
)
#: Spellings of slug parts that are not simply capitalised.
ACRONYMS = {"3d": "3D", "ui": "UI", "svg": "SVG", "ascii": "ASCII", "iphone": "iPhone"}


@F.pandas_udf(StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """Unicode NFKC, which Spark does not have; only needed where compatibility forms occur."""
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def normalize_text(value: Column, compatibility: bool = False) -> Column:
    """Lower case, white space runs as one space, trimmed; with ``compatibility``, NFKC first."""
    value = nfkc(value) if compatibility else value
    return F.trim(F.regexp_replace(F.lower(value), "(?U)[\\s\\x1c-\\x1f]+", " "))


def _bigrams(run: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(run, i, F.lit(2)))


def _runs(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def text_units(normalized: Column) -> Column:
    """Distinct Latin runs, and single characters and bigrams of CJK runs, of normalised text."""
    cjk = _runs(normalized, CJK_RUN)
    singles = F.flatten(F.transform(cjk, lambda r: F.split(r, "")))
    pairs = F.flatten(F.transform(F.filter(cjk, lambda r: F.length(r) > 1), _bigrams))
    return F.array_distinct(F.concat(_runs(normalized, LATIN_RUN), singles, pairs))


def lexical_units(normalized: Column) -> Column:
    """Distinct Latin runs of two characters or more, and CJK runs of two or more with their bigrams; no generic words."""
    latin = F.filter(_runs(normalized, LATIN_RUN), lambda r: F.length(r) >= 2)
    cjk = F.filter(_runs(normalized, CJK_RUN), lambda r: F.length(r) >= 2)
    pairs = F.flatten(F.transform(cjk, _bigrams))
    return F.array_except(F.concat(latin, cjk, pairs), F.array(*map(F.lit, GENERIC_UNITS)))


def contains_term(value: Column, term: Column) -> Column:
    """Whether the normalised term, if it has a character, is part of the normalised value; words do not count."""
    t = normalize_text(term)
    return (F.length(t) > 0) & F.contains(normalize_text(value), t)


def version_parts(version: Column) -> Column:
    """All runs of digits as numbers; an error if there are none."""
    parts = F.transform(_runs(version, "[0-9]+"), lambda p: p.cast("bigint"))
    return F.when(F.size(parts) == 0, F.raise_error(F.concat(F.lit("no number in version "), version)).cast("array<bigint>")).otherwise(parts)


def compare_versions(left: Column, right: Column) -> Column:
    """-1, 0 or 1; the shorter version counts as padded with zeros."""
    a, b = version_parts(left), version_parts(right)
    width = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), width - F.size(x)))
    return F.when(pad(a) < pad(b), F.lit(-1)).when(pad(a) > pad(b), F.lit(1)).otherwise(F.lit(0))


def slugify(value: Column, limit: int | None = 120) -> Column:
    """Lower-case letters and digits joined by single hyphens, cut after ``limit`` characters."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "\\A-+|-+\\z", "")
    return slug if limit is None else F.left(slug, F.lit(limit))


def slug_title(slug: Column, limit: int = 160) -> Column:
    """A slug's parts as words: known acronyms, otherwise a capital and then lower case."""
    acronyms = F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv])
    bare = F.regexp_replace(slug, "\\A[\"'()]+|[\"'()]+\\z", "")
    capital = lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substr(p, F.lit(2))))
    return F.left(F.array_join(F.transform(F.split(bare, "-"), lambda p: F.coalesce(F.element_at(acronyms, p), capital(p))), " "), F.lit(limit))


def search_terms(text: Column, pattern: str = "[a-z0-9][a-z0-9-]+", limit: int = 24) -> Column:
    """The first ``limit`` of the sorted distinct tokens of two characters or more."""
    tokens = F.filter(_runs(F.lower(text), pattern), lambda t: F.length(t) > 1)
    return F.slice(F.array_sort(F.array_distinct(tokens)), 1, limit)


def has_content_error(message: Column) -> Column:
    return reduce(lambda a, p: a | message.rlike(p), ERROR_PATTERNS, F.lit(False))


def query_variants(query: Column, groups: Column) -> Column:
    """The query and, if any, the query with each group's first term that has a Latin letter and is not in it.

    ``groups`` is an array of arrays of terms.
    """
    norm = normalize_text(query)
    fits = lambda t: normalize_text(t).rlike("[a-z]") & ~F.contains(norm, normalize_text(t))
    preferred = F.transform(groups, lambda terms: F.get(F.filter(terms, fits), F.lit(0)))
    terms = F.array_distinct(F.array_compact(preferred))
    return F.when(F.size(terms) > 0, F.array(query, F.concat(query, F.lit(" | "), F.array_join(terms, " ")))).otherwise(F.array(query))


#: Terms that tell a motion's direction, region and timing; the first that occurs decides.
INTENT_TERMS = {
    "dominant_direction": (
        ("up", ("向上", "上移", "上滑", "slide up", "move up", "rise")),
        ("down", ("向下", "下移", "下滑", "slide down", "move down", "drop")),
        ("left", ("向左", "左滑", "slide left", "move left")),
        ("right", ("向右", "右滑", "slide right", "move right")),
        ("mixed", ("扩散", "爆炸", "散开", "morph", "scatter", "expand")),
    ),
    "changed_region": (
        ("top", ("顶部", "顶栏", "header", "top")),
        ("bottom", ("底部", "底栏", "bottom", "tab bar")),
        ("left", ("左侧", "侧边栏", "sidebar", "left")),
        ("right", ("右侧", "right")),
        ("center", ("中央", "中心", "居中", "center", "modal")),
        ("full", ("全屏", "整页", "full screen", "page transition")),
    ),
    "timing_character": (
        ("front-loaded", ("快速开始", "迅速出现", "先快后慢", "snappy", "fast start")),
        ("rear-loaded", ("后段加速", "最后突然", "slow start")),
        ("peaked", ("弹性", "回弹", "bounce", "spring", "overshoot")),
        ("even", ("匀速", "均匀", "linear", "even")),
    ),
}


def motion_intent(query: Column) -> dict[str, Column]:
    """Direction, region and timing a query asks for, each null if no term of it is part of the query."""
    norm = F.regexp_replace(F.lower(query), "(?U)\\s+", " ")
    out = {}
    for field, choices in INTENT_TERMS.items():
        value = F.lit(None).cast("string")
        for name, terms in reversed(choices):
            value = F.when(reduce(lambda a, t: a | F.contains(norm, F.lit(t)), terms, F.lit(False)), F.lit(name)).otherwise(value)
        out[field] = value
    return out


def escape_markdown(label: Column) -> Column:
    """Backslashes and square brackets escaped."""
    return F.regexp_replace(label, "([\\\\\\[\\]])", "\\\\$1")


def escape_script(payload: Column) -> Column:
    """JSON text that can stand in an HTML script element."""
    return F.replace(payload, F.lit("</"), F.lit("<\\/"))


def display_title(title: Column, slug: Column, animation: Column, artboard: Column, fallback: Column, generic: tuple[str, ...]) -> Column:
    """The title unless it is a generic one; else the first telling one of the slug's words, the animation, the artboard."""
    from_slug = F.trim(F.replace(F.regexp_replace(F.coalesce(slug, F.lit("")), "\\A[0-9]+-[0-9]+-", ""), F.lit("-"), F.lit(" ")))
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    tells = lambda c: ~F.lower(c).isin(*generic)
    first = F.when(tells(plain(title)), plain(title))
    others = [F.when((c != "") & tells(c), c) for c in (from_slug, plain(animation), plain(artboard))]
    return F.left(F.coalesce(first, *others, fallback), F.lit(160))


def search_text(*fields: Column, tags: Column) -> Column:
    """All fields and tags, lower-cased, joined by spaces; missing fields are empty."""
    return F.lower(F.array_join(F.concat(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), F.coalesce(tags, F.array().cast("array<string>"))), " "))
