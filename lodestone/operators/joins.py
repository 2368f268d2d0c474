"""Joins that equality alone does not express: substring pairs, domain suffixes, exclusion by several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import urls

#: Rows of a side that may be broadcast; larger sides take the equi-join way.
BROADCAST_ROWS = 20_000
GRAM = 3


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than that, and once for a DataFrame object."""
    known = getattr(df, "_lodestone_small", {})
    if rows not in known:
        known[rows] = df.limit(rows + 1).count() <= rows
        df._lodestone_small = known
    return known[rows]


def _grams(text: Column, up_to: int = GRAM) -> Column:
    """Distinct substrings of one to ``up_to`` characters."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*[of(n) for n in range(1, up_to + 1)]))


def contains_pairs(hay: DataFrame, hay_text: str, needles: DataFrame, needle_text: str, few: bool | None = None) -> DataFrame:
    """All pairs of rows whose ``needle_text`` is a non-empty part of ``hay_text``; column names must not clash.

    A small side of needles is broadcast and tested against each row. Beyond BROADCAST_ROWS the rows meet by the
    needle's first characters, an equi join, and are tested then. ``few`` tells what the caller has found out.
    """
    needles = needles.where(F.length(needle_text) > 0)
    test = F.contains(F.col(hay_text), F.col(needle_text))
    if small(needles) if few is None else few:
        return hay.join(F.broadcast(needles), test)
    keyed = needles.withColumn("_gram", F.left(F.col(needle_text), F.lit(GRAM)))
    return hay.withColumn("_gram", F.explode(_grams(F.col(hay_text)))).join(keyed, "_gram").where(test).drop("_gram")


def with_membership(df: DataFrame, ids: str, dimension: DataFrame, key: str) -> DataFrame:
    """Rows joined to every dimension row whose key is in the array ``ids``; unknown keys are skipped."""
    exploded = df.withColumn(key, F.explode(F.array_distinct(ids)))
    return exploded.join(F.broadcast(dimension) if small(dimension) else dimension, key)


def excluding(df: DataFrame, known: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows none of whose columns is known: an anti join for each (column, known column). Null values exclude nothing."""
    for own, other in pairs:
        keys = known.select(F.col(other).alias("_known")).where("_known is not null").distinct()
        df = df.join(keys, F.col(own) == F.col("_known"), "left_anti")
    return df


def catalogued(df: DataFrame, url: str, domains: DataFrame, domain: str, out: str = "catalogued") -> DataFrame:
    """Adds whether a url's domain is a known one or lies in one: an equi join on the domain's suffixes.

    ``df`` needs no key; each row stays one row.
    """
    known = domains.select(urls.domain(F.col(domain)).alias("_known")).where("_known <> ''").distinct()
    rows = df.withColumn("_domain", urls.domain(F.col(url)))
    hits = (
        rows.select("_domain").distinct().withColumn("_known", F.explode(urls.domain_suffixes(F.col("_domain"))))
        .join(known, "_known", "left_semi").select("_domain").distinct().withColumn(out, F.lit(True))
    )
    return rows.join(hits, "_domain", "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_domain")


def unknown_references(df: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """The distinct values of a column, or of its array elements, that the dimension does not have."""
    values = df.select(F.explode(column).alias(key)) if df.schema[column].dataType.typeName() == "array" else df.select(F.col(column).alias(key))
    return values.where(F.col(key).isNotNull()).distinct().join(dimension.select(key), key, "left_anti")


def ordered_pairs(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """All pairs of rows of a group, the earlier left: group columns, order_a, value_a, order_b, value_b.

    For groups bounded by their nature (samples of a recording, channels of a query).
    """
    side = lambda s: df.select(*group, F.col(order).alias(f"{order}_{s}"), F.col(value).alias(f"{value}_{s}"))
    return side("a").join(side("b"), group).where(F.col(f"{order}_a") < F.col(f"{order}_b"))
