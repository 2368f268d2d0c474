"""The driver's tables seen as a catalog: items, taxonomy, sites, synonym groups and queries, in Spark and in DuckDB SQL.

``part`` gives the items, ``supplier`` the sites; taxonomy, groups and queries are a few stated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Items belong to the first so many sites; the other sites have none.
SITES = 10

_MOTIONS = (
    ("m-red", "color", ("red", "red tone"), ("crimson",), ("widget",), ("mount",), ("calm",), ("hue",), ("red", "warm"), ("editor",), ("Brand#1", "Brand#2")),
    ("m-blue", "color", ("blue",), ("azure", "blue tone"), ("bolt", "ring"), ("hover",), ("cold",), ("hue",), ("blue",), ("community",), ("Brand#3",)),
    ("m-small", "size", ("small",), ("tiny", "mini"), ("ring",), ("scroll",), ("calm", "light"), ("scale",), ("small", "economy"), ("editor", "community"), ("Brand#4", "Brand#5")),
    ("m-large", "size", ("large",), ("big",), ("gear",), ("loop",), ("heavy",), ("scale",), ("large", "promo"), ("asset-library",), ("Brand#6",)),
    ("m-turn", "shape", ("turning gear",), ("rotor",), ("gear", "widget"), ("click",), ("calm",), ("angle",), ("gear",), ("experimental",), ("Brand#7", "Brand#8")),
)
_MOTION_COLUMNS = ("motion_id", "category", "labels", "aliases", "targets", "triggers", "feel", "channels", "search_terms", "site_kinds", "stacks")
_GROUPS = (
    ("g-red", "mechanism", "core", ("red", "crimson", "rouge")),
    ("g-blue", "mechanism", "core", ("blue", "azure")),
    ("g-ring", "scene", "core", ("ring", "circle")),
    ("g-calm", "style", "preference", ("calm", "quiet")),
    ("g-brand", "platform", "compatibility", ("brand#4", "brand#5")),
)
_QUERIES = (
    (1, "red widget"), (2, "a calm blue ring"), (3, "small ring for brand#4"), (4, "crimson gear"), (5, "large economy bolt"), (6, "quiet circle"), (7, "nothing of this"), (8, "green medium"),
)
KINDS = ("editor", "community", "asset-library", "experimental", "code-library")


def _literal(values: tuple, columns: tuple[str, ...], spark: SparkSession) -> DataFrame:
    rows = []
    for row in values:
        cells = [F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for v in row]
        rows.append(F.struct(*[c.alias(n) for c, n in zip(cells, columns)]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def _sql_rows(values: tuple, columns: tuple[str, ...]) -> str:
    cell = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else (str(v) if isinstance(v, int) else f"'{v}'")
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in values)}) t({', '.join(columns)})"


def motions(spark: SparkSession) -> DataFrame:
    return _literal(_MOTIONS, _MOTION_COLUMNS, spark)


def groups(spark: SparkSession) -> DataFrame:
    return _literal(_GROUPS, ("group_id", "facet", "role", "terms"), spark)


def queries(spark: SparkSession) -> DataFrame:
    return _literal(_QUERIES, ("query_id", "query"), spark)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    ids = F.array(*[F.lit(m[0]) for m in _MOTIONS])
    return p.select(
        F.concat(F.lit("p-"), k.cast("string")).alias("item_id"), F.concat(F.lit("s-"), (k % SITES).cast("string")).alias("site_id"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://s"), (k % SITES).cast("string"), F.lit(".example.com/i/"), k.cast("string")).alias("url"), F.array(F.lower("p_type"), F.split("p_name", " ")[1]).alias("search_terms"),
        F.array("p_brand").alias("stacks"), F.get(F.array(*map(F.lit, ("mount", "hover", "click", "scroll", "loop"))), (F.col("p_size") % 5).cast("int")).alias("trigger_kind"),
        F.lit(None).cast("string").alias("target_hint"), F.array(F.get(ids, (k % 5).cast("int")), F.get(ids, ((k + F.col("p_size")) % 5).cast("int"))).alias("motion_ids"),
        F.when(k % 3 != 0, F.lit("2024-05-01")).alias("last_verified"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")), "yyyy-MM-dd").alias("last_check"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, KINDS)), (k % 5).cast("int"))
    return s.select(
        F.concat(F.lit("s-"), k.cast("string")).alias("site_id"), F.col("s_name").alias("name"), kind.alias("kind"), F.when(k % 7 == 0, F.lit("degraded")).otherwise(F.lit("active")).alias("status"),
        F.when(k % 4 == 0, F.array(F.lit("inspiration"))).otherwise(F.array(F.lit("snippet"), F.lit("inspiration"))).alias("capabilities"),
        F.array(F.concat(F.lit("Brand#"), (k % 9).cast("string")), F.when(k % 6 == 0, F.lit("agnostic")).otherwise(F.lit("Brand#2"))).alias("stacks"),
        F.when(k % 2 == 0, F.array(F.lit("calm"), F.lit("color"))).otherwise(F.array(F.lit("size"), F.lit("heavy"))).alias("tags"),
        F.when(k % 3 == 0, F.lit("explicit")).otherwise(F.lit("unclear")).alias("license_status"),
    )


_IDS = "[" + ", ".join(f"'{m[0]}'" for m in _MOTIONS) + "]"
#: The same tables as DuckDB common table expressions.
SQL = f"""
motions AS (SELECT * FROM {_sql_rows(_MOTIONS, _MOTION_COLUMNS)}),
syn AS (SELECT * FROM {_sql_rows(_GROUPS, ("group_id", "facet", "role", "terms"))}),
queries AS (SELECT * FROM {_sql_rows(_QUERIES, ("query_id", "query"))}),
items AS (SELECT 'p-' || p_partkey AS item_id, 's-' || (p_partkey % {SITES}) AS site_id, p_name AS title, 'https://s' || (p_partkey % {SITES}) || '.example.com/i/' || p_partkey AS url,
  [lower(p_type), string_split(p_name, ' ')[2]] AS search_terms, [p_brand] AS stacks, ['mount', 'hover', 'click', 'scroll', 'loop'][p_size % 5 + 1] AS trigger_kind,
  [{_IDS}[p_partkey % 5 + 1], {_IDS}[(p_partkey + p_size) % 5 + 1]] AS motion_ids, CASE WHEN p_partkey % 3 <> 0 THEN '2024-05-01' END AS last_verified,
  strftime(DATE '2024-01-01' + CAST(p_partkey % 90 AS INTEGER), '%Y-%m-%d') AS last_check FROM part),
sites AS (SELECT 's-' || s_suppkey AS site_id, s_name AS name, ['editor', 'community', 'asset-library', 'experimental', 'code-library'][s_suppkey % 5 + 1] AS kind,
  CASE WHEN s_suppkey % 7 = 0 THEN 'degraded' ELSE 'active' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN ['inspiration'] ELSE ['snippet', 'inspiration'] END AS capabilities,
  ['Brand#' || (s_suppkey % 9), CASE WHEN s_suppkey % 6 = 0 THEN 'agnostic' ELSE 'Brand#2' END] AS stacks,
  CASE WHEN s_suppkey % 2 = 0 THEN ['calm', 'color'] ELSE ['size', 'heavy'] END AS tags, CASE WHEN s_suppkey % 3 = 0 THEN 'explicit' ELSE 'unclear' END AS license_status
  FROM supplier)"""

_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"


def norm(expr: str) -> str:
    return _NORM.format(expr)


def units(expr: str) -> str:
    """Latin runs of normalised text; the driver's tables have no CJK text."""
    return f"list_distinct(regexp_extract_all({norm(expr)}, '[a-z0-9][a-z0-9.+#-]*'))"


def lexical(expr: str) -> str:
    return f"list_filter({units(expr)}, lambda u: length(u) >= 2 AND u NOT IN ('animation', 'effect', 'motion', 'style', 'ui'))"
