"""Readers of catalogs: JSON objects, JSON lines with per-row errors, sitemaps, page links, landed API pages, vectors."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StringType, StructType

SITES = """id STRING, name STRING, status STRING, auth STRING, kind STRING, homepage STRING,
 routes STRUCT<search: STRING, examples: STRING, blocks: STRING, source: STRING, categories: MAP<STRING, STRING>>,
 capabilities ARRAY<STRING>, stacks ARRAY<STRING>, tags ARRAY<STRING>, license STRUCT<status: STRING, url: STRING>,
 added_at STRING, last_shallow_check STRING, last_deep_review STRING, access_notes STRING"""
MOTIONS = """id STRING, category STRING, labels ARRAY<STRING>, aliases ARRAY<STRING>, targets ARRAY<STRING>, triggers ARRAY<STRING>,
 feel ARRAY<STRING>, channels ARRAY<STRING>, search_terms ARRAY<STRING>, site_kinds ARRAY<STRING>, stacks ARRAY<STRING>"""
EXAMPLES = """id STRING, site_id STRING, title STRING, url STRING, preview_url STRING, link_scope STRING, motion_ids ARRAY<STRING>, stacks ARRAY<STRING>,
 preview_strategy STRING, trigger STRUCT<kind: STRING, target_hint: STRING, settle_ms: INT, reset_hint: STRING>,
 capture STRUCT<recommended_evidence: STRING, frame_labels: ARRAY<STRING>, clip_seconds: INT>, rights STRUCT<status: STRING, note: STRING>,
 search_terms ARRAY<STRING>, source_evidence STRUCT<kind: STRING, official_media_url: STRING, runtime_file_url: STRING, width: DOUBLE, height: DOUBLE,
 media_range_verified_at: STRING, runtime_range_verified_at: STRING, sitemap_url: STRING, index_url: STRING, discovered_at: STRING, ranking: STRING>,
 verification STRUCT<kind: STRING, verified_at: STRING, changed_pixel_ratio: DOUBLE, mean_absolute_difference: DOUBLE, target_kind: STRING,
 target_confidence: STRING, unique_frame_hashes: INT, running_animations: INT, video_advanced: BOOLEAN>, last_shallow_check STRING, last_verified STRING"""
GROUPS = "id STRING, facet STRING, role STRING, terms ARRAY<STRING>"


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row of a whole-file JSON object."""
    return spark.read.schema(schema).json(path, multiLine=True)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """The sites of a site catalog, with its version."""
    top = json_object(spark, path, f"schema_version INT, catalog_version STRING, generated_at STRING, sites ARRAY<STRUCT<{_struct(SITES)}>>")
    return top.select("schema_version", "catalog_version", F.inline("sites"))


def groups(spark: SparkSession, path: str) -> DataFrame:
    """Synonym groups, as scoring.requested_groups takes them."""
    top = json_object(spark, path, f"schema_version INT, groups ARRAY<STRUCT<{_struct(GROUPS)}>>")
    return top.select(F.inline("groups")).withColumnRenamed("id", "group_id")


def _struct(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines without error handling."""
    return spark.read.schema(schema).json(path)


def checked_lines(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line, columns) and errors (file, line, error) of JSON lines.

    Blank lines are skipped. A line that is no JSON object, or misses a required field, is an error and no row. Files
    are read in splits; lines are counted by split first, and the counts before a split number its lines.
    """
    split = ["file", "block"]
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.rtrim("value").alias("value"))
    sums = rows.groupBy(*split).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = rows.join(sums.withColumn("before", before).drop("n"), split).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line"), "value")
    return split_checked(lines.where("trim(value) <> ''"), schema, required)


def split_checked(lines: DataFrame, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parses ``value`` of rows (file, line, value); see checked_lines."""
    parsed = lines.withColumn("row", F.from_json("value", F.lit(schema), {"mode": "PERMISSIVE"}))
    keys = F.json_object_keys("value")
    missing = F.array_except(F.array(*map(F.lit, sorted(required))), F.coalesce(keys, F.array().cast("array<string>")))
    error = (
        F.when(F.get_json_object("value", "$").isNull(), F.lit("invalid JSON")).when(~F.ltrim("value").startswith("{"), F.lit("not an object"))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    )
    judged = parsed.withColumn("error", error)
    return judged.where("error is null").select("file", "line", "row.*"), judged.where("error is not null").select("file", "line", "error")


def sitemap_urls(df: DataFrame, xml: str = "xml") -> DataFrame:
    """One row for each location of landed sitemaps or sitemap indexes, in order: the other columns, ``pos``, ``loc``."""
    rest = [c for c in df.columns if c != xml]
    return df.select(*rest, F.posexplode(F.xpath(F.col(xml), F.lit("//loc/text()")))).select(*rest, "pos", F.trim("col").alias("loc")).where("loc <> ''")


#: Quoted link targets; script bodies and comments go first.
_HIDDEN = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->"
_HREF = "(?i)<a\\s[^>]*?href\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)')"


def links(df: DataFrame, html: str = "html") -> DataFrame:
    """One row for each link with a quoted target, in document order: the other columns, ``pos``, ``href``. Stays in the JVM."""
    rest = [c for c in df.columns if c != html]
    clean = F.regexp_replace(F.col(html), _HIDDEN, " ")
    both = F.zip_with(F.regexp_extract_all(clean, F.lit(_HREF), F.lit(1)), F.regexp_extract_all(clean, F.lit(_HREF), F.lit(2)), lambda a, b: F.when(a != "", a).otherwise(b))
    return df.select(*rest, F.posexplode(both)).select(*rest, "pos", F.col("col").alias("href"))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


@F.pandas_udf(ArrayType(StringType()))
def exact_links(pages: pd.Series) -> pd.Series:
    """Link targets by an HTML parser: unquoted ones and character references too."""

    def of(page):
        parser = _Links()
        parser.feed(page or "")
        parser.close()
        return parser.found

    return pages.map(of)


#: Texts of pages that stand in for the one asked for.
RESTRICTION_MARKERS = {
    "alibaba-domain-block": "<title>域名拦截</title>",
    "alibaba-policy-block": "域名不在安全策略默认允许的范围内",
    "alibaba-verification-block": "长期未使用或首次查看拦截详情时",
}


def restriction_marker(body: Column) -> Column:
    """The name of the first marker that the body's first 32 KB hold, or null."""
    head = http_body(body.cast("binary"))
    return F.coalesce(*[F.when(F.contains(head, F.lit(m).cast("binary")), F.lit(name)) for name, m in RESTRICTION_MARKERS.items()])


def http_checks(landed: DataFrame) -> DataFrame:
    """Adds ``http_state`` and ``restriction`` to landed fetches (url, final_url, status, body)."""
    from lodestone.operators.curation import http_state

    rows = landed.withColumn("restriction", restriction_marker(F.col("body")))
    return rows.withColumn("http_state", http_state(F.col("status"), F.col("url"), F.col("final_url"), F.col("restriction").isNotNull()))


def route_urls(sites: DataFrame) -> DataFrame:
    """Rows (site_id, route, url): homepage, every route and every category route of each site."""
    routes = F.array(
        F.struct(F.lit("homepage").alias("route"), F.col("homepage").alias("url")),
        *[F.struct(F.lit(r).alias("route"), F.col(f"routes.{r}").alias("url")) for r in ("search", "examples", "blocks", "source")],
    )
    named = F.transform(F.map_entries(F.coalesce(F.col("routes.categories"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.concat(F.lit("categories."), e["key"]).alias("route"), e["value"].alias("url")))
    return sites.select(F.col("id").alias("site_id"), F.explode(F.concat(routes, named)).alias("r")).select("site_id", "r.*").where("url is not null")


def api_records(pages: DataFrame, rows: str = "items", target: int | None = None) -> DataFrame:
    """Rows of landed API pages (page_no, cursor, items) up to the first page that is empty or repeats a cursor, and ``target`` rows.

    The stop is one number, read before; sizes are summed by runs of pages, so that no task gets the items of all.
    """
    from lodestone.sources.records import taken

    first = pages.groupBy("cursor").agg(F.min("page_no").alias("first"))
    over = pages.select("page_no", "cursor", F.size(rows).alias("n")).join(first, "cursor").where((F.col("n") == 0) | (F.col("page_no") > F.col("first")))
    stop = over.agg(F.min("page_no")).first()[0]
    good = pages if stop is None else pages.where(F.col("page_no") < stop)
    if target is not None:
        return taken(good, target, items=rows)
    return good.select("page_no", F.posexplode(rows).alias("pos", "item"))


def visual_index(spark: SparkSession, path: str, metadata: DataFrame | None = None) -> DataFrame:
    """Vectors (case_id, region, frame_idx, embedding) in Parquet; checked: unique frames, one length, known cases."""
    rows = spark.read.schema("case_id STRING, region STRING, frame_idx INT, embedding ARRAY<FLOAT>").parquet(path)
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct("case_id", "region", "frame_idx").alias("d"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if facts["n"] != facts["d"] or facts["lo"] != facts["hi"]:
        raise ValueError("the index has repeated frames or vectors of different lengths")
    if metadata is not None:
        ids = rows.select("case_id").distinct()
        other = metadata.select(F.col("id").alias("case_id")).distinct()
        if not ids.join(other, "case_id", "left_anti").isEmpty() or not other.join(ids, "case_id", "left_anti").isEmpty():
            raise ValueError("index and metadata have different cases")
    return rows


class PagedFiles(DataSource):
    """A source of API pages, a partition each. Format name ``paged_files``; the option ``pages`` is a JSON array of pages (cursor, items)."""

    @classmethod
    def name(cls) -> str:
        return "paged_files"

    def schema(self) -> str:
        return "page_no INT, cursor STRING, items ARRAY<STRING>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(json.loads(self.options.get("pages", "[]")))


class _PagedReader(DataSourceReader):
    def __init__(self, pages: list[dict]):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.pages))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.pages:
            return
        page = self.pages[partition.value]
        yield (partition.value, str(page.get("cursor", "")), [json.dumps(x) for x in page.get("items", [])])


def http_body(value: Column) -> Column:
    """The first 32 KB of a body, which is what health rules look at."""
    return F.substring(value, 1, 32768)
