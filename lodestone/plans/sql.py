"""Functions under SQL names: ``register(spark)`` makes them for the session.

The scalar ones are SQL expressions that the optimizer sees through; links of pages are a table function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: By name: parameters, result and expression.
FUNCTIONS = {
    "normalize_text": ("value STRING", "STRING", r"trim(regexp_replace(lower(value), '(?U)[\\s\\x1c-\\x1f]+', ' '))"),
    "contains_term": ("value STRING, term STRING", "BOOLEAN", "length(normalize_text(term)) > 0 AND contains(normalize_text(value), normalize_text(term))"),
    "slug": ("value STRING, most INT", "STRING", "left(regexp_replace(regexp_replace(lower(value), '[^a-z0-9]+', '-'), '^-+|-+$', ''), most)"),
    "report_day": ("checked_at STRING", "DATE", "CASE WHEN left(checked_at, 10) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' THEN try_to_date(left(checked_at, 10)) END"),
    "url_host": ("url STRING", "STRING", "lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', ''))"),
}


@udtf(returnType="pos int, href string")
class PageLinks:
    """One row for each link target of a page, by an HTML parser; no row for a null page."""

    def eval(self, html: str):
        from lodestone.sources.catalog import _Links

        parser = _Links()
        parser.feed(html or "")
        parser.close()
        yield from enumerate(parser.found)


def register(spark: SparkSession) -> None:
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")
    spark.udtf.register("page_links", PageLinks)
