"""Catalog versions: which copy counts, and applying a release as one step."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import compare_versions
from lodestone.operators.joins import unknown_references
from lodestone.sources import sinks


def effective(bundled: DataFrame, cached: DataFrame | None, errors: int = 0) -> DataFrame:
    """The cached catalog if it is valid and not older than the bundled one, else the bundled one (one row each: catalog_version)."""
    if cached is None or errors or cached.isEmpty():
        return bundled
    versions = bundled.select(F.col("catalog_version").alias("b")).limit(1).join(F.broadcast(cached.select(F.col("catalog_version").alias("c")).limit(1)))
    return cached if versions.select(compare_versions(F.col("c"), F.col("b"))).first()[0] >= 0 else bundled


def verify(content: bytes, digest: str, limit: int) -> bytes:
    """The content, if its size and digest are as promised."""
    if len(content) >= limit:
        raise ValueError(f"{len(content)} bytes; the limit is {limit}")
    if hashlib.sha256(content).hexdigest() != digest.lower():
        raise ValueError("the digest differs")
    return content


def apply_release(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str, keys: dict[tuple[str, str], tuple[str, str]] | None = None) -> dict[str, str]:
    """Writes all tables of a version, then one pointer that readers follow, so they see all of it or none.

    ``keys`` maps (table, column) to the (table, key) it refers to; a value without its row is an error, and nothing is
    written. The versions before stay where they are: :func:`restore` points to the one before.
    """
    for (name, column), (other, key) in (keys or {}).items():
        lost = unknown_references(tables[name], column, tables[other].withColumnRenamed(key, column) if key != column else tables[other], column)
        found = [r[0] for r in lost.limit(5).collect()]
        if found:
            raise ValueError(f"{name}.{column} refers to rows that {other} does not have: {found}")
    paths = {name: sinks.write_version(df, f"{root}/{name}", version) for name, df in tables.items()}
    _point(spark, root, version)
    return paths


def _versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("seq long, version string").json(f"{root}/_versions")


def _point(spark: SparkSession, root: str, version: str) -> None:
    """Adds a pointer with the next number; the file times of a store play no part."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions")
    known = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    last = _versions(spark, root).agg(F.max("seq")).first()[0] if known else None
    spark.createDataFrame([((last or 0) + 1, version)], "seq long, version string").coalesce(1).write.mode("append").json(f"{root}/_versions")


def current_version(spark: SparkSession, root: str) -> str | None:
    """The last version that was written completely."""
    found = _versions(spark, root).agg(F.max_by("version", "seq")).first()
    return found[0] if found else None


def restore(spark: SparkSession, root: str) -> str:
    """Points to the version before the current one."""
    rows = _versions(spark, root).orderBy(F.desc("seq")).limit(1_000).collect()
    before = next((r["version"] for r in rows if r["version"] != rows[0]["version"]), None) if rows else None
    if before is None:
        raise ValueError("there is no version before this one")
    _point(spark, root, before)
    return before


def read_current(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}/version={current_version(spark, root)}")
