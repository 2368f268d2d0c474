"""Validators: rows with arrays of error codes, referential checks, and one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.urls import is_safe_https
from lodestone.operators.joins import unknown_references

#: What the fields of a catalog may hold.
SITE_STATUSES = ("active", "degraded")
KINDS = ("code-library", "component-library", "community", "editor", "asset-library", "experimental")
CAPABILITIES = ("snippet", "package", "asset", "recreate", "inspiration")
LICENSES = ("explicit", "item-specific", "restricted", "unclear")
AUTH = ("none", "optional", "required-for-search", "required-for-download", "unknown")
PREVIEW_STRATEGIES = ("official-media", "live-capture", "storyboard", "open-source-only")
TRIGGERS = ("mount", "hover", "click", "scroll", "loop", "manual")
RIGHTS = ("reference-only", "official-media", "open-source-only", "unclear")
LINK_SCOPES = ("item", "source-with-category-preview")
FACETS = ("mechanism", "scene", "style", "platform")
ID = "\\A[a-z0-9]+(?:-[a-z0-9]+)*\\z"


def _bad(ok: Column) -> Column:
    return ~F.coalesce(ok, F.lit(False))


def _strings(c: str, least: int = 0) -> Column:
    return F.col(c).isNotNull() & (F.size(c) >= least) & F.forall(c, lambda x: x.isNotNull() & (x != ""))


def is_date(c: Column) -> Column:
    """A real date written year-month-day; unpadded months and days pass."""
    return c.rlike("\\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\\z") & F.try_to_timestamp(c, F.lit("yyyy-M-d")).isNotNull()


def is_version(c: Column) -> Column:
    return c.rlike("[0-9]")


def with_errors(df: DataFrame, rules: dict[str, Column], out: str = "errors") -> DataFrame:
    """Adds the codes of the rules whose column is true, in the order of the rules."""
    return df.withColumn(out, F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()])))


def duplicated(df: DataFrame, key: str) -> Column:
    return F.count("*").over(Window.partitionBy(key)) > 1


def validate_sites(sites: DataFrame) -> DataFrame:
    """Sites with errors and warnings."""
    template = lambda u: is_safe_https(F.replace(u, F.lit("{query}"), F.lit("query"))) & ~F.contains(F.replace(u, F.lit("{query}"), F.lit("")), F.lit("{"))
    routes = F.array_compact(F.concat(F.array(*[F.col(f"routes.{r}") for r in ("search", "examples", "blocks", "source")]), F.coalesce(F.map_values("routes.categories"), F.array().cast("array<string>"))))
    date_or_null = lambda c: F.col(c).isNotNull() & _bad(is_date(F.col(c)))
    rules = {
        "id": _bad(F.col("id").rlike(ID)), "duplicate-id": duplicated(sites, "id"), "status": _bad(F.col("status").isin(*SITE_STATUSES)), "auth": _bad(F.col("auth").isin(*AUTH)),
        "kind": _bad(F.col("kind").isin(*KINDS)), "homepage": _bad(is_safe_https(F.col("homepage"))), "routes-empty": _bad(F.size(routes) > 0), "routes": _bad(F.forall(routes, template)),
        "capabilities": _bad((F.size("capabilities") > 0) & F.forall("capabilities", lambda c: c.isin(*CAPABILITIES))), "stacks": _bad(_strings("stacks")), "tags": _bad(_strings("tags")),
        "license": _bad(F.col("license.status").isin(*LICENSES)), "license-url": F.col("license.url").isNotNull() & _bad(is_safe_https(F.col("license.url"))),
        "added_at": _bad(is_date(F.col("added_at"))), "last_shallow_check": date_or_null("last_shallow_check"), "last_deep_review": date_or_null("last_deep_review"),
    }
    out = with_errors(sites, rules)
    return with_errors(out, {"no-deep-review": F.col("last_deep_review").isNull(), "degraded": F.col("status") == "degraded"}, "warnings")


def validate_motions(motions: DataFrame) -> DataFrame:
    """Taxonomy rows with errors; of equal ids the first line counts, the rest get ``duplicate-id``."""
    arrays = ("labels", "aliases", "targets", "triggers", "feel", "channels", "search_terms", "site_kinds", "stacks")
    order = "line" if "line" in motions.columns else "category"
    later = F.row_number().over(Window.partitionBy("id").orderBy(order)) > 1
    rules = {"id": _bad(F.col("id").rlike(ID)), "duplicate-id": later, "category": _bad(F.col("category") != "")}
    return with_errors(motions, rules | {c: _bad(_strings(c, 1)) for c in arrays})


def validate_examples(examples: DataFrame, sites: DataFrame | None = None, motions: DataFrame | None = None) -> DataFrame:
    """Items with errors; with ``sites`` and ``motions``, unknown references are errors too (joins, not lists)."""
    e, v = F.col("source_evidence"), F.col("verification")
    recent = lambda c: c.isNull() | F.coalesce(is_date(c), F.lit(False))
    api = e["kind"] == "public-list-api"
    media = v["kind"] == "official-media-frame-difference"
    page = v["kind"] == "browser-page-motion"
    rules = {
        "id": _bad(F.col("id").rlike(ID)), "duplicate-id": duplicated(examples, "id"), "title": _bad(F.trim("title") != ""), "url": _bad(is_safe_https(F.col("url"))),
        "preview_url": F.col("preview_url").isNotNull() & _bad(is_safe_https(F.col("preview_url"))), "link_scope": F.col("link_scope").isNotNull() & _bad(F.col("link_scope").isin(*LINK_SCOPES)),
        "motion_ids": _bad(_strings("motion_ids", 1)), "stacks": _bad(_strings("stacks", 1)), "preview_strategy": _bad(F.col("preview_strategy").isin(*PREVIEW_STRATEGIES)),
        "trigger": _bad(F.col("trigger.kind").isin(*TRIGGERS)), "settle_ms": _bad(F.col("trigger.settle_ms") >= 0), "evidence": _bad(F.col("capture.recommended_evidence").isin("clip", "storyboard")),
        "frame_labels": _bad((F.size("capture.frame_labels") > 0) & F.forall("capture.frame_labels", lambda x: x != "")), "clip_seconds": _bad(F.col("capture.clip_seconds") > 0),
        "rights": _bad(F.col("rights.status").isin(*RIGHTS)), "search_terms": F.col("search_terms").isNotNull() & _bad(_strings("search_terms")),
        "source_evidence": e.isNotNull() & (_bad(e["kind"] != "") | (api & _bad(is_safe_https(e["official_media_url"]) & is_safe_https(e["runtime_file_url"]) & (e["width"] > 0) & (e["height"] > 0)))),
        "verification": v.isNotNull() & (_bad(media | page) | _bad(is_date(v["verified_at"])) | (media & _bad((v["changed_pixel_ratio"] >= 0) & (v["mean_absolute_difference"] >= 0)))),
        "last_shallow_check": _bad(is_date(F.col("last_shallow_check"))), "last_verified": ~recent(F.col("last_verified")),
    }
    out = with_errors(examples, rules)
    if sites is not None:
        unknown = unknown_references(examples, "site_id", sites.select(F.col("id").alias("site_id")), "site_id").withColumn("_unknown", F.lit("unknown-site"))
        out = out.join(unknown, "site_id", "left").withColumn("errors", F.array_compact(F.concat("errors", F.array("_unknown")))).drop("_unknown")
    if motions is not None:
        unknown = unknown_references(examples, "motion_ids", motions.select(F.col("id").alias("motion_id")), "motion_id")
        bad = examples.select("id", F.explode("motion_ids").alias("motion_id")).join(unknown, "motion_id", "left_semi").select("id").distinct().withColumn("_unknown", F.lit("unknown-motion"))
        out = out.join(bad, "id", "left").withColumn("errors", F.array_compact(F.concat("errors", F.array("_unknown")))).drop("_unknown")
    return out


def validate_groups(groups: DataFrame) -> DataFrame:
    """Synonym groups with errors; use assert_valid() to stop at the first."""
    return with_errors(groups, {"group_id": _bad(F.col("group_id") != ""), "facet": _bad(F.col("facet").isin(*FACETS)), "terms": _bad(_strings("terms", 2))})


def assert_valid(df: DataFrame) -> DataFrame:
    """The rows; reading one with errors fails."""
    return df.where(F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", ", ")).cast("boolean")).otherwise(F.lit(True))).drop("errors")


def validate_manifest(manifests: DataFrame) -> DataFrame:
    """Release manifests with errors."""
    digest = lambda c: F.col(c).rlike("\\A[0-9a-fA-F]{64}\\z")
    pair = F.col("examples_url").isNotNull() != F.col("examples_sha256").isNotNull()
    rules = {
        "catalog_version": _bad(is_version(F.col("catalog_version"))), "schema_version": _bad(F.col("schema_version") == 1), "min_version": _bad(is_version(F.col("min_version"))),
        "published_at": _bad(F.try_to_timestamp(F.col("published_at")).isNotNull()), "catalog_url": _bad(is_safe_https(F.col("catalog_url"))), "sha256": _bad(digest("sha256")),
        "examples-pair": F.coalesce(pair, F.lit(False)), "examples_url": F.col("examples_url").isNotNull() & _bad(is_safe_https(F.col("examples_url"))),
        "examples_sha256": F.col("examples_sha256").isNotNull() & _bad(digest("examples_sha256")),
        "compression": F.col("examples_compression").isNotNull() & _bad((F.col("examples_compression") == "gzip") & digest("examples_content_sha256")),
    }
    return with_errors(manifests, rules)


def summary(validated: DataFrame) -> DataFrame:
    """One row: total, failed, passed, and whether all passed."""
    s = validated.agg(F.count("*").alias("total"), F.count_if(F.size("errors") > 0).alias("failed"))
    return s.select("total", "failed", (F.col("total") - F.col("failed")).alias("passed"), ((F.col("failed") == 0) & (F.col("total") > 0)).alias("ok"))
