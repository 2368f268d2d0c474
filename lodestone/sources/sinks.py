"""Writers: versioned tables, JSON lines, vector indexes, releases, and the small HTML boards made on the driver."""

from __future__ import annotations

import gzip
import hashlib
import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a board takes; boards are for people.
BOARD_ROWS = 500
EVIDENCE_ITEMS, EVIDENCE_BYTES, EVIDENCE_TOTAL = 6, 25 << 20, 50 << 20


def write_version(df: DataFrame, root: str, version: str, fmt: str = "parquet") -> str:
    """Writes a version of a table in a folder of its own; a failed write leaves no version that readers see."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.format(fmt).mode("errorifexists").save(path)
    return path


def write_json_lines(df: DataFrame, path: str) -> None:
    """One compact JSON object a line; null fields are left out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_index(vectors: DataFrame, path: str, frames_per_group: int = 8 << 20) -> None:
    """Unit vectors (case_id, region, frame_idx, embedding) as Parquet, clustered by case."""
    from lodestone.functions.vectors import l2_normalize

    unit = vectors.withColumn("embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
    unit.repartitionByRange("case_id").sortWithinPartitions("case_id", "region", "frame_idx").write.option("parquet.block.size", frames_per_group).mode("overwrite").parquet(path)


def release_manifest(content: bytes, version: str, published_at: str, catalog_url: str, min_version: str = "0", examples: bytes | None = None, examples_url: str | None = None, compress: bool = False) -> tuple[dict, bytes | None]:
    """A manifest with digests, and the examples asset to publish; a compressed asset is checked to give its source back."""
    out = {"schema_version": 1, "catalog_version": version, "min_version": min_version, "published_at": published_at, "catalog_url": catalog_url, "sha256": hashlib.sha256(content).hexdigest()}
    asset = examples
    if examples is not None:
        if compress:
            asset = gzip.compress(examples, mtime=0)
            if gzip.decompress(asset) != examples:
                raise ValueError("the compressed asset does not give its source back")
            out |= {"examples_compression": "gzip", "examples_content_sha256": hashlib.sha256(examples).hexdigest()}
        out |= {"examples_url": examples_url, "examples_sha256": hashlib.sha256(asset).hexdigest()}
    return out, asset


def content_digests(files: DataFrame) -> DataFrame:
    """Adds sha256 and size of ``content`` (as of the binaryFile source)."""
    return files.withColumns({"sha256": F.sha2("content", 256), "n_bytes": F.octet_length("content")})


def _board(title: str, payload: object) -> str:
    data = json.dumps(payload, ensure_ascii=False).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ol id="items"></ol><script type="application/json" id="data">{data}</script><script>for (const x of JSON.parse(document.getElementById("data").textContent)) {{ const li = document.createElement("li"); li.textContent = Object.entries(x).map(([k, v]) => k + ": " + (typeof v === "object" ? JSON.stringify(v) : v)).join(" | "); document.getElementById("items").append(li); }}</script>\n'


def preview_board(matches: DataFrame, title: str, limit: int = 12) -> str:
    """An HTML page of the first matches by score."""
    rows = matches.orderBy(F.col("score").desc(), "motion_id").limit(min(limit, BOARD_ROWS))
    return _board(title, [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()])


def evidence_errors(items: DataFrame) -> DataFrame:
    """Items of an evidence board with errors: id, title, site, https source, media (array of structs path, size); a storyboard needs two frames."""
    from lodestone.functions.urls import is_safe_https
    from lodestone.sources.validation import with_errors

    n = F.coalesce(F.size("media"), F.lit(0))
    rules = {
        "id": ~F.coalesce(F.col("id") != "", F.lit(False)), "title": ~F.coalesce(F.col("title") != "", F.lit(False)), "source": ~is_safe_https(F.col("url")), "media": n < 1,
        "storyboard": (F.col("kind") == "storyboard") & (n < 2), "size": F.exists(F.coalesce("media", F.array().cast("array<struct<path:string,size:bigint>>")), lambda m: m["size"] > EVIDENCE_BYTES),
    }
    return with_errors(items, rules)


def evidence_board(items: DataFrame, title: str) -> str:
    """An HTML page of checked evidence; all errors are reported together."""
    rows = [json.loads(r[0]) for r in evidence_errors(items).select(F.to_json(F.struct("*"))).limit(EVIDENCE_ITEMS + 1).collect()]
    errors = [f"{r.get('id')}: {', '.join(r['errors'])}" for r in rows if r["errors"]]
    if not rows or len(rows) > EVIDENCE_ITEMS:
        errors.append(f"a board has 1 to {EVIDENCE_ITEMS} items")
    if sum(m["size"] for r in rows for m in r.get("media") or []) > EVIDENCE_TOTAL:
        errors.append("the media are too large together")
    if errors:
        raise ValueError("; ".join(errors))
    return _board(title, rows)


def data_uri(content, mime):
    """A column with binary content as a data uri."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def overview(sites: DataFrame, examples: DataFrame) -> DataFrame:
    """Rows (site_id, name, n_items), all sites, with the totals beside."""
    n = examples.groupBy("site_id").agg(F.count("*").alias("n_items"))
    rows = sites.select(F.col("id").alias("site_id"), "name").join(n, "site_id", "left").fillna(0, ["n_items"])
    totals = rows.agg(F.count("*").alias("site_count"), F.sum("n_items").alias("item_count"))
    return rows.join(F.broadcast(totals))


def markdown_overview(overview_rows: DataFrame, version: str) -> str:
    """The overview as text, for a catalog's few sites."""
    from lodestone.functions.text import escape_markdown

    rows = overview_rows.withColumn("name", escape_markdown(F.col("name"))).orderBy("site_id").limit(BOARD_ROWS).collect()
    head = f"Catalog {version}: {rows[0]['site_count'] if rows else 0} sites, {rows[0]['item_count'] if rows else 0} items"
    return "\n".join([head, *(f"- {r['name']}: {r['n_items']}" for r in rows)])


def pool_payload(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates as JSON with the stated columns only."""
    return candidates.select(F.to_json(F.struct(*columns)).alias("json"))
