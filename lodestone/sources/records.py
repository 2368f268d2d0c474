"""Records from API items, and pages of an API followed by their cursors."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import curation

#: Endings of media and runtime files, bounds of a record, and the motion of an item that no rule fits.
MEDIA_SUFFIX, RUNTIME_SUFFIX = ".mp4", ".riv"
MOST_MOTIONS, MOST_TERMS, MOST_TITLE = 3, 24, 160
DEFAULT_MOTIONS = {True: ("interactive-state-machine", "click"), False: ("ambient-illustration-loop", "loop")}
GENERIC_TITLES = ("", "final", "test", "untitled", "new", "animation")

#: An item as the API gives it.
ITEM = (
    "community_post_id BIGINT, community_revisions ARRAY<STRUCT<community_revision_id: BIGINT, slug: STRING, title: STRING, description: STRING, animation: STRING, artboard: STRING, "
    "tags: ARRAY<STRING>, video_url: STRING, video_width: DOUBLE, video_height: DOUBLE, is_animation_state_machine: BOOLEAN, community_files: ARRAY<STRUCT<file_url: STRING>>>>"
)


@dataclass(frozen=True)
class Listing:
    """What a marketplace's records share. A rule is a motion, the words one of which must occur, and the trigger it stands for."""

    site_id: str
    name: str
    prefix: str
    root: str
    media_host: str
    stacks: tuple[str, ...]
    rules: tuple[tuple[str, tuple[str, ...], str], ...]
    generic_titles: tuple[str, ...] = GENERIC_TITLES
    reset_hint: str = ""
    rights_note: str = ""


def safe_https(url: Column, host: str, suffix: str) -> Column:
    """Whether a url is https of exactly that host (user and port do not count), with a path of that ending."""
    part = lambda i: F.regexp_extract(url, r"(?i)\Ahttps://([^/?#]*)([^?#]*)", i)
    name = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"\A.*@", ""), r":[0-9]*\z", "")
    return F.coalesce((name == host) & part(2).endswith(suffix), F.lit(False))


def marketplace_records(items: DataFrame, of: Listing, checked_at: str, item: str = "item") -> DataFrame:
    """Adds ``record``, a struct, to rows with an API item (a JSON string); null where the item lacks what a record needs.

    Needed: both ids, a slug, an https video of the media host with positive width and height, and a runtime file of it. The
    first three rules that fit give the motions, the first one the trigger.
    """
    rows = items.withColumn("_i", F.from_json(F.col(item), ITEM)).withColumn("_r", F.get(F.col("_i.community_revisions"), F.lit(0)))
    r = F.col("_r")
    files = F.filter(r["community_files"], lambda f: safe_https(f["file_url"], of.media_host, RUNTIME_SUFFIX))
    runtime = F.get(files, F.lit(0))["file_url"]
    key = F.concat(F.col("_i.community_post_id"), F.lit("-"), r["community_revision_id"])
    good = (
        key.isNotNull() & (F.trim(r["slug"]) != "") & safe_https(r["video_url"], of.media_host, MEDIA_SUFFIX)
        & (r["video_width"] > 0) & (r["video_height"] > 0) & runtime.isNotNull()
    )
    title = F.left(text.display_title(r["title"], r["slug"], r["animation"], r["artboard"], F.concat(F.lit(of.name + " "), key), of.generic_titles), F.lit(MOST_TITLE))
    rows = rows.withColumns({"_good": F.coalesce(good, F.lit(False)), "_title": title})
    rows = rows.withColumn("_words", text.search_text(F.col("_title"), r["description"], r["animation"], r["artboard"], tags=r["tags"]))
    has = lambda words: F.col("_words").rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])")
    pair = lambda m, t: F.struct(F.lit(m).alias("motion"), F.lit(t).alias("trigger"))
    fits = F.array_compact(F.array(*[F.when(has(words), pair(m, t)) for m, words, t in of.rules]))
    default = F.when(F.coalesce(r["is_animation_state_machine"], F.lit(False)), pair(*DEFAULT_MOTIONS[True])).otherwise(pair(*DEFAULT_MOTIONS[False]))
    rows = rows.withColumn("_fits", fits).withColumn("_fits", F.when(F.size("_fits") > 0, F.slice("_fits", 1, MOST_MOTIONS)).otherwise(F.array(default)))
    trigger = F.col("_fits")[0]["trigger"]
    recipe = curation.capture_recipe("marketplace", trigger)
    terms = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("_words", F.lit(r"([a-z0-9][a-z0-9-]+)"), F.lit(1)))), 1, MOST_TERMS)
    slug = F.regexp_replace(r["slug"], r"\A/+|/+\z", "")
    record = F.struct(
        F.concat(F.lit(of.prefix), key).alias("id"), F.lit(of.site_id).alias("site_id"), F.col("_title").alias("title"), F.concat(F.lit(of.root.rstrip("/") + "/"), slug, F.lit("/")).alias("url"),
        r["video_url"].alias("preview_url"), F.transform("_fits", lambda x: x["motion"]).alias("motion_ids"), F.array(*map(F.lit, of.stacks)).alias("stacks"), F.lit("official-media").alias("preview_strategy"),
        F.struct(trigger.alias("kind"), F.concat(F.lit("the visible "), F.col("_title"), F.lit(" Marketplace preview")).alias("target_hint"), recipe["settle_ms"].alias("settle_ms"), F.lit(of.reset_hint).alias("reset_hint")).alias("trigger"),
        F.struct(recipe["evidence"].alias("recommended_evidence"), recipe["frame_labels"].alias("frame_labels"), recipe["clip_seconds"].alias("clip_seconds")).alias("capture"),
        F.struct(F.lit("reference-only").alias("status"), F.lit(of.rights_note).alias("note")).alias("rights"),
        F.struct(F.lit("public-list-api").alias("kind"), r["video_url"].alias("official_media_url"), r["video_width"].alias("width"), r["video_height"].alias("height"), runtime.alias("runtime_file_url")).alias("source_evidence"),
        terms.alias("search_terms"), F.lit(checked_at).alias("last_shallow_check"), F.lit(None).cast("string").alias("last_verified"),
    )
    return rows.withColumn("record", F.when(F.col("_good"), record)).drop("_i", "_r", "_good", "_title", "_words", "_fits")


def follow_cursors(pages: DataFrame, start: str = "", items: str = "items") -> DataFrame:
    """Landed API pages (cursor, next_cursor, items) in the order their cursors give, with ``page_no`` from 0.

    The chain starts at ``start`` and ends at a page that is empty, missing or without a next cursor, or that repeats a
    cursor. Chains are doubled round by round over the whole table, so a chain of n pages takes log n rounds and no
    task follows it page by page.
    """
    from lodestone.plans.storage import checkpointed

    once = pages.groupBy("cursor").agg(F.first(F.struct(*[c for c in pages.columns if c != "cursor"])).alias("p")).select("cursor", "p.*")
    full = once.where(F.size(items) > 0)
    nodes = full.select(F.col("cursor").alias("a"), F.col("next_cursor").alias("b")).where("b is not null and b <> a")
    # reach: the cursor that many steps further; order: the number of steps from the start
    reach = checkpointed(nodes.join(full.select(F.col("cursor").alias("b")), "b", "left_semi").select("a", "b"))
    placed = checkpointed(full.where(F.col("cursor") == start).select("cursor", F.lit(0).cast("long").alias("page_no")))
    step = 1
    while not reach.isEmpty():
        more = placed.join(reach, placed["cursor"] == reach["a"]).select(F.col("b").alias("cursor"), (F.col("page_no") + step).alias("page_no"))
        both = placed.unionByName(more).groupBy("cursor").agg(F.min("page_no").alias("page_no"))
        grown = checkpointed(both)
        if step > 1 and grown.count() == placed.count() or placed.isEmpty():
            break
        placed = grown
        other = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach = checkpointed(reach.join(other, "b").select("a", F.col("c").alias("b")))
        step *= 2
    return full.join(placed, "cursor")


def taken(pages: DataFrame, target: int, have: int = 0, items: str = "items") -> DataFrame:
    """Items (page_no, pos, item) of ordered pages, up to ``target`` with the ``have`` there are already.

    Sizes are summed by page; only they, a number a page, are put in one order.
    """
    sizes = pages.select("page_no", F.size(items).alias("n"))
    chunk = sizes.groupBy(F.floor(F.col("page_no") / 1024).alias("c")).agg(F.sum("n").alias("s"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunk = chunk.select("c", ahead(Window.orderBy("c"), "s").alias("_before"))
    within = sizes.withColumn("c", F.floor(F.col("page_no") / 1024)).withColumn("_own", ahead(Window.partitionBy("c").orderBy("page_no"), "n"))
    before = within.join(chunk, "c").select("page_no", (F.col("_before") + F.col("_own") + have).alias("_before"))
    rows = pages.join(before, "page_no").where(F.col("_before") < target)
    cut = F.slice(items, F.lit(1), F.greatest(F.lit(0), F.least(F.size(items).cast("long"), target - F.col("_before"))).cast("int"))
    return rows.select("page_no", F.posexplode(cut).alias("pos", "item"))
