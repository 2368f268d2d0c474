"""What is shown and reviewed next: pages without what was shown, gates by evidence and health, stop conditions, fallbacks.

Sessions are tables (query_id, ...), so many of them move in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import urls
from lodestone.operators.ranking import top_per_group

#: Page sizes of evidence and of links, health states of the quick list, and the order of delivery.
EVIDENCE_PAGE, LINK_PAGE, MOST_LINKS = 3, 8, 10
QUICK_STATES = ("render_verified", "capture_restricted")
DELIVERY_ORDER = ("snippet", "package", "asset", "recreate")
FORMAL, CHECKED, CAPTURED, FAILED_IN_A_ROW = 8, 24, 16, 3
VIDEO_ONLY = "video-only"


def unshown(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """Candidates (query_id, item_id, url, ...) whose id and canonical url the query's ledger ``shown`` (query_id, item_id, url) does not have.

    Null ids and urls of the ledger exclude nothing.
    """
    key = F.col("_key")
    left = candidates.withColumn("_key", urls.curation_key(F.col("url")))
    seen = shown.select("query_id", "item_id", urls.curation_key(F.col("url")).alias("_key"))
    left = left.join(seen.select("query_id", "item_id").where("item_id is not null").distinct(), ["query_id", "item_id"], "left_anti")
    return left.join(seen.select("query_id", "_key").where(key.isNotNull()).distinct(), ["query_id", "_key"], "left_anti").drop("_key")


def next_page(candidates: DataFrame, shown: DataFrame, order: list[Column], size: int = LINK_PAGE) -> DataFrame:
    """The next ``size`` unshown candidates of each query, one a canonical url, with ``rank`` on the page; fewer where they end."""
    if not 1 <= size <= MOST_LINKS:
        raise ValueError(f"a page has 1 to {MOST_LINKS} links")
    left = unshown(candidates, shown).withColumn("_key", F.coalesce(urls.curation_key(F.col("url")), F.col("item_id")))
    once = top_per_group(left, ["query_id", "_key"], order, 1, "_first").drop("_first", "_key")
    return top_per_group(once, ["query_id"], order, size)


def page_ledger(shown: DataFrame, page: DataFrame) -> DataFrame:
    """The ledger with a page's rows added."""
    return shown.select("query_id", "item_id", "url").unionByName(page.select("query_id", "item_id", "url"))


def code_first(candidates: DataFrame, authorised: DataFrame | None = None, support: str = "support_kind") -> DataFrame:
    """Candidates without video-only ones, but for queries in ``authorised`` (query_id); there they come last (``supplement``)."""
    video = F.coalesce(F.col(support) == VIDEO_ONLY, F.lit(False))
    rows = candidates.withColumn("supplement", video)
    if authorised is None:
        return rows.where(~F.col("supplement"))
    marked = rows.join(authorised.select("query_id").distinct().withColumn("_may", F.lit(True)), "query_id", "left")
    return marked.where(~F.col("supplement") | F.col("_may")).drop("_may")


def healthy(candidates: DataFrame, health: DataFrame) -> DataFrame:
    """Candidates whose current health (item_id, state) admits them to the quick list, with the state."""
    states = health.where(F.col("state").isin(*QUICK_STATES)).groupBy("item_id").agg(F.min("state").alias("state"))
    return candidates.join(states, "item_id")


def review_stop(events: DataFrame) -> DataFrame:
    """Reviews (query_id, step, outcome, formal) cut where the first stop condition holds: adds ``stop``, null before it.

    ``outcome``: captured, checked (healthy, not captured), failed or stopped; ``formal``: whether the candidate passed
    the final gate. A review is bounded by its conditions, so a query's window is small.
    """
    running = Window.partitionBy("query_id").orderBy("step")
    so_far = lambda c: F.count_if(c).over(running)
    rows = events.withColumns({
        "_formal": so_far(F.coalesce("formal", F.lit(False))),
        "_checked": so_far(F.col("outcome") != "stopped"),
        "_captured": so_far(F.col("outcome") == "captured"),
        "_streak": so_far(F.col("outcome") != "failed"),
    })
    streak = F.row_number().over(Window.partitionBy("query_id", "_streak").orderBy("step")) - F.when(F.col("_streak") > 0, F.lit(1)).otherwise(F.lit(0))
    rows = rows.withColumn("_failures", F.when(F.col("outcome") == "failed", streak).otherwise(F.lit(0)))
    stop = (
        F.when(F.col("_formal") >= FORMAL, F.lit("complete")).when(F.col("_checked") >= CHECKED, F.lit("live-check-budget-exhausted"))
        .when(F.col("_captured") >= CAPTURED, F.lit("capture-budget-exhausted")).when(F.col("_failures") >= FAILED_IN_A_ROW, F.lit("three-failures"))
        .when(F.col("outcome") == "stopped", F.lit("user-stopped"))
    )
    rows = rows.withColumn("stop", stop)
    first = F.min(F.when(F.col("stop").isNotNull(), F.col("step"))).over(Window.partitionBy("query_id"))
    return rows.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("step") <= F.col("_first"))).drop("_first", "_formal", "_checked", "_captured", "_streak", "_failures")


#: Final priorities in their order, larger values first; cost counts against a candidate.
PRIORITIES = ("readiness", "fit", "capability", "license", "health")


def priority_order() -> list[Column]:
    """The order of a final list: code-backed first, then PRIORITIES, the least cost, the id."""
    return [F.coalesce("supplement", F.lit(False)).asc(), *[F.col(c).desc_nulls_last() for c in PRIORITIES], F.col("cost").asc_nulls_last(), F.col("item_id").asc()]


def delivery_route(gates: dict[str, Column]) -> Column:
    """The first level of DELIVERY_ORDER whose gate holds, as (level, rejected): null level if none does."""
    held = [F.when(F.coalesce(gates[k], F.lit(False)), F.lit(k)) for k in DELIVERY_ORDER if k in gates]
    level = F.coalesce(*held)
    names = F.array(*[F.lit(k) for k in DELIVERY_ORDER if k in gates])
    rejected = F.when(level.isNull(), names).otherwise(F.slice(names, F.lit(1), F.array_position(names, level) - 1))
    return F.struct(level.alias("level"), rejected.alias("rejected"))


def to_audit(records: DataFrame, mode: str = "page", media_site: str | None = None, sources: tuple[str, ...] = ()) -> DataFrame:
    """Records (site_id, evidence_kind) an audit takes: listed media of one site, or all that are no listed media; of some sources."""
    if mode not in ("page", "media"):
        raise ValueError("mode: page or media")
    listed = F.coalesce(F.col("evidence_kind") == "public-list-api", F.lit(False))
    rows = records.where(listed & (F.col("site_id") == media_site) if mode == "media" else ~listed)
    return rows.where(F.col("site_id").isin(*sources)) if sources else rows


def to_retry(records: DataFrame, results: DataFrame) -> DataFrame:
    """Records (id) that an earlier audit (id, state) saw and did not find dynamic."""
    again = results.where(F.coalesce(F.col("state") != "dynamic", F.lit(True))).select("id").distinct()
    return records.join(again, "id", "left_semi")


def prune(records: DataFrame, allowed: dict[str, Column], evidence: str = "public-sitemap") -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): records of the evidence kind whose site has a rule in ``allowed`` that their url fails are pruned, no others."""
    if not allowed:
        return records, records.limit(0)
    passes = reduce(lambda acc, kv: F.when(F.col("site_id") == kv[0], kv[1]).otherwise(acc), allowed.items(), F.lit(True))
    out = F.coalesce(F.col("evidence_kind") == evidence, F.lit(False)) & ~F.coalesce(passes, F.lit(False))
    return records.where(~out), records.where(out)
