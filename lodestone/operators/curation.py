"""Curation of a catalog: duplicates, repeated audits, quarantine, balance, rule classes, health, retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text, urls

#: States of an audit, and statuses that restrict or break a page.
AUDIT_STATES = ("dynamic", "static", "broken", "unverified")
RESTRICTED_STATUS, BROKEN_STATUS = (401, 403, 429), (404, 410)
DEEP_DEPTHS = ("keyframes", "video-trajectory")
VERIFIED_KINDS = ("official-media-frame-difference", "browser-page-motion")
MAX_SOURCE_SHARE = 0.80


# ---- duplicates


def strength() -> Column:
    """Order of records that stand for the same thing: verified, with evidence, of an item's own page, then the larger id."""
    return F.struct(
        F.col("last_verified").isNotNull().cast("int").alias("v"), F.coalesce(F.size("evidence_kinds") > 0, F.lit(False)).cast("int").alias("e"),
        (F.coalesce("link_scope", F.lit("item")) == "item").cast("int").alias("s"), F.col("id").alias("i"),
    )


def deduplicated(records: DataFrame, compatible: bool = False) -> tuple[DataFrame, DataFrame]:
    """Strongest records and the others with a reason, in four passes: id, canonical url, media url, runtime url.

    ``records`` has id, url, media_url, runtime_url, last_verified, link_scope and evidence_kinds (array). Records
    without a key pass. With ``compatible``, records that share an id all go, as losers are known by their id.
    """
    passes = (
        ("duplicate-id", F.col("id")), ("duplicate-canonical-url", urls.curation_key(F.col("url"))),
        ("duplicate-official-media", F.col("media_url")), ("duplicate-runtime-file", F.col("runtime_url")),
    )
    active = records.withColumn("reason", F.lit(None).cast("string"))
    for label, key in passes:
        active = active.withColumn("_key", F.when(F.col("reason").isNull(), key.cast("string")))
        # records without a key, or already out, are spread and never compared
        spread = F.when(F.col("_key").isNull(), F.monotonically_increasing_id())
        active = active.withColumn("_spread", spread)
        place = F.row_number().over(Window.partitionBy("_key", "_spread").orderBy(strength().desc()))
        active = active.withColumn("reason", F.coalesce("reason", F.when(F.col("_key").isNotNull() & (place > 1), F.lit(label)))).drop("_key", "_spread")
        if compatible and label == "duplicate-id":
            gone = active.where(F.col("reason").isNotNull()).select("id").distinct().withColumn("_gone", F.lit(label))
            active = active.join(gone, "id", "left").withColumn("reason", F.coalesce("reason", "_gone")).drop("_gone")
    return active.where("reason is null").drop("reason"), active.where("reason is not null")


# ---- decisions over repeated audits


def audit_decisions(audits: DataFrame) -> DataFrame:
    """Rows (id, decision, reason, winning_report, audit_states) from audits (id, report_no, state); other states are errors."""
    state = F.when(F.col("state").isin(*AUDIT_STATES), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("unsupported state "), F.col("state"))).cast("string"))
    n = lambda s: F.count_if(F.col("state") == s)
    sums = audits.withColumn("state", state).groupBy("id").agg(
        n("dynamic").alias("dynamic"), n("static").alias("static"), n("broken").alias("broken"),
        F.max(F.when(F.col("state") == "dynamic", F.col("report_no"))).alias("winning_report"),
        F.transform(F.array_sort(F.collect_list(F.struct("report_no", "state"))), lambda x: x["state"]).alias("audit_states"),
    )
    return sums.select("id", *decision(F.col("dynamic"), F.col("static"), F.col("broken")), "winning_report", "audit_states")


def decision(dynamic: Column, static: Column, broken: Column) -> tuple[Column, Column]:
    """keep or quarantine, and why, from the numbers of audits by state."""
    reason = (
        F.when(dynamic > 0, F.lit("dynamic-verified"))
        .when(static >= 2, F.lit("static-confirmed-twice"))
        .when(broken >= 2, F.lit("broken-confirmed-twice"))
        .when(static > 0, F.lit("static-needs-second-confirmation"))
        .when(broken > 0, F.lit("broken-needs-second-confirmation"))
        .otherwise(F.lit("motion-unverified"))
    )
    return F.when(dynamic > 0, F.lit("keep")).otherwise(F.lit("quarantine")).alias("decision"), reason.alias("reason")


def curate(records: DataFrame, audits: DataFrame, checked_at: str, preserve: bool = False, compatible: bool = False) -> DataFrame:
    """All records with decision, reason and audit_states; kept ones get ``last_check`` and ``last_verified`` of the audit.

    Besides the columns that deduplicated() needs, records may have evidence_kind, media_verified_at,
    runtime_verified_at, verification_kind and verified_at. Records from a public list are kept only if their files
    were verified on the same date. ``preserve`` keeps unaudited records whose verification agrees with itself.
    """
    for c in ("evidence_kind", "media_verified_at", "runtime_verified_at", "verification_kind", "verified_at", "last_check"):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string"))
    active, duplicates = deduplicated(records, compatible)
    joined = active.join(audit_decisions(audits), "id", "left")
    unseen = F.col("decision").isNull()
    stale = (F.col("evidence_kind") == "public-list-api") & ~(
        F.coalesce(F.col("media_verified_at") == checked_at, F.lit(False)) & F.coalesce(F.col("runtime_verified_at") == checked_at, F.lit(False)))
    stale = F.coalesce(stale, F.lit(False)) & (F.col("decision") == "keep")
    kept_as_is = F.lit(preserve) & unseen & F.coalesce((F.col("verified_at") == F.col("last_verified")) & F.col("verification_kind").isin(*VERIFIED_KINDS), F.lit(False))
    reason = F.when(kept_as_is, F.lit("preserved")).when(unseen, F.lit("motion-unverified")).when(stale, F.lit("official-assets-not-currently-verified")).otherwise(F.col("reason"))
    keep = kept_as_is | F.coalesce((F.col("decision") == "keep") & ~stale, F.lit(False))
    fresh = keep & ~kept_as_is
    out = joined.withColumns({
        "reason": reason, "decision": F.when(keep, F.lit("keep")).otherwise(F.lit("quarantine")),
        "last_check": F.when(fresh, F.lit(checked_at)).otherwise(F.col("last_check")),
        "last_verified": F.when(fresh, F.lit(checked_at)).otherwise(F.col("last_verified")),
        "audit_states": F.coalesce("audit_states", F.array().cast("array<string>")),
    })
    return out.unionByName(duplicates.withColumn("decision", F.lit("quarantine")), allowMissingColumns=True)


def verification_summary(audits: DataFrame) -> DataFrame:
    """Adds ``verification``: media evidence as rounded ratios, page motion as target and counts."""
    media = F.col("evidence_kind") == VERIFIED_KINDS[0]
    number = lambda c: F.when(media, F.round(F.coalesce(c, F.lit(0.0)), 6))
    page = lambda c, d: F.when(~F.coalesce(media, F.lit(False)), F.coalesce(F.col(c), F.lit(d)) if d is not None else F.col(c))
    return audits.withColumn("verification", F.struct(
        F.when(media, F.lit(VERIFIED_KINDS[0])).otherwise(F.lit(VERIFIED_KINDS[1])).alias("kind"), F.col("checked_at").alias("verified_at"),
        number(F.col("changed_pixel_ratio")).alias("changed_pixel_ratio"), number(F.col("mean_absolute_difference")).alias("mean_absolute_difference"),
        page("target_kind", None).alias("target_kind"), page("target_confidence", None).alias("target_confidence"),
        page("unique_frame_hashes", 0).alias("unique_frame_hashes"), page("running_animations", 0).alias("running_animations"), page("video_advanced", False).alias("video_advanced"),
    ))


# ---- counts and gates


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def nested_counts(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One row per ``row`` value with a count for each stated value of ``column``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def source_shares(df: DataFrame, source: str = "site_id", max_share: float = MAX_SOURCE_SHARE) -> DataFrame:
    """Rows (source, n, share, dominant, status): the gate passes if the largest share is at most ``max_share``. Ties: the lesser name leads."""
    n = counts_by(df, source)
    # the totals have a row per source
    total = n.agg(F.sum("n").alias("total"), F.max("n").alias("top"))
    lead = n.join(F.broadcast(total), F.col("n") == F.col("top")).agg(F.min(source).alias("leader"))
    rows = n.join(F.broadcast(total)).join(F.broadcast(lead))
    share = F.round(F.col("n") / F.col("total"), 4)
    status = F.when(F.round(F.col("top") / F.col("total"), 4) <= max_share, F.lit("pass")).otherwise(F.lit("fail"))
    return rows.select(source, "n", share.alias("share"), (F.col(source) == F.col("leader")).alias("dominant"), status.alias("status"))


def source_retention(before: DataFrame, after: DataFrame, source: str = "site_id") -> DataFrame:
    """Rows (source, before, after, retention); a source that is gone has 0."""
    a = counts_by(before, source).withColumnRenamed("n", "before")
    b = counts_by(after, source).withColumnRenamed("n", "after")
    rows = a.join(b, source, "left").fillna(0, ["after"])
    return rows.withColumn("retention", F.round(F.coalesce(F.try_divide(F.col("after"), F.col("before")), F.lit(0.0)), 4))


def best_attempts(attempts: DataFrame, key: str = "url") -> DataFrame:
    """The result of each url over rounds of retries: a later one replaces an earlier unless it would undo a success."""
    rest = [c for c in attempts.columns if c != key]
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("ok", F.lit(False)).cast("int"), F.col("round"))).alias("r"))
    return best.select(key, "r.*")


def asset_checks(assets: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds ``ok`` for assets (id, media_url, runtime_url): both urls answered with the first 32 bytes; unchecked urls did not."""
    state = best_attempts(checks).select("url", F.coalesce((F.col("status") == 206) & (F.col("bytes") == 32), F.lit(False)).alias("ok"))
    for c in ("media", "runtime"):
        assets = assets.join(state.select(F.col("url").alias(f"{c}_url"), F.col("ok").alias(f"{c}_ok")), f"{c}_url", "left").fillna(False, [f"{c}_ok"])
    return assets.withColumn("ok", F.col("media_ok") & F.col("runtime_ok"))


def restored(records: DataFrame, overrides: DataFrame, checked_at: str) -> DataFrame:
    """Records put back without their verification, with overrides (id and columns to set) applied."""
    out = records.drop("verification").withColumns({"last_verified": F.lit(None).cast("string"), "last_check": F.lit(checked_at)})
    new = [c for c in overrides.columns if c != "id"]
    own = overrides.select("id", *[F.col(c).alias(f"_{c}") for c in new])
    out = out.join(own, "id", "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) if c in records.columns else F.col(f"_{c}") for c in new}).drop(*[f"_{c}" for c in new])


# ---- rule classes


def rule_classify(df: DataFrame, column: str, rules: list[tuple[str, tuple[str, ...]]], whole_words: bool = False, most: int = 3) -> DataFrame:
    """Adds ``classes``: the first ``most`` rules, in order, with a keyword in the text; ``whole_words`` needs borders around it."""
    hay = F.lower(F.coalesce(F.col(column), F.lit("")))

    def hit(words: tuple[str, ...]) -> Column:
        if whole_words:
            quoted = "|".join("\\Q" + w.replace("\\E", "") + "\\E" for w in words)
            return hay.rlike(f"(?<![a-z0-9])(?:{quoted})(?![a-z0-9])")
        return reduce(lambda a, w: a | F.contains(hay, F.lit(w)), words, F.lit(False))

    found = F.array_compact(F.array(*[F.when(hit(words), F.lit(name)) for name, words in rules]))
    return df.withColumn("classes", F.slice(found, 1, most))


def trigger_by_prefix(classes: Column, fallback: Column) -> Column:
    """The trigger of the first class by its prefix; ``fallback`` without classes."""
    first = F.get(classes, F.lit(0))
    starts = lambda *p: reduce(lambda a, x: a | first.startswith(x), p, F.lit(False))
    return (
        F.when(first.isNull(), fallback).when(starts("hover-"), F.lit("hover")).when(starts("scroll-"), F.lit("scroll"))
        .when(starts("ambient-", "loading-"), F.lit("loop")).when(starts("text-", "entrance-"), F.lit("mount")).otherwise(F.lit("click"))
    )


#: How an example of a trigger is captured, as (settle ms, frame labels, evidence, seconds), by kind of source.
RECIPES = {
    "sitemap": {
        "hover": (800, ("rest", "hover-peak", "reset"), "storyboard", 4),
        "scroll": (1200, ("before-scroll", "mid-scroll", "settled"), "storyboard", 4),
        "mount": (1200, ("before-replay", "mid-motion", "settled"), "storyboard", 4),
        "manual": (1200, ("rest", "changed", "settled"), "storyboard", 4),
        "loop": (1600, ("cycle-start", "cycle-peak", "cycle-return"), "clip", 5),
        "click": (1000, ("before", "activated", "settled"), "storyboard", 4),
    },
    "candidates": {
        "hover": (800, ("rest", "hover-peak", "reset"), "storyboard", 4),
        "scroll": (1200, ("before-scroll", "mid-scroll", "settled"), "storyboard", 4),
        "mount": (1400, ("cycle-start", "cycle-peak", "cycle-return"), "clip", 5),
        "manual": (1000, ("before", "activated", "settled"), "storyboard", 4),
        "loop": (1400, ("cycle-start", "cycle-peak", "cycle-return"), "clip", 5),
        "click": (1000, ("before", "activated", "settled"), "storyboard", 4),
    },
    "marketplace": {
        "loop": (1600, ("cycle-start", "cycle-peak", "cycle-return"), "clip", 5),
        "click": (1000, ("before", "activated", "settled"), "storyboard", 4),
    },
}


def capture_recipe(kind: str, trigger: Column) -> Column:
    """A struct (settle_ms, frame_labels, evidence, clip_seconds); unknown triggers count as click."""
    def recipe(t):
        ms, labels, evidence, seconds = RECIPES[kind][t]
        return F.struct(F.lit(ms).alias("settle_ms"), F.array(*map(F.lit, labels)).alias("frame_labels"), F.lit(evidence).alias("evidence"), F.lit(seconds).alias("clip_seconds"))

    return reduce(lambda acc, t: F.when(trigger == t, recipe(t)).otherwise(acc), [t for t in RECIPES[kind] if t != "click"], recipe("click"))


# ---- health


def http_state(status: Column, url: Column, final_url: Column, restricted_marker: Column | None = None) -> Column:
    """restricted, missing, http-error, redirected-away or shell-reachable of a fetched page; null without a status: unreachable."""
    state = (
        F.when(status.isNull(), F.lit("unreachable")).when(status.isin(*RESTRICTED_STATUS), F.lit("restricted")).when(status.isin(*BROKEN_STATUS), F.lit("missing"))
        .when(status >= 400, F.lit("http-error")).otherwise(urls.redirect_state(url, final_url))
    )
    return state if restricted_marker is None else F.when(F.coalesce(restricted_marker, F.lit(False)) & status.isNotNull(), F.lit("restricted")).otherwise(state)


def health_class(cases: DataFrame) -> DataFrame:
    """Adds state, reasons, quick_eligible and deep_eligible to observations of pages.

    Columns: outer_status, settled, redirected_away, access_restricted, expects_render_target, visually_observed,
    capture_attempted, capture_succeeded (booleans, missing is false), critical_statuses (array of int),
    console_errors (array), render_targets (array of structs visible, width, height), analysis_depth.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    checked = F.when(yes("capture_succeeded") & ~yes("capture_attempted"), F.raise_error(F.lit("a capture succeeded that was not attempted")).cast("boolean")).otherwise(F.lit(True))
    critical = F.coalesce("critical_statuses", F.array().cast("array<int>"))
    errors = F.coalesce("console_errors", F.array().cast("array<string>"))
    targets = F.coalesce(F.col("render_targets"), F.array().cast("array<struct<visible:boolean,width:double,height:double>>"))
    target = F.exists(targets, lambda t: F.coalesce(t["visible"], F.lit(True)) & (F.coalesce(t["width"], F.lit(0.0)) > 0) & (F.coalesce(t["height"], F.lit(0.0)) > 0))
    outer = F.col("outer_status")
    restricted = yes("access_restricted") | F.coalesce(outer.isin(*RESTRICTED_STATUS), F.lit(False)) | F.exists(critical, lambda s: s.isin(*RESTRICTED_STATUS))
    outer_bad = F.coalesce(outer.isin(*BROKEN_STATUS) | ((outer >= 400) & ~restricted), F.lit(False))
    critical_bad = F.filter(critical, lambda s: s.isin(*BROKEN_STATUS) | (s >= 500))
    content_bad = F.exists(errors, text.has_content_error)
    missing = yes("settled") & yes("expects_render_target") & ~target & ~restricted
    broken = outer_bad | (F.size(critical_bad) > 0) | content_bad | yes("redirected_away") | missing
    rendered = yes("visually_observed") | target
    state = (
        F.when(broken, F.lit("broken")).when(rendered & yes("capture_attempted") & ~yes("capture_succeeded"), F.lit("capture_restricted"))
        .when(rendered, F.lit("render_verified")).otherwise(F.lit("shell_reachable"))
    )
    shell = F.coalesce(outer.between(200, 399), F.lit(False)) & ~yes("redirected_away")
    last = (
        F.when(broken, F.lit(None).cast("string")).when(rendered & yes("capture_attempted") & ~yes("capture_succeeded"), F.lit("render-confirmed-capture-failed"))
        .when(rendered, F.lit("visible-render-confirmed")).when(restricted, F.lit("access-restricted")).when(shell, F.lit("outer-shell-only"))
        .otherwise(F.lit("source-unreachable-or-unconfirmed"))
    )
    reasons = F.concat(
        F.array(F.when(outer_bad, F.concat(F.lit("outer-status-"), outer.cast("string")))), F.transform(critical_bad, lambda s: F.concat(F.lit("critical-status-"), s.cast("string"))),
        F.array(F.when(content_bad, F.lit("content-fetch-error")), F.when(yes("redirected_away"), F.lit("redirected-away")), F.when(missing, F.lit("missing-render-target-after-settle")), last),
    )
    out = cases.where(checked).withColumns({"state": state, "reasons": F.array_distinct(F.array_compact(reasons))})
    quick = F.col("state").isin("render_verified", "capture_restricted")
    deep = (F.col("state") == "render_verified") & F.coalesce(F.col("analysis_depth").isin(*DEEP_DEPTHS), F.lit(False))
    return out.withColumns({"quick_eligible": quick, "deep_eligible": deep})


def health_rollup(classified: DataFrame) -> DataFrame:
    """Rows (state, n, quick, deep)."""
    return classified.groupBy("state").agg(F.count("*").alias("n"), F.count_if("quick_eligible").alias("quick"), F.count_if("deep_eligible").alias("deep"))


def suggestion_gate(rows: DataFrame) -> DataFrame:
    """Adds reasons against suggesting a new source, and ``eligible`` if there are none.

    Columns: domain (empty if invalid), catalogued, match_quality, confidence, source_health, support_kind,
    concrete_item, already_suggested.
    """
    no = lambda c, *good: ~F.coalesce(F.col(c).isin(*good), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("domain") == "", F.lit("invalid-domain")).when(F.col("catalogued"), F.lit("already-in-catalog")),
        F.when(no("match_quality", "exact"), F.lit("not-exact")), F.when(no("confidence", "high"), F.lit("not-high-confidence")),
        F.when(no("source_health", "render_verified"), F.lit("not-live-render-verified")), F.when(no("support_kind", "code-backed", "runtime-backed"), F.lit("not-code-or-runtime-backed")),
        F.when(~F.coalesce(F.col("concrete_item"), F.lit(False)), F.lit("not-concrete-item")), F.when(F.coalesce(F.col("already_suggested"), F.lit(False)), F.lit("already-suggested-in-task")),
    ))
    return rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
