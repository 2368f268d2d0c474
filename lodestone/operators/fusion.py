"""Rank fusion over channels, routing to review, confidence, and the final ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators.signatures import scores as signature_scores

K = 60
#: Channel weights of the final ranking and of the index search.
RANKING_WEIGHTS = {"text_fit": 1.0, "visual_semantic_fit": 1.0, "motion_trajectory_fit": 0.8, "delivery_quality": 0.4}
SEARCH_WEIGHTS = {"metadata": 1.0, "full": 1.0, "dynamic": 1.0, "motion": 0.8, "reference_full": 1.2, "reference_dynamic": 1.2}
STRONG_RATIO, SUPPORTING_RATIO, TIE = 0.85, 0.65, 0.03
DEPTHS = ("keyframes", "video-trajectory")
LIVE_BUDGET, CAPTURE_BUDGET = 24, 16
FORMAL_LIMIT = 8


def ranks(scores: DataFrame, key: str = "id", channel: str = "channel", score: str = "score", query: str = "query_id") -> DataFrame:
    """Adds ``rank`` in each query's channel, by score, then id; rows without a score have none and are left out."""
    order = Window.partitionBy(query, channel).orderBy(F.col(score).desc(), F.col(key).asc())
    return scores.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).withColumn("rank", F.row_number().over(order))


def clean_rankings(rankings: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Rankings (query_id, channel, id, rank) without blank ids, unknown ids and repeats; ranks count what is left."""
    rows = rankings.withColumn("id", F.trim(F.col("id").cast("string"))).where("id <> '' and trim(channel) <> ''")
    if allowed is not None:
        rows = rows.join(allowed.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    first = rows.groupBy("query_id", "channel", "id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("rank")))


def reciprocal_rank_fusion(rankings: DataFrame, weights: dict[str, float] | None = None, k: int = K, allowed: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, id, rank, rrf_score, channel_count, contributions); the order uses unrounded sums, then the id."""
    if k < 1 or any(not w > 0 for w in (weights or {}).values()):
        raise ValueError("k and the weights must be positive")
    clean = clean_rankings(rankings, allowed)
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        weight = F.coalesce(F.try_element_at(table, F.col("channel")), F.lit(1.0))
    points = clean.withColumn("c", weight / (F.lit(k) + F.col("rank")))
    part = F.struct("rank", "channel", F.round("c", 8).alias("contribution"))
    # sums run over the channels in their order, so that they do not depend on how rows arrive
    summed = points.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("channel", "c"))).alias("cs"), F.count("*").alias("channel_count"), F.array_sort(F.collect_list(part)).alias("contributions"))
    summed = summed.withColumn("s", F.aggregate("cs", F.lit(0.0), lambda a, x: a + x["c"]))
    order = Window.partitionBy("query_id").orderBy(F.col("s").desc(), F.col("id").asc())
    return summed.select("query_id", "id", F.row_number().over(order).alias("rank"), F.round("s", 8).alias("rrf_score"), "channel_count", "contributions")


def top_overlap(rankings: DataFrame, depth: int = 5) -> DataFrame:
    """Rows (query_id, overlap): the mean Jaccard overlap of the channels' first ``depth`` ids; no pair of channels: absent."""
    tops = clean_rankings(rankings).where(F.col("rank") <= depth).groupBy("query_id", "channel").agg(F.collect_set("id").alias("ids"))
    other = tops.select("query_id", F.col("channel").alias("other"), F.col("ids").alias("other_ids"))
    pairs = tops.join(other, "query_id").where(F.col("channel") < F.col("other"))
    jaccard = F.size(F.array_intersect("ids", "other_ids")) / F.size(F.array_union("ids", "other_ids"))
    return pairs.groupBy("query_id").agg(F.avg(jaccard).alias("overlap"))


def review_routing(fused: DataFrame, rankings: DataFrame, policy: str = "auto", max_candidates: int = 5) -> DataFrame:
    """One row a query: signals, reasons, and the candidates to review where independent rankings disagree or the lead is narrow."""
    if policy not in ("auto", "always", "never") or not 1 <= max_candidates <= 5:
        raise ValueError("policy is auto, always or never; max_candidates 1 to 5")
    clean = clean_rankings(rankings)
    leads = fused.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("top"), F.max(F.when(F.col("rank") == 1, F.col("rrf_score"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("rrf_score"))).alias("second"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= max_candidates, F.struct("rank", "id")))), lambda x: x["id"]).alias("ids"),
    )
    votes = clean.join(leads.select("query_id", "top"), "query_id").groupBy("query_id").agg(
        F.count_distinct("channel").alias("ranker_count"), F.count_if((F.col("id") == F.col("top")) & (F.col("rank") <= 3)).alias("votes"))
    rows = leads.join(votes, "query_id", "left").join(top_overlap(rankings), "query_id", "left").fillna(0, ["ranker_count", "votes", "overlap"])
    consensus = F.coalesce(F.try_divide(F.col("votes"), F.col("ranker_count")), F.lit(0.0))
    margin = F.when(F.col("first") > 0, (F.col("first") - F.coalesce("second", F.lit(0.0))) / F.col("first")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"consensus": consensus, "margin": margin})
    several = F.col("ranker_count") >= 2
    reasons = F.array_compact(F.array(
        F.when(~several, F.lit("few-rankers")),
        F.when(several & (F.col("consensus") < 0.6), F.lit("disagreement")),
        F.when(F.col("second").isNotNull() & (F.col("margin") < 0.04) & (F.col("consensus") < 0.8), F.lit("narrow-lead")),
        F.when(several & (F.col("overlap") < 0.2), F.lit("low-overlap")),
    ))
    if policy != "auto":
        reasons = F.array(F.lit("forced")) if policy == "always" else F.array().cast("array<string>")
    rows = rows.withColumn("reasons", reasons).withColumn("required", F.size("reasons") > 0)
    return rows.select(
        "query_id", "required", F.when(F.col("required"), F.lit("review")).otherwise(F.lit("early-stop")).alias("status"), "reasons", "ranker_count",
        F.round("consensus", 4).alias("top1_consensus"), F.round("overlap", 4).alias("top5_overlap"), F.round("margin", 4).alias("lead_margin"),
        F.when(F.col("required"), F.col("ids")).otherwise(F.array().cast("array<string>")).alias("candidate_ids"),
    )


def confidence(strong: Column, supporting: Column) -> Column:
    """high from three strong channels, medium from two strong or three supporting, else low."""
    return F.when(strong >= 3, F.lit("high")).when((strong >= 2) | (supporting >= 3), F.lit("medium")).otherwise(F.lit("low"))


def with_confidence(rows: DataFrame, channels: tuple[str, ...], query: str = "query_id") -> DataFrame:
    """Adds n_strong, n_supporting and confidence: each channel's score against the best of its query."""
    whole = Window.partitionBy(query)
    ratios = [F.when(F.max(c).over(whole) > 0, F.col(c) / F.max(c).over(whole)).otherwise(F.lit(0.0)) for c in channels]
    rows = rows.withColumn("_ratios", F.array(*ratios))
    at_least = lambda limit: F.size(F.filter("_ratios", lambda r: r >= limit))
    rows = rows.withColumns({"n_strong": at_least(STRONG_RATIO), "n_supporting": at_least(SUPPORTING_RATIO)}).drop("_ratios")
    return rows.withColumn("confidence", confidence(F.col("n_strong"), F.col("n_supporting")))


def eligible(candidates: DataFrame) -> DataFrame:
    """Adds ``excluded``: why a candidate cannot be ranked, or null. Unknown qualities and verdicts are errors.

    Repeats of an id or url are for first_seen() to drop before.
    """
    quality = F.coalesce(F.nullif(F.trim("match_quality"), F.lit("")), F.lit("unresolved"))
    verdict = F.coalesce(F.nullif(F.trim("vlm_verdict"), F.lit("")), F.lit("not-reviewed"))
    known = quality.isin("exact", "adjacent", "unresolved") & verdict.isin("confirmed", "contradicted", "uncertain", "not-reviewed")
    reason = (
        F.when(~F.coalesce(F.col("analysis_depth").isin(*DEPTHS), F.lit(False)), F.lit("not-inspected"))
        .when(~known, F.raise_error(F.concat(F.lit("unknown quality or verdict: "), quality, F.lit(" "), verdict)).cast("string"))
        .when(quality == "unresolved", F.lit("unresolved-quality"))
        .when(verdict == "contradicted", F.lit("contradicted"))
    )
    return candidates.withColumn("excluded", reason)


def rank_candidates(candidates: DataFrame, limit: int = FORMAL_LIMIT) -> DataFrame:
    """Eligible candidates with rrf_score, fusion_rank, tie, confidence, bucket (formal, adjacent, low) and rank in it.

    ``candidates`` has query_id, id, match_quality, vlm_verdict and the channels of RANKING_WEIGHTS. A confirmed
    candidate of low confidence counts as medium. Formal ranks past ``limit`` are left out.
    """
    channels = tuple(RANKING_WEIGHTS)
    rows = candidates.withColumn("id", F.col("id").cast("string")).withColumns({c: F.round(c, 4) for c in channels})
    long = rows.unpivot(["query_id", "id"], list(channels), "channel", "score")
    fused = reciprocal_rank_fusion(ranks(long), RANKING_WEIGHTS).select("query_id", "id", "rrf_score", F.col("rank").alias("fusion_rank"))
    rows = with_confidence(rows.join(fused, ["query_id", "id"]), channels)
    promoted = (F.col("confidence") == "low") & (F.col("vlm_verdict") == "confirmed")
    rows = rows.withColumns({"promoted": promoted, "confidence": F.when(promoted, F.lit("medium")).otherwise(F.col("confidence"))})
    before = F.lag("rrf_score").over(Window.partitionBy("query_id").orderBy("fusion_rank"))
    rows = rows.withColumn("tie", F.coalesce((before - F.col("rrf_score")) / F.greatest(before, F.lit(1e-12)) < TIE, F.lit(False)))
    bucket = F.when(F.col("confidence") == "low", F.lit("low")).when(F.col("match_quality") == "exact", F.lit("formal")).otherwise(F.lit("adjacent"))
    rows = rows.withColumn("bucket", bucket)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("fusion_rank")))
    return rows.where((F.col("bucket") != "formal") | (F.col("rank") <= limit))


def ranking_status(ranked: DataFrame, progress: DataFrame, limit: int = FORMAL_LIMIT) -> DataFrame:
    """One row a query: status, returned count and the reason that review ends; ``progress`` has live_checked, captured, stop_reason."""
    n = ranked.groupBy("query_id").agg(F.count_if(F.col("bucket") == "formal").alias("returned"))
    rows = progress.join(n, "query_id", "left").fillna(0, ["returned"])
    for c, budget in (("live_checked", LIVE_BUDGET), ("captured", CAPTURE_BUDGET)):
        rows = rows.withColumn(c, F.when(F.col(c).between(0, budget), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not between 0 and {budget}")).cast("int")))
    stop = (
        F.when(F.col("stop_reason") != "none", F.col("stop_reason"))
        .when(F.col("live_checked") >= LIVE_BUDGET, F.lit("live-check-budget-exhausted"))
        .when(F.col("captured") >= CAPTURE_BUDGET, F.lit("capture-budget-exhausted"))
        .otherwise(F.lit("none"))
    )
    rows = rows.withColumn("effective_stop_reason", stop)
    status = F.when(F.col("returned") == limit, F.lit("complete")).when(F.col("effective_stop_reason") == "none", F.lit("needs-more-review")).otherwise(F.lit("confidence-shortfall"))
    return rows.withColumns({"status": status, "missing": F.greatest(F.lit(0), limit - F.col("returned")), "remaining_live_checks": LIVE_BUDGET - F.col("live_checked"), "remaining_captures": CAPTURE_BUDGET - F.col("captured")})


def maxsim(query_vectors: DataFrame, frames: DataFrame) -> DataFrame:
    """Rows (query_id, case_id, score): the mean over a query's vectors of the best cosine among a case's frames.

    The query's vectors, a stated set, go to the executors in blocks of a checked size; frames are dealt to tasks of so
    many pairs, multiplied as matrices, and the best per case and vector is taken before anything is shuffled.
    """
    from lodestone.operators.batches import bounded_batches
    from lodestone.operators.joins import BROADCAST_ROWS, small

    bounded_batches(frames.sparkSession)
    q = query_vectors.select("query_id", "q_idx", F.col("embedding").cast("array<double>").alias("v"))
    f = frames.select("case_id", F.col("embedding").cast("array<double>").alias("v"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(q, 'query_id')}, q_idx {kind(q, 'q_idx')}, case_id {kind(f, 'case_id')}, best double"
    n = 1 if small(query_vectors) else -(-2 * query_vectors.count() // BROADCAST_ROWS)
    rows = f.count()
    out = []
    for i in range(n):
        block = (q if n == 1 else q.where(F.pmod(F.xxhash64("query_id", "q_idx"), F.lit(n)) == i)).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        shared = frames.sparkSession.sparkContext.broadcast(block)
        tasks = -(-rows * block.num_rows // vectors.TASK_PAIRS)
        dealt = f if tasks <= 1 else f.repartition(tasks, F.xxhash64("v"), F.col("case_id"))
        out.append(dealt.mapInArrow(vectors.best_cosines(shared), schema))
    if not out:
        return frames.sparkSession.createDataFrame([], f"query_id {kind(q, 'query_id')}, case_id {kind(f, 'case_id')}, score double")
    best = reduce(DataFrame.unionByName, out).groupBy("query_id", "case_id", "q_idx").agg(F.max("best").alias("best"))
    return best.groupBy("query_id", "case_id").agg(F.avg("best").alias("score"))


def motion_ranking(intents: DataFrame, signatures: DataFrame, limit: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, channel, id, score, rank) of cases whose signature has something in common with the intent.

    ``intents`` has (query_id, intent struct), ``signatures`` (id, signature struct); empty intents rank nothing.
    ``limit`` keeps the first so many of a query. With ``allowed`` (id) only those cases are scored and ranked.
    """
    if allowed is not None:
        signatures = signatures.join(allowed.select(F.col("id").cast("string").alias("_allowed")).distinct(), F.trim(F.col("id").cast("string")) == F.col("_allowed"), "left_semi")
    return signature_scores(signatures, intents, limit, ranked=True).select("query_id", F.lit("motion").alias("channel"), "id", "score", "rank")


def fused_search(channels: list[DataFrame], allowed: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuses ranked channels (query_id, channel, id, rank); missing channels are simply absent."""
    rows = reduce(DataFrame.unionByName, [c.select("query_id", "channel", "id", "rank") for c in channels])
    return reciprocal_rank_fusion(rows, weights or SEARCH_WEIGHTS, allowed=allowed)


#: Results of an index search, at the most.
MOST_RESULTS = 10


def index_search(queries: DataFrame, cases: DataFrame, metadata_ranks: DataFrame, frames: dict[str, DataFrame], query_vectors: dict[str, DataFrame] | None,
                 signatures: DataFrame, references: DataFrame | None = None, policy: str = "auto", limit: int = 8) -> dict[str, DataFrame]:
    """Searches an index by all channels there are: ``results`` (with the cases' columns and channel scores), ``review`` and ``status``.

    ``queries`` has (query_id, intent); ``cases`` (id, ...) is the index's metadata and what results are allowed;
    ``metadata_ranks`` (query_id, channel, id, rank). ``frames`` maps full and dynamic to (case_id, embedding);
    ``query_vectors`` maps channels (full, dynamic, reference_full, reference_dynamic) to (query_id, q_idx, embedding),
    or is None without an encoder: then the status is degraded and only the other channels count. ``references``
    (query_id, signature) replaces the intent of its queries.
    """
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit is 1 to {MOST_RESULTS}")
    from lodestone.plans.storage import checkpointed

    scored = []
    for channel, q in (query_vectors or {}).items():
        found = maxsim(q, frames[channel.removeprefix("reference_")])
        scored.append(found.select("query_id", F.lit(channel).alias("channel"), F.col("case_id").cast("string").alias("id"), F.round("score", 9).alias("score")))
    intents = queries.select("query_id", "intent")
    if references is not None:
        own = references.select("query_id", F.col("signature").alias("_own"))
        intents = intents.join(own, "query_id", "left").select("query_id", F.coalesce("_own", "intent").alias("intent"))
    # only the index's cases can be results, and ranks count those alone: no other pair is scored
    known = cases.withColumn("id", F.col("id").cast("string"))
    ids = known.select("id").distinct()
    named = signatures.select(F.col("id").cast("string").alias("id"), "signature").join(ids, "id", "left_semi")
    moves = signature_scores(named, intents).select("query_id", F.lit("motion").alias("channel"), "id", "score")
    raw = checkpointed(reduce(DataFrame.unionByName, [*scored, moves]).join(ids, "id", "left_semi").select("query_id", "channel", "id", "score"))
    rankings = metadata_ranks.select("query_id", "channel", F.col("id").cast("string").alias("id"), "rank").unionByName(ranks(raw).select("query_id", "channel", "id", "rank"))
    allowed = rankings.join(ids, "id", "left_semi").select("query_id", "channel", "id", "rank")
    fused = reciprocal_rank_fusion(allowed, SEARCH_WEIGHTS)
    top = fused.where(F.col("rank") <= limit)
    values = raw.join(top.select("query_id", "id"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("channel", F.round("score", 5).alias("score")))).alias("channel_scores"))
    results = top.join(known, "id").join(values, ["query_id", "id"], "left")
    counts = top.groupBy("query_id").agg(F.count("*").alias("returned"))
    channels = allowed.groupBy("query_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    status = queries.select("query_id").join(counts, "query_id", "left").join(channels, "query_id", "left").fillna(0, ["returned"])
    status = status.withColumns({"status": F.lit("degraded" if query_vectors is None else "ok"), "shortfall": limit - F.col("returned")})
    return {"results": results, "review": review_routing(fused, allowed, policy, min(5, limit)), "status": status}
