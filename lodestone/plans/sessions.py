"""Registered queries of sessions, records, updates, filtered ladders and searches, and what SQL says they return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import helpers, text
from lodestone.operators import delivery, fusion, ladder, motion, signatures
from lodestone.plans import standin
from lodestone.plans.catalog import _CURVE, _HOST, _PATH, _QUERY, QUERIES, _fields_sql, _user_signatures, query, table  # noqa: F401
from lodestone.plans.standin import SQL, norm, units
from lodestone.sources import catalog as sources
from lodestone.sources import records
from lodestone.streaming import updates

# ---- curves and signatures

#: Eight means of each user's values, and their table of warped costs, a cell a step.
_BINS = f"""{_CURVE}, bin0 AS (SELECT user_id, v, len(v) AS n, least(8, len(v)) AS k FROM c),
bin1 AS (SELECT user_id, j, v[j * (n // k) + least(j, n % k) + 1 : j * (n // k) + least(j, n % k) + (n // k) + CASE WHEN j < n % k THEN 1 ELSE 0 END] AS part FROM (SELECT *, unnest(range(k)) AS j FROM bin0)),
bin2 AS (SELECT user_id, list(round(list_sum(part) / len(part), 9) ORDER BY j) AS curve FROM bin1 GROUP BY 1),
peak AS (SELECT user_id, list_transform(curve, lambda x: x / greatest(list_max(list_transform(curve, lambda y: abs(y))), 1e-9)) AS curve FROM bin2)"""
_DTW = f"""{_BINS}, cell(query_id, user_id, a, b, i, before, now) AS (
  SELECT l.user_id, r.user_id, r.curve, l.curve, 1::BIGINT, list_concat([0::DOUBLE], list_transform(l.curve, lambda x: 'Infinity'::DOUBLE)), ['Infinity'::DOUBLE] FROM peak l, peak r WHERE l.user_id % 50 = 0
  UNION ALL
  SELECT query_id, user_id, a, b, CASE WHEN len(now) > len(b) THEN i + 1 ELSE i END, CASE WHEN len(now) > len(b) THEN now ELSE before END,
    CASE WHEN len(now) > len(b) THEN ['Infinity'::DOUBLE] ELSE list_append(now, abs(a[i] - b[len(now)]) + least(now[len(now)], before[len(now) + 1], before[len(now)])) END
  FROM cell WHERE NOT (i = len(a) AND len(now) > len(b))),
dtw AS (SELECT query_id, user_id, greatest(0, 1 - least(1, now[len(b) + 1] / greatest(len(a), len(b)))) AS dtw FROM cell WHERE i = len(a) AND len(now) > len(b))"""


@query(f"WITH RECURSIVE {_DTW} SELECT query_id, user_id, round(dtw, 9) AS dtw FROM dtw")
def dtw(spark, sf_dir):
    from lodestone.functions import vectors

    c = motion.curves(table(spark, sf_dir, "events"), "user_id", "event_id", "value").select("user_id", vectors.curve_bins(F.col("curve"), digits=9).alias("curve"))
    asked = c.where("user_id % 50 = 0").select(F.col("user_id").alias("query_id"), "curve")
    return signatures.curve_scores(c, asked, "user_id").select("query_id", "user_id", "dtw")


_CATEGORY = "CASE WHEN {0}.{2} = {1}.{2} THEN 1.0 WHEN {0}.{2} = 'mixed' OR {1}.{2} = 'mixed' THEN 0.5 WHEN {0}.{2} = 'static' OR {1}.{2} = 'static' THEN 0.0 ELSE 0.15 END"
_SIGNATURES = f"""{_DTW},
wv AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
ws AS (SELECT user_id, sum(x * i / greatest(n - 1, 1)) / greatest(sum(x), 1e-9) AS c, max(x) AS top, min(i) FILTER (x = m) / greatest(max(n) - 1, 1) AS p FROM (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM wv) GROUP BY user_id),
sig AS (SELECT user_id, CASE WHEN top < 0.002 THEN 'static' WHEN c BETWEEN 0.35 AND 0.65 AND p BETWEEN 0.25 AND 0.75 THEN 'peaked' WHEN c < 0.4 THEN 'front-loaded' WHEN c > 0.6 THEN 'rear-loaded' ELSE 'even' END AS timing,
  ['up', 'mixed', 'static'][user_id % 3 + 1] AS dir FROM ws),
hist AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2), norms AS (SELECT user_id, sum(n * n) AS s FROM hist GROUP BY 1),
dots AS (SELECT a.user_id AS query_id, b.user_id, sum(a.n * b.n) AS d FROM hist a JOIN hist b USING (event_type) WHERE a.user_id % 50 = 0 GROUP BY 1, 2),
sim AS (SELECT l.user_id AS query_id, r.user_id AS id, round((1.2 * {_CATEGORY.format('l', 'r', 'dir')} + 0.8 * {_CATEGORY.format('l', 'r', 'timing')} + 1.2 * dtw.dtw + 1.0 * least(1, coalesce(d, 0) / sqrt(x.s * y.s))) / 4.2, 9) AS score
  FROM sig l JOIN sig r ON l.user_id % 50 = 0 JOIN dtw ON dtw.query_id = l.user_id AND dtw.user_id = r.user_id JOIN norms x ON x.user_id = l.user_id JOIN norms y ON y.user_id = r.user_id
  LEFT JOIN dots ON dots.query_id = l.user_id AND dots.user_id = r.user_id)"""


@query(f"WITH RECURSIVE {_SIGNATURES} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sim")
def signature_sim(spark, sf_dir):
    s = _user_signatures(spark, sf_dir)
    q = s.where("user_id % 50 = 0").select(F.col("user_id").alias("query_id"), F.col("signature").alias("intent"))
    found = fusion.motion_ranking(q, s.withColumnRenamed("user_id", "id"))
    return found.select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_UNIT = "list_dot_product({0}.embedding::DOUBLE[], {1}.embedding::DOUBLE[])"
_FUSED = f"""{_SIGNATURES},
ms AS (SELECT query_id, id, round(avg(best), 9) AS score FROM (SELECT a.vec_id // 50 AS query_id, b.label::VARCHAR AS id, max({_UNIT.format('a', 'b')} / (sqrt({_UNIT.format('a', 'a')}) * sqrt({_UNIT.format('b', 'b')}))) AS best
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 GROUP BY 1, 2) GROUP BY 1, 2),
ch AS (SELECT query_id, 'full' AS channel, id, score FROM ms UNION ALL SELECT query_id // 50, 'motion', id::VARCHAR, score FROM sim),
rk AS (SELECT query_id, channel, id, score, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS r FROM ch),
ok AS (SELECT query_id, channel, id, score, row_number() OVER (PARTITION BY query_id, channel ORDER BY r) AS r FROM rk WHERE id IN (SELECT DISTINCT label::VARCHAR FROM embeddings)),
fs AS (SELECT query_id, id, sum(CASE channel WHEN 'motion' THEN 0.8 ELSE 1.0 END / (60 + r)) AS s, count(*) AS channel_count FROM ok GROUP BY 1, 2),
fused AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank, round(s, 8) AS rrf_score, channel_count FROM fs)"""


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.expr("vec_id div 50").alias("query_id"), F.lit(0).alias("q_idx"), "embedding")
    return q, e.select(F.col("label").alias("case_id"), "embedding")


def _moves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = _user_signatures(spark, sf_dir)
    intents = s.where("user_id % 50 = 0").select(F.expr("user_id div 50").cast("long").alias("query_id"), F.col("signature").alias("intent"))
    return intents, s.select(F.col("user_id").cast("string").alias("id"), "signature")


@query(f"WITH RECURSIVE {_FUSED} SELECT query_id, id, rank, rrf_score, channel_count FROM fused")
def fused_search(spark, sf_dir):
    """Embedding and signature channels over the same cases, fused."""
    q, frames = _vectors(spark, sf_dir)
    full = fusion.maxsim(q, frames).select("query_id", F.lit("full").alias("channel"), F.col("case_id").cast("string").alias("id"), F.round("score", 9).alias("score"))
    cases = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("id"))
    moves = fusion.motion_ranking(*_moves(spark, sf_dir), allowed=cases)
    found = fusion.fused_search([fusion.ranks(full), moves], cases)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "rrf_score", "channel_count")


def _index_search(spark, sf_dir, encoder: bool) -> dict[str, DataFrame]:
    q, frames = _vectors(spark, sf_dir)
    intents, named = _moves(spark, sf_dir)
    cases = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("string").alias("id")).agg(F.count("*").alias("n_frames"))
    none = spark.createDataFrame([], "query_id long, channel string, id string, rank int")
    return fusion.index_search(intents, cases, none, {"full": frames}, {"full": q} if encoder else None, named, limit=5)


@query(f"""WITH RECURSIVE {_FUSED}, n AS (SELECT label::VARCHAR AS id, count(*) AS n_frames FROM embeddings GROUP BY 1)
SELECT query_id, id, rank, rrf_score, n_frames, (SELECT array_to_string(list(channel || '=' || round(score, 5)::DECIMAL(9, 5)::VARCHAR ORDER BY channel), ' ') FROM ok WHERE ok.query_id = fused.query_id AND ok.id = fused.id) AS channels FROM fused JOIN n USING (id) WHERE rank <= 5""")
def index_search(spark, sf_dir):
    """Results with the cases' columns and the score of each channel that has the case."""
    r = _index_search(spark, sf_dir, True)["results"]
    names = F.array_join(F.transform("channel_scores", lambda c: F.concat(c["channel"], F.lit("="), c["score"].cast("decimal(9,5)").cast("string"))), " ")
    return r.select("query_id", "id", F.col("rank").cast("long").alias("rank"), "rrf_score", "n_frames", names.alias("channels"))


@query(f"""WITH RECURSIVE {_SIGNATURES}, t AS (SELECT query_id // 50 AS query_id, count(*) AS n FROM sim WHERE id IN (SELECT label FROM embeddings) GROUP BY 1)
SELECT query_id, 'degraded' AS status, least(n, 5) AS returned, 5 - least(n, 5) AS shortfall, 'motion' AS channels FROM t""")
def degraded_search(spark, sf_dir):
    """Without an encoder only the signatures count, and the status says so."""
    s = _index_search(spark, sf_dir, False)["status"]
    return s.select("query_id", "status", "returned", "shortfall", F.array_join("channels", ",").alias("channels"))


@query("""WITH d AS (SELECT user_id, (event_id % 628 / 100) AS angle, value AS m FROM events), n AS (SELECT user_id, floor(angle / (2 * pi()) * 8)::INT % 8 AS place, m FROM d), s AS (SELECT user_id, sum(m) AS total FROM n GROUP BY 1)
SELECT s.user_id, p.name AS direction, round(coalesce((SELECT sum(m) FROM n WHERE n.user_id = s.user_id AND n.place = p.place), 0) / total, 3) AS share
FROM s, (VALUES (0, 'right'), (1, 'down-right'), (2, 'down'), (3, 'down-left'), (4, 'left'), (5, 'up-left'), (6, 'up'), (7, 'up-right')) p(place, name)""")
def direction_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 628 / 100).alias("angle"), F.col("value").alias("magnitude"))
    h = motion.direction_histogram(e, "user_id", digits=9)
    return h.select("user_id", F.explode("direction_histogram").alias("direction", "share")).select("user_id", "direction", F.round("share", 3).alias("share"))


# ---- ordered duplicates


_FOLD_KEY = f"'k:' || {_HOST} || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || '?' || array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '')), '&')"


@query(f"""WITH RECURSIVE p AS (SELECT page_id, {_FOLD_KEY} AS key, 'l:' || regexp_extract(html, 'href="([^"]*)"', 1) AS link, row_number() OVER (ORDER BY page_id) AS i FROM pages),
fold(i, seen, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::BIGINT UNION ALL
  SELECT p.i, CASE WHEN list_has_any(seen, [key, link]) THEN seen ELSE list_concat(seen, [key, link]) END, CASE WHEN list_has_any(seen, [key, link]) THEN NULL ELSE page_id END FROM fold JOIN p ON p.i = fold.i + 1)
SELECT kept AS page_id FROM fold WHERE kept IS NOT NULL""")
def first_seen(spark, sf_dir):
    """Pages in order of their id, without those whose canonical url or first link target came before."""
    from lodestone.functions import urls
    from lodestone.operators import ranking

    p = table(spark, sf_dir, "pages").select("page_id", urls.curation_key(F.col("url")).alias("key"), F.regexp_extract("html", 'href="([^"]*)"', 1).alias("link"))
    return ranking.first_seen(p, "page_id", ["key", "link"]).select("page_id")


# ---- sessions


def _candidates(spark, sf_dir) -> DataFrame:
    """Pages as candidates of five queries."""
    p = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    return p.select((k % 5).alias("query_id"), F.concat(F.lit("p"), k.cast("string")).alias("item_id"), "url", (k * 7919 % 1009).alias("score"), (k % 11).alias("k"))


_CAND = "cand AS (SELECT page_id % 5 AS query_id, 'p' || page_id AS item_id, url, page_id * 7919 % 1009 AS score, page_id % 11 AS k FROM pages)"
_PAGE_KEY = f"{_HOST} || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || '?' || array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '')), '&')"


@query(f"""WITH {_CAND}, keyed AS (SELECT *, {_PAGE_KEY} AS key FROM cand), shown AS (SELECT query_id, item_id, key FROM keyed WHERE k IN (0, 3)),
left_ AS (SELECT * FROM keyed c WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.query_id = c.query_id AND (s.item_id = c.item_id OR s.key = c.key))),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, item_id) AS f FROM left_) WHERE f = 1)
SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM once) WHERE rank <= 3""")
def next_page(spark, sf_dir):
    """The next three candidates of each query, without what was shown."""
    c = _candidates(spark, sf_dir)
    page = delivery.next_page(c, c.where("k in (0, 3)"), [F.col("score").desc(), F.col("item_id")], delivery.EVIDENCE_PAGE)
    return page.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_CAND} SELECT query_id, item_id, k % 4 = 0 AS supplement FROM cand WHERE k % 4 <> 0 OR query_id = 2")
def code_first(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("support_kind", F.when(F.col("k") % 4 == 0, F.lit("video-only")).when(F.col("k") % 4 == 1, F.lit("code")))
    may = spark.range(1).select(F.lit(2).cast("long").alias("query_id"))
    return delivery.code_first(c, may).select("query_id", "item_id", "supplement")


@query(f"WITH {_CAND} SELECT query_id, item_id, CASE k WHEN 1 THEN 'render_verified' ELSE 'capture_restricted' END AS state FROM cand WHERE k IN (1, 5)")
def quick_list(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    state = F.when(F.col("k") == 1, F.lit("render_verified")).when(F.col("k") == 5, F.lit("capture_restricted")).when(F.col("k") == 7, F.lit("broken")).otherwise(F.lit("shell_reachable"))
    return delivery.healthy(c, c.where("k <> 8").select("item_id", state.alias("state"))).select("query_id", "item_id", "state")


@query("""WITH RECURSIVE e AS (SELECT user_id AS query_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
r(query_id, step, formal, checked, captured, failed, stop) AS (SELECT DISTINCT query_id, 0::BIGINT, 0, 0, 0, 0, NULL::VARCHAR FROM e UNION ALL
  SELECT query_id, step, f, c, p, x, CASE WHEN f >= 8 THEN 'complete' WHEN c >= 24 THEN 'live-check-budget-exhausted' WHEN p >= 16 THEN 'capture-budget-exhausted' WHEN x >= 3 THEN 'three-failures' WHEN stopped THEN 'user-stopped' END FROM (
    SELECT e.query_id, e.step, formal + (event_type = 'click' AND event_id % 3 = 0)::INT AS f, checked + (event_id % 97 <> 0)::INT AS c, captured + (event_id % 97 <> 0 AND event_type IN ('click', 'view'))::INT AS p,
      CASE WHEN event_id % 97 <> 0 AND event_type = 'error' THEN failed + 1 ELSE 0 END AS x, event_id % 97 = 0 AS stopped FROM r JOIN e ON e.query_id = r.query_id AND e.step = r.step + 1 WHERE stop IS NULL))
SELECT query_id, step, stop FROM r WHERE step > 0""")
def review_stop(spark, sf_dir):
    """Each user's events as a review: clicks and views are captured, errors failed; it ends where a condition holds."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    outcome = F.when(k % 97 == 0, F.lit("stopped")).when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type").isin("click", "view"), F.lit("captured")).otherwise(F.lit("checked"))
    rows = e.select(F.col("user_id").alias("query_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("step"), outcome.alias("outcome"), ((F.col("event_type") == "click") & (k % 3 == 0)).alias("formal"))
    return delivery.review_stop(rows).select("query_id", "step", "stop")


@query(f"WITH {_CAND} SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY k % 4 = 0, score % 3 DESC, score % 5 DESC, k DESC, score % 2 DESC, score % 7 DESC, score % 13, item_id) AS rank FROM cand")
def final_priority(spark, sf_dir):
    from pyspark.sql import Window

    s, k = F.col("score"), F.col("k")
    c = _candidates(spark, sf_dir).withColumns({"supplement": k % 4 == 0, "readiness": s % 3, "fit": s % 5, "capability": k, "license": s % 2, "health": s % 7, "cost": s % 13})
    return c.select("query_id", "item_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*delivery.priority_order())).cast("long").alias("rank"))


@query(f"""WITH {_CAND} SELECT item_id, CASE WHEN k % 3 = 0 THEN 'snippet' WHEN k % 5 = 0 THEN 'package' WHEN k = 7 THEN NULL WHEN k % 2 = 0 THEN 'asset' ELSE 'recreate' END AS level,
CASE WHEN k % 3 = 0 THEN '' WHEN k % 5 = 0 THEN 'snippet' WHEN k = 7 THEN 'snippet,package,asset,recreate' WHEN k % 2 = 0 THEN 'snippet,package' ELSE 'snippet,package,asset' END AS rejected FROM cand""")
def delivery_route(spark, sf_dir):
    k = F.col("k")
    route = delivery.delivery_route({"snippet": k % 3 == 0, "package": F.when(k % 5 == 0, F.lit(True)), "asset": (k % 2 == 0) & (k != 7), "recreate": k != 7})
    return _candidates(spark, sf_dir).withColumn("r", route).select("item_id", "r.level", F.array_join("r.rejected", ",").alias("rejected"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag <> 'N')")
def retry_ids(spark, sf_dir):
    """Orders as records, first lines as results of an audit: flag N is dynamic."""
    r = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") == "N", F.lit("dynamic")).otherwise(F.lit("static")).alias("state"))
    return delivery.to_retry(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), r)


_RECORDS = "rec AS (SELECT page_id, page_id % 60 AS site_id, CASE page_id % 3 WHEN 0 THEN 'public-list-api' WHEN 1 THEN 'public-sitemap' END AS evidence_kind, url FROM pages)"


def _records(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", (k % 60).cast("string").alias("site_id"), F.when(k % 3 == 0, F.lit("public-list-api")).when(k % 3 == 1, F.lit("public-sitemap")).alias("evidence_kind"), "url")


@query(f"WITH {_RECORDS} SELECT page_id, 'page' AS mode FROM rec WHERE evidence_kind IS DISTINCT FROM 'public-list-api' AND site_id IN (1, 2, 4) UNION ALL SELECT page_id, 'media' FROM rec WHERE evidence_kind = 'public-list-api' AND site_id = 6")
def audit_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    page = delivery.to_audit(r, sources=("1", "2", "4")).select("page_id", F.lit("page").alias("mode"))
    return page.unionByName(delivery.to_audit(r, "media", "6").select("page_id", F.lit("media").alias("mode")))


@query(f"WITH {_RECORDS} SELECT page_id, evidence_kind = 'public-sitemap' AND site_id = 1 AND NOT starts_with(url, 'https://') AS pruned FROM rec WHERE site_id IN (1, 2) AND evidence_kind IS NOT NULL")
def prune_ineligible(spark, sf_dir):
    r = _records(spark, sf_dir).where("site_id in ('1', '2') and evidence_kind is not null")
    kept, gone = delivery.prune(r, {"1": F.col("url").startswith("https://")})
    return kept.select("page_id", F.lit(False).alias("pruned")).unionByName(gone.select("page_id", F.lit(True).alias("pruned")))


# ---- sources


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'alibaba-domain-block' WHEN 3 THEN 'alibaba-verification-block' END AS restriction, CASE WHEN page_id % 4 IN (0, 3) THEN 'restricted' WHEN page_id % 8 = 1 THEN 'missing' ELSE 'shell-reachable' END AS state FROM pages")
def http_markers(spark, sf_dir):
    """A page that speaks of a captcha is not restricted; a marker beyond 32 KB is not seen."""
    k = F.col("page_id")
    body = F.when(k % 4 == 0, F.concat(F.left("html", F.lit(100)), F.lit("<title>域名拦截</title>"))).when(k % 4 == 1, F.lit("please solve this captcha")).when(k % 4 == 2, F.concat(F.repeat(F.lit("x"), F.lit(40000)), F.lit("域名不在安全策略默认允许的范围内"))).otherwise(F.lit("长期未使用或首次查看拦截详情时"))
    landed = table(spark, sf_dir, "pages").select("page_id", "url", F.col("url").alias("final_url"), F.when(k % 8 == 1, F.lit(404)).otherwise(F.lit(200)).alias("status"), body.alias("body"))
    return sources.http_checks(landed).select("page_id", "restriction", F.col("http_state").alias("state"))


_LISTING = records.Listing(
    "shop", "Shop item", "shop-", "https://shop.example/items/", "media.example", ("web", "script"),
    (("m-red", ("red", "rose"), "loop"), ("m-large", ("large", "promo brushed"), "click"), ("m-green", ("green",), "hover"), ("m-tin", ("tin", "steel"), "click")),
    rights_note="ask first",
)


def _items(spark, sf_dir) -> DataFrame:
    """Parts as items of an API."""
    k = F.col("p_partkey")
    host = F.when(k % 7 == 0, F.lit("http://media.example/v")).when(k % 11 == 0, F.lit("https://media.example.org/v")).otherwise(F.lit("https://media.example/v"))
    files = F.array(F.struct(F.lit("https://media.example/x.zip").alias("file_url")), F.struct(F.when(k % 5 != 0, F.concat(F.lit("https://media.example/f"), k.cast("string"), F.lit(".riv"))).alias("file_url")))
    revision = F.struct(
        (k + 1000).alias("community_revision_id"), F.concat(F.lit("1-2-"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("slug"), F.when(k % 3 == 0, F.lit(" Untitled ")).otherwise(F.col("p_name")).alias("title"),
        F.col("p_type").alias("description"), F.array("p_brand").alias("tags"), F.concat(host, k.cast("string"), F.lit(".mp4")).alias("video_url"),
        (k % 13).alias("video_width"), F.lit(20).alias("video_height"), (k % 2 == 0).alias("is_animation_state_machine"), files.alias("community_files"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(k.alias("community_post_id"), F.array(revision).alias("community_revisions"))).alias("item"))


_HAS = "regexp_matches(words, '(?:^|[^a-z0-9])(?:{0})(?:$|[^a-z0-9])')"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey || '-' || (p_partkey + 1000) AS key, '1-2-' || replace(p_name, ' ', '-') AS slug, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name END AS title, lower(p_name || ' ' || p_type || '   ' || p_brand) AS words0, p_partkey % 2 = 0 AS machine
 FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 13 <> 0),
w AS (SELECT *, words0 AS words FROM p), f AS (SELECT *, list_filter([CASE WHEN {_HAS.format('red|rose')} THEN 'm-red:loop' END, CASE WHEN {_HAS.format('large|promo brushed')} THEN 'm-large:click' END, CASE WHEN {_HAS.format('green')} THEN 'm-green:hover' END, CASE WHEN {_HAS.format('tin|steel')} THEN 'm-tin:click' END], lambda x: x IS NOT NULL)[1:3] AS fits FROM w),
g AS (SELECT *, CASE WHEN len(fits) > 0 THEN fits WHEN machine THEN ['interactive-state-machine:click'] ELSE ['ambient-illustration-loop:loop'] END AS got FROM f)
SELECT 'shop-' || key AS id, title, 'https://shop.example/items/' || slug || '/' AS url, array_to_string(list_transform(got, lambda x: string_split(x, ':')[1]), ',') AS motions, string_split(got[1], ':')[2] AS trigger,
 CASE WHEN string_split(got[1], ':')[2] = 'loop' THEN 1600 ELSE 1000 END AS settle_ms, CASE WHEN string_split(got[1], ':')[2] = 'loop' THEN 'clip' ELSE 'storyboard' END AS evidence, 'https://media.example/f' || p_partkey || '.riv' AS runtime,
 array_to_string(list_sort(list_distinct(regexp_extract_all(words, '[a-z0-9][a-z0-9-]+')))[1:24], ' ') AS terms FROM g""")
def marketplace_records(spark, sf_dir):
    """Parts as API items: those without a safe video, size or runtime file give no record."""
    r = records.marketplace_records(_items(spark, sf_dir), _LISTING, "2024-01-01").where("record is not null")
    return r.select(
        "record.id", "record.title", "record.url", F.array_join("record.motion_ids", ",").alias("motions"), F.col("record.trigger.kind").alias("trigger"), "record.trigger.settle_ms",
        F.col("record.capture.recommended_evidence").alias("evidence"), F.col("record.source_evidence.runtime_file_url").alias("runtime"), F.array_join("record.search_terms", " ").alias("terms"),
    )


@query("""WITH RECURSIVE p AS (SELECT c_custkey AS cursor, (c_custkey * 7 + 3) % 1009 AS next_cursor, CASE WHEN c_custkey % 211 = 0 THEN 0 ELSE c_custkey % 4 + 1 END AS n FROM customer WHERE c_custkey < 1009),
walk(page_no, cursor, next_cursor, n, seen) AS (SELECT 0::BIGINT, cursor, next_cursor, n, [cursor] FROM p WHERE cursor = 5 AND n > 0 UNION ALL
  SELECT page_no + 1, p.cursor, p.next_cursor, p.n, list_append(seen, p.cursor) FROM walk JOIN p ON p.cursor = walk.next_cursor WHERE p.n > 0 AND NOT list_contains(seen, p.cursor)),
s AS (SELECT *, sum(n) OVER (ORDER BY page_no) - n AS before FROM walk)
SELECT page_no, pos::INTEGER AS pos, 'i' || cursor || '-' || pos AS item FROM (SELECT page_no, cursor, before, unnest(range(n)) AS pos FROM s) WHERE before + pos < 100""")
def cursor_pages(spark, sf_dir):
    """Customers as landed pages that name the next one; followed from page 5 on, up to 100 items."""
    k = F.col("c_custkey")
    n = F.when(k % 211 == 0, F.lit(0)).otherwise((k % 4 + 1).cast("int"))
    item = lambda i: F.concat(F.lit("i"), k.cast("string"), F.lit("-"), i.cast("string"))
    some = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), item)).otherwise(F.array().cast("array<string>"))
    pages = table(spark, sf_dir, "customer").where("c_custkey < 1009").select(k.cast("string").alias("cursor"), ((k * 7 + 3) % 1009).cast("string").alias("next_cursor"), some.alias("items"))
    return records.taken(records.follow_cursors(pages, "5"), 100)


# ---- updates and helpers


@query("""SELECT o_orderkey AS client, CASE o_orderkey % 5 WHEN 0 THEN 'not-modified' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'invalid' WHEN 3 THEN 'unreachable' ELSE 'ok' END AS fetch,
 CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'e' || o_custkey WHEN o_orderkey % 5 = 4 THEN 'n' || o_orderkey END AS etag,
 CASE WHEN o_orderkey % 5 = 0 AND o_custkey % 4 = 0 THEN '{"v":1}' WHEN o_orderkey % 5 = 4 THEN '{"v":2}' END AS manifest FROM orders""")
def conditional_fetch(spark, sf_dir):
    """Orders as fetches: a 304 takes what the client had, if it had something."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    checks = o.select(k.alias("client"), F.when(k % 5 == 0, F.lit(304)).when(k % 5 == 1, F.lit(503)).when(k % 5 != 3, F.lit(200)).alias("http_status"), F.concat(F.lit("n"), k.cast("string")).alias("etag"), F.when(k % 5 == 2, F.lit("[1]")).otherwise(F.lit('{"v":2}')).alias("manifest"))
    state = o.where(c % 2 == 0).select(k.alias("client"), F.concat(F.lit("e"), c.cast("string")).alias("etag"), F.when(c % 4 == 0, F.lit('{"v":1}')).alias("manifest"))
    return updates.conditional_fetch(checks, state).select("client", "fetch", "etag", "manifest")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS day, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS code, event_id % 5 < 2 AS allowed FROM events")
def job_helpers(spark, sf_dir):
    k = F.col("event_id")
    at = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 3 == 1, F.lit("2024-13-01T00:00:00Z")).otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm"))
    status = F.get(F.array(*map(F.lit, ("error", "invalid_manifest", "current", "disabled"))), (k % 4).cast("int"))
    url = F.get(F.array(*map(F.lit, ("https://Host.example/a", "https://user@host.example:443/b", "https://host.example.org/", "host.example", "https://a.host.example/"))), (k % 5).cast("int"))
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format(helpers.report_date(at), "yyyy-MM-dd").alias("day"), updates.exit_code(status).alias("code"), updates.host_allowed(url, ("HOST.example",)).alias("allowed"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'left' WHEN item_id % 3 = 0 THEN 'up' END AS dir, CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS n_curve FROM benchmark""")
def load_intent(spark, sf_dir):
    k = F.col("item_id")
    given = F.when(k % 2 == 0, F.lit('{"dominant_direction":"left","activity_curve":[0.5,1]}')).when(k % 5 == 0, F.lit(" "))
    asked = F.when(k % 3 == 0, F.lit("Slide  UP gently")).otherwise(F.lit("nothing of it"))
    i = table(spark, sf_dir, "benchmark").select("item_id", helpers.load_intent(given, asked).alias("i"))
    return i.select("item_id", F.col("i.dominant_direction").alias("dir"), F.coalesce(F.size("i.activity_curve"), F.lit(0)).alias("n_curve"))


# ---- scripts without spaces


#: Texts with CJK runs, one for each benchmark row in turn.
_CJK = ("春天动效 Hero", "页面过渡fade 动画", "按钮 点击 UI", "SaaS首屏hero 首屏", "卡", "卡片动 效果 v1.2", "no such run")
_CJK_SQL = "[" + ", ".join(f"'{t}'" for t in _CJK) + "][item_id % 7 + 1]"
_CJK_RUNS = "regexp_extract_all(t, '[\\x{3400}-\\x{9fff}]+')"
_PAIRS = "flatten(list_transform(list_filter(runs, lambda r: length(r) > 1), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i::INTEGER, 2))))"


@query(f"""WITH t AS (SELECT item_id, {norm(_CJK_SQL)} AS t FROM benchmark), r AS (SELECT item_id, t, {_CJK_RUNS} AS runs, regexp_extract_all(t, '[a-z0-9][a-z0-9.+#-]*') AS latin FROM t)
SELECT item_id, array_to_string(list_sort(list_distinct(list_concat(latin, flatten(list_transform(runs, lambda r: regexp_extract_all(r, '.'))), {_PAIRS}))), ' ') AS units,
 array_to_string(list_sort(list_filter(list_distinct(list_concat(list_filter(latin, lambda u: length(u) >= 2), list_filter(runs, lambda r: length(r) > 1), {_PAIRS})), lambda u: u NOT IN ('animation', 'effect', 'motion', 'style', 'ui', '动效', '动画', '效果', '风格'))), ' ') AS lexical FROM r""")
def cjk_units(spark, sf_dir):
    """Search units and lexical units of texts in both scripts."""
    raw = F.get(F.array(*map(F.lit, _CJK)), (F.col("item_id") % 7).cast("int"))
    n = table(spark, sf_dir, "benchmark").select("item_id", text.normalize_text(raw).alias("t"))
    joined = lambda c: F.array_join(F.array_sort(c), " ")
    return n.select("item_id", joined(text.text_units(F.col("t"))).alias("units"), joined(text.lexical_units(F.col("t"))).alias("lexical"))


# ---- ladder with filters


def _taxonomy_sql() -> str:
    from lodestone.operators import scoring

    def points(source: str, key: str, fields) -> str:
        values = _fields_sql(source, key, fields)
        return f"""SELECT query_id, {key}, round(sum(pts), 3) AS score FROM (
 SELECT query_id, {key}, w * 4 AS pts FROM queries, ({values}) v WHERE {norm('value')} <> '' AND contains({norm('query')}, {norm('value')})
 UNION ALL SELECT query_id, {key}, w FROM (SELECT {key}, w, unnest({units('value')}) AS u FROM ({values})) JOIN (SELECT query_id, unnest({units('query')}) AS u FROM queries) USING (u)) GROUP BY 1, 2"""

    return f"""{SQL}, mp AS ({points('motions', 'motion_id', scoring.MOTION_FIELDS)}), ip AS ({points('items', 'item_id', scoring.ITEM_FIELDS)}),
best AS (SELECT query_id, motion_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, motion_id) AS motion_rank, max(score) OVER (PARTITION BY query_id) AS top, score AS s0
  FROM queries CROSS JOIN motions LEFT JOIN mp USING (query_id, motion_id)),
chosen AS (SELECT query_id, motion_id, score, motion_rank FROM best WHERE (s0 > 0 OR top IS NULL) AND motion_rank <= 3),
sscore AS (SELECT site_id, motion_id, round((1 + CASE WHEN list_contains(site_kinds, kind) THEN 4 ELSE 0 END + 0.5 * len(list_intersect(s.stacks, m.stacks)) + 0.75 * len(list_intersect(tags, list_append(feel, category)))
  + 2 + CASE WHEN license_status = 'explicit' THEN 0.75 ELSE 0 END) * CASE WHEN status = 'degraded' THEN 0.5 ELSE 1 END, 3)::DOUBLE AS site_score FROM sites s, motions m WHERE list_contains(capabilities, 'snippet'))"""


@query(f"""WITH {_taxonomy_sql()}, f AS (SELECT c.query_id, c.motion_id, c.motion_rank, i.item_id, i.site_id, round(c.score + coalesce(ip.score, 0), 3) AS score, last_verified IS NULL AS late, coalesce(ip.score, 0) AS own, site_score, last_check
  FROM chosen c JOIN (SELECT *, unnest(list_distinct(motion_ids)) AS motion_id FROM items) i USING (motion_id) JOIN sscore USING (site_id, motion_id) LEFT JOIN ip ON ip.query_id = c.query_id AND ip.item_id = i.item_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, motion_id ORDER BY late, own DESC, site_score DESC, last_check DESC, item_id) AS r, row_number() OVER (PARTITION BY query_id, motion_id, site_id ORDER BY late, own DESC, site_score DESC, last_check DESC, item_id) AS rs,
  count(*) OVER (PARTITION BY query_id, motion_id) AS n FROM f)
SELECT query_id, motion_id, motion_rank, item_id, score, item_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, motion_id ORDER BY CASE WHEN n > 6 AND rs > 2 THEN 1 ELSE 0 END, r) AS item_rank FROM o) WHERE item_rank <= 6""")
def taxonomy_items(spark, sf_dir):
    """The items of each query's taxonomy rows on sites that offer snippets, by the five levels of their order."""
    items, motions, queries, sites = standin.items(spark, sf_dir), standin.motions(spark), standin.queries(spark), standin.sites(spark, sf_dir)
    best = ladder.best_motions(motions, queries, 3)
    found = ladder.taxonomy_items(items, motions, queries, best, 6, sites, capability="snippet")
    return found.select("query_id", "motion_id", F.col("motion_rank").cast("long").alias("motion_rank"), "item_id", "score", F.col("item_rank").cast("long").alias("item_rank"))


@query(f"""WITH {_taxonomy_sql()}, t AS (SELECT *, row_number() OVER (PARTITION BY motion_id ORDER BY site_score DESC, site_id) AS site_rank FROM sscore)
SELECT query_id, motion_id, site_id, site_score, site_rank FROM chosen JOIN t USING (motion_id) WHERE site_rank <= 3""")
def motion_sites(spark, sf_dir):
    motions, queries, sites = standin.motions(spark), standin.queries(spark), standin.sites(spark, sf_dir)
    found = ladder.motion_sites(sites, motions, ladder.best_motions(motions, queries, 3), 3, capability="snippet")
    return found.select("query_id", "motion_id", "site_id", "site_score", F.col("site_rank").cast("long").alias("site_rank"))


# ---- streams


@query("SELECT DISTINCT event_id, user_id FROM events")
def first_seen_stream(spark, sf_dir):
    from lodestone.plans.catalog import _event_stream

    stream = _event_stream(spark, sf_dir)
    return updates.run_available(updates.first_seen_stream(stream, "event_id", "ts").select("event_id", "user_id"), "first_seen")


@query("""WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, event_type AS version, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i FROM events),
w(client, i, version, ts, told) AS (SELECT DISTINCT client, 0::BIGINT, NULL::VARCHAR, NULL::TIMESTAMP, false FROM e UNION ALL
  SELECT client, i, CASE WHEN tell THEN new_version ELSE version END, CASE WHEN tell THEN new_ts ELSE ts END, tell FROM (
    SELECT w.client, e.i, w.version, w.ts, e.version AS new_version, e.ts AS new_ts, (w.version IS NULL OR e.version <> w.version OR epoch(e.ts) - epoch(w.ts) >= 168 * 3600) AS tell FROM w JOIN e ON e.client = w.client AND e.i = w.i + 1))
SELECT client, version, ts AS "at" FROM w WHERE told""")
def update_notices(spark, sf_dir):
    from lodestone.plans.catalog import _event_stream

    stream = _event_stream(spark, sf_dir)
    offers = stream.select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("version"), F.col("ts").alias("at"))
    return updates.run_available(updates.notices(offers), "notices")



# ---- SQL names


@query(f"""SELECT page_id, {norm('url')} AS norm, contains({norm('url')}, 'example.org') AS has, left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 20) AS slug,
 CASE WHEN page_id % 2 = 0 THEN '2024-02-0' || (page_id % 9 + 1) END AS day, {_HOST} AS host FROM pages""")
def sql_functions(spark, sf_dir):
    """The registered functions, in SQL."""
    from lodestone.plans import sql

    sql.register(spark)
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return spark.sql(
        """SELECT page_id, normalize_text(url) AS norm, contains_term(url, ' Example.ORG') AS has, slug(url, 20) AS slug,
        date_format(report_day(CASE WHEN page_id % 2 = 0 THEN concat('2024-02-0', page_id % 9 + 1, 'T00:00') ELSE '2024-2-1' END), 'yyyy-MM-dd') AS day, url_host(url) AS host FROM {p}""", p=p)  # fmt: skip


@query("SELECT page_id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages)")
def sql_links(spark, sf_dir):
    """The table function of links, in SQL."""
    from lodestone.plans import sql

    sql.register(spark)
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    return spark.sql("SELECT page_id, l.pos, l.href FROM {p}, LATERAL page_links(html) l", p=p)
