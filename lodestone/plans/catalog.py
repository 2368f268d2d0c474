"""Registered queries of the engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text, urls, vectors
from lodestone.operators import curation, fusion, joins, ladder, lexical, motion, ranking, scoring
from lodestone.plans import standin
from lodestone.plans.standin import SQL, norm, units
from lodestone.plans.standin import lexical as lexical_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(c: str) -> Column:
    return F.md5(F.array_join(F.array_sort(c), " ").cast("binary"))


# ---- text

_REST = "case when position('://' in url) > 0 then regexp_replace(url, '^[^:]*://', '') else '' end"
_HOST = f"lower(regexp_extract({_REST}, '^([^/?#:]*)', 1))"
_PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"
_QUERY = f"regexp_extract({_REST}, '^[^?#]*\\?([^#]*)', 1)"


@query(f"SELECT doc_id, md5({norm('text')}) AS norm FROM documents")
def norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text")).cast("binary")).alias("norm"))


@query(f"SELECT doc_id, len({units('text')}) AS n, md5(array_to_string(list_sort({units('text')}), ' ')) AS units FROM documents")
def text_units(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", text.text_units(text.normalize_text(F.col("text"))).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n"), _joined("u").alias("units"))


@query(f"SELECT doc_id, len({lexical_sql('text')}) AS n, md5(array_to_string(list_sort({lexical_sql('text')}), ' ')) AS units FROM documents")
def lexical_units(spark, sf_dir):
    u = table(spark, sf_dir, "documents").select("doc_id", text.lexical_units(text.normalize_text(F.col("text"))).alias("u"))
    return u.select("doc_id", F.size("u").cast("long").alias("n"), _joined("u").alias("units"))


@query("SELECT doc_id, contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), 'the an') AS has FROM documents")
def contains_term(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.contains_term(F.col("text"), F.lit(" The  an ")).alias("has"))


@query("""SELECT p_partkey, CASE WHEN p_size < p_partkey % 50 THEN -1 WHEN p_size > p_partkey % 50 THEN 1 WHEN p_partkey % 7 > 0 THEN 1 ELSE 0 END AS cmp FROM part""")
def version_compare(spark, sf_dir):
    k = F.col("p_partkey")
    left = F.concat_ws(".", F.col("p_size"), k % 7)
    return table(spark, sf_dir, "part").select("p_partkey", text.compare_versions(left, F.concat(F.lit("v"), k % 50)).alias("cmp"))


@query("SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), 12) AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!")), 12).alias("slug"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(replace(p_name, ' ', '-')) || '-3d-UI', '-'),
 lambda p: CASE p WHEN '3d' THEN '3D' WHEN 'ui' THEN 'UI' ELSE upper(p[1]) || lower(p[2:]) END), ' ') AS title FROM part""")
def slug_title(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug_title(F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("-3d-UI"))).alias("title"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9-]+')))[1:24], ' ') AS terms FROM documents")
def search_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.search_terms(F.col("text")), " ").alias("terms"))


_MESSAGE = "CASE event_id % 4 WHEN 0 THEN 'Error fetching DATA ' || event_id WHEN 1 THEN 'the project ' || event_id || ' was not found' WHEN 2 THEN 'failed to load resource: ' || (400 + event_id % 12) ELSE 'fine' END"


@query(f"SELECT event_id, regexp_matches({_MESSAGE}, '(?i)error fetching data') OR regexp_matches({_MESSAGE}, '(?i)project[^\\n]*(?:not found|does not exist|unavailable)') OR regexp_matches({_MESSAGE}, '(?i)failed to load resource[^\\n]*(?:404|410)') AS broken FROM events")
def error_patterns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.has_content_error(F.expr(_MESSAGE)).alias("broken"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def _intent_sql() -> str:
    t = "regexp_replace(lower(text), '\\s+', ' ', 'g')"
    case = lambda choices: "CASE " + " ".join(f"WHEN {' OR '.join(f"contains({t}, '{x}')" for x in terms)} THEN '{name}'" for name, terms in choices) + " END"
    return f"SELECT item_id, {', '.join(f'{case(c)} AS {f}' for f, c in text.INTENT_TERMS.items())} FROM benchmark"


@query(_intent_sql())
def motion_intent(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", *[c.alias(k) for k, c in text.motion_intent(F.col("text")).items()])


@query(f"WITH {SQL} SELECT query_id, query || CASE WHEN len(t) > 0 THEN ' | ' || array_to_string(t, ' ') ELSE '' END AS last_variant FROM (SELECT query_id, query, list_filter(list_transform((SELECT list(terms ORDER BY group_id) FROM syn), lambda ts: list_filter(ts, lambda x: regexp_matches(x, '[a-z]') AND NOT contains(query, x))[1]), lambda x: x IS NOT NULL) AS t FROM queries)")
def query_variants(spark, sf_dir):
    g = standin.groups(spark).agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "terms"))), lambda x: x["terms"]).alias("g"))
    return standin.queries(spark).join(F.broadcast(g)).select("query_id", F.element_at(text.query_variants(F.col("query"), F.col("g")), -1).alias("last_variant"))


# ---- urls


@query(f"SELECT page_id, (starts_with(url, 'https://') AND {_HOST} = 'tionsh.example.net' AND regexp_matches({_PATH}, '^/(?:en|fr)/[0-9]+/?$') AND regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1) NOT IN ('15') AND {_QUERY} = '' AND NOT contains(url, '#')) AS ok FROM pages")
def url_allowlist(spark, sf_dir):
    ok = urls.is_allowed(F.col("url"), "tionsh.example.net", "/(?:en|fr)/[0-9]+/?", ("15",), plain_only=True)
    return table(spark, sf_dir, "pages").select("page_id", ok.alias("ok"))


_KEPT = f"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')), '&')"


@query(f"SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https://' || lower(regexp_extract({_REST}, '^([^/?#]*)', 1)) || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END END AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.ranking_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {_HOST} || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END || '?' || array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '')), '&') AS key FROM pages")
def canonical_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.curation_key(F.col("url")).alias("key"))


@query(f"SELECT page_id, 'https://' || regexp_extract({_REST}, '^([^/?#]*)', 1) || regexp_replace({_PATH}, '/+$', '') AS url2 FROM pages")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.expansion_url(F.col("url"), requote=False).alias("url2"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 OR (page_id % 3 = 1 AND regexp_replace({_PATH}, '/+$', '') <> '') THEN 'redirected-away' ELSE 'shell-reachable' END AS state FROM pages")
def redirect_away(spark, sf_dir):
    k, u = F.col("page_id"), F.col("url")
    final = F.when(k % 3 == 0, F.lit("https://elsewhere.example/")).when(k % 3 == 1, F.concat(F.lit("https://"), urls.part(u, "netloc"), F.lit("/"))).otherwise(u)
    return table(spark, sf_dir, "pages").select("page_id", urls.redirect_state(u, final).alias("state"))


@query(f"SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS domain, (regexp_replace({_HOST}, '^www\\.', '') = 'ththon.example.com' OR ends_with({_HOST}, '.ththon.example.com') OR {_HOST} = 'example.org' OR ends_with({_HOST}, '.example.org')) AS catalogued FROM pages")
def domain_match(spark, sf_dir):
    known = spark.range(1).select(F.explode(F.array(F.lit("https://www.ththon.example.com/x"), F.lit("Example.org."))).alias("site"))
    return joins.catalogued(table(spark, sf_dir, "pages").withColumn("domain", urls.domain(F.col("url"))), "url", known, "site").select("page_id", "domain", "catalogued")


@query("SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=\"([^\"]*)\"', 1) AS l FROM pages)")
def html_links(spark, sf_dir):
    from lodestone.sources.catalog import links

    return links(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(f"SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'unreachable' WHEN page_id % 6 = 1 THEN 'restricted' WHEN page_id % 6 = 2 THEN 'missing' WHEN page_id % 6 = 3 THEN 'http-error' WHEN page_id % 6 = 4 THEN 'redirected-away' ELSE 'shell-reachable' END AS state FROM pages")
def http_state(spark, sf_dir):
    k = F.col("page_id") % 6
    status = F.when(k == 0, F.lit(None).cast("int")).when(k == 1, F.lit(403)).when(k == 2, F.lit(410)).when(k == 3, F.lit(500)).otherwise(F.lit(200))
    final = F.when(k == 4, F.lit("https://other.example/")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", curation.http_state(status, F.col("url"), final).alias("state"))


# ---- lexical search over documents


def _doc_scores(spark, sf_dir) -> DataFrame:
    return lexical.text_scores(table(spark, sf_dir, "documents"), "doc_id", "text", 6.0, _bench_queries(spark, sf_dir), ("source",))


def _bench_queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_DOC_SCORE = f"""
q AS (SELECT item_id AS query_id, {norm('text')} AS qn, {lexical_sql('text')} AS qu FROM benchmark),
d AS (SELECT doc_id, source, {norm('text')} AS dn, {lexical_sql('text')} AS du FROM documents),
o AS (SELECT query_id, doc_id, count(*) AS hits, array_to_string(list_sort(list(u)), ' ') AS matched FROM (SELECT query_id, unnest(qu) AS u FROM q) JOIN (SELECT doc_id, unnest(du) AS u FROM d) USING (u) GROUP BY 1, 2),
w AS (SELECT query_id, doc_id FROM q JOIN d ON contains(dn, qn) AND length(qn) >= 3),
s AS (SELECT query_id, doc_id, round((6.0 * coalesce(hits, 0) + CASE WHEN w.doc_id IS NULL THEN 0 ELSE 24 END)::DOUBLE, 3) AS score, coalesce(hits, 0) AS hits, coalesce(matched, '') AS matched, len(qu) AS n_units
  FROM o FULL JOIN w USING (query_id, doc_id) JOIN q USING (query_id))"""


@query(f"WITH {_DOC_SCORE} SELECT query_id, doc_id, score, md5(matched) AS matched FROM s")
def doc_score(spark, sf_dir):
    s = _doc_scores(spark, sf_dir)
    return s.select("query_id", "doc_id", "score", F.md5(F.array_join("matched_units", " ").cast("binary")).alias("matched"))


_COVERAGE = "CASE WHEN n_units = 0 THEN 'gap' WHEN hits >= greatest(1, (n_units * 7 + 9) // 10) AND score >= 4 THEN 'exact' WHEN hits > 0 OR score > 0 THEN 'adjacent' ELSE 'gap' END"


@query(f"WITH {_DOC_SCORE} SELECT query_id, coverage, count(*) AS n FROM (SELECT query_id, {_COVERAGE} AS coverage FROM s) GROUP BY 1, 2")
def direct_coverage(spark, sf_dir):
    s = _doc_scores(spark, sf_dir)
    c = scoring.direct_coverage(F.col("score"), F.size("matched_units"), F.col("n_units"))
    return s.groupBy("query_id", c.alias("coverage")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DOC_SCORE},
c AS (SELECT query_id, doc_id, source, score, {_COVERAGE} AS coverage FROM s JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage = 'exact' DESC, score DESC, doc_id) AS rk,
  row_number() OVER (PARTITION BY query_id, source ORDER BY coverage = 'exact' DESC, score DESC, doc_id) AS rs, count(*) OVER (PARTITION BY query_id) AS n FROM c WHERE coverage <> 'gap'),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 8 THEN 0 WHEN rs > 3 THEN 1 ELSE 0 END, rk) AS rank FROM r)
SELECT query_id, rank, doc_id, source, score, coverage FROM f WHERE rank <= 8""")
def flagship_search(spark, sf_dir):
    """The best eight documents of each benchmark query, at most three of a source before others had their turn."""
    s = _doc_scores(spark, sf_dir)
    c = s.withColumn("coverage", scoring.direct_coverage(F.col("score"), F.size("matched_units"), F.col("n_units"))).where("coverage <> 'gap'")
    order = [ranking.level("coverage", scoring.COVERAGE_RANK).desc(), F.col("score").desc(), F.col("doc_id").asc()]
    return ranking.diversified(c, 8, order, "source", ["query_id"]).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "source", "score", "coverage")


# ---- catalog search


@query(f"WITH {SQL} SELECT DISTINCT query_id, group_id, facet, role FROM queries, (SELECT group_id, facet, role, unnest(terms) AS t FROM syn) WHERE contains({norm('query')}, t)")
def query_groups(spark, sf_dir):
    return scoring.requested_groups(standin.queries(spark), standin.groups(spark))


def _value_score_sql(key: str, values: str) -> str:
    return f"""WITH {SQL}, v AS ({values}), p AS (
 SELECT query_id, {key}, w * 4 AS pts FROM queries, v WHERE {norm('value')} <> '' AND contains({norm('query')}, {norm('value')})
 UNION ALL SELECT query_id, {key}, w AS pts FROM (SELECT {key}, w, unnest({units('value')}) AS u FROM v) JOIN (SELECT query_id, unnest({units('query')}) AS u FROM queries) USING (u))
SELECT query_id, {key}, round(sum(pts), 3) AS score FROM p GROUP BY 1, 2"""


def _fields_sql(source: str, key: str, fields) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {f'unnest({c})' if c in ('labels', 'aliases', 'targets', 'triggers', 'feel', 'channels', 'search_terms', 'stacks') else c} AS value, {w}::DOUBLE AS w FROM {source}" for c, w in fields)


@query(_value_score_sql("motion_id", _fields_sql("motions", "motion_id", scoring.MOTION_FIELDS)))
def motion_score(spark, sf_dir):
    return scoring.motion_score(standin.motions(spark), standin.queries(spark))


@query(_value_score_sql("item_id", _fields_sql("items", "item_id", scoring.ITEM_FIELDS)))
def item_score(spark, sf_dir):
    return scoring.item_score(standin.items(spark, sf_dir), standin.queries(spark))


@query(f"WITH {SQL} SELECT item_id, site_id FROM items JOIN sites USING (site_id) WHERE list_contains(items.stacks, 'Brand#4') AND kind = 'community' AND list_contains(capabilities, 'snippet')")
def filter_items(spark, sf_dir):
    return scoring.filter_items(standin.items(spark, sf_dir), standin.sites(spark, sf_dir), "Brand#4", "snippet", "community").select("item_id", "site_id")


@query(f"""WITH {SQL} SELECT site_id, motion_id, round((1 + CASE WHEN list_contains(site_kinds, kind) THEN 4 ELSE 0 END + 0.5 * len(list_intersect(s.stacks, m.stacks)) + 0.75 * len(list_intersect(tags, list_append(feel, category)))
 + 2 + CASE WHEN license_status = 'explicit' THEN 0.75 ELSE 0 END) * CASE WHEN status = 'degraded' THEN 0.5 ELSE 1 END, 3)::DOUBLE AS site_score
FROM sites s, motions m WHERE list_contains(capabilities, 'snippet') AND (list_contains(s.stacks, 'Brand#2') OR list_contains(s.stacks, 'agnostic'))""")
def site_score(spark, sf_dir):
    return scoring.site_score(standin.sites(spark, sf_dir), standin.motions(spark), "Brand#2", "snippet")


def _facets_sql(facets: dict, columns: tuple[str, ...]) -> str:
    arrays = ("labels", "aliases", "targets", "triggers", "feel", "channels", "search_terms", "stacks")
    col = lambda c: f"unnest({c})" if c in arrays else c
    parts = []
    for facet, (own, taxonomy) in facets.items():
        parts += [f"SELECT item_id, '{facet}' AS facet, {col(c)} AS v FROM items" for c in own if c in columns]
        parts += [f"SELECT item_id, '{facet}', {('unnest(m.' + c + ')') if c in arrays else 'm.' + c} FROM tags JOIN motions m USING (motion_id)" for c in taxonomy]
    return f"SELECT DISTINCT item_id, facet, {norm('v')} AS v FROM ({' UNION ALL '.join(parts)})"


_ITEM_COLUMNS = ("title", "url", "search_terms", "trigger_kind", "stacks")


def _document_sql() -> str:
    arrays = ("labels", "aliases", "targets", "triggers", "feel", "channels", "search_terms", "stacks")
    own = [f"SELECT item_id, {f'unnest({c})' if c in arrays else c} AS value, {w}::DOUBLE AS w FROM items" for c, w in scoring.DOCUMENT_FIELDS]
    tax = [f"SELECT item_id, {f'unnest(m.{c})' if c in arrays else f'm.{c}'}, {w}::DOUBLE FROM (SELECT item_id, unnest(motion_ids) AS motion_id FROM items) t JOIN motions m USING (motion_id)" for c, w in scoring.DOCUMENT_MOTION_FIELDS]
    return " UNION ALL ".join(own + tax)


#: Candidates of the expanded scan in DuckDB: pairs, coverage, fit, recall.
_ENRICHED = f"""{SQL}, tags AS (SELECT item_id, unnest(motion_ids) AS motion_id FROM items),
asked AS (SELECT DISTINCT query_id, group_id, facet, role FROM queries, (SELECT group_id, facet, role, unnest(terms) AS t FROM syn) WHERE contains({norm('query')}, t)),
terms AS (SELECT group_id, facet, unnest(terms) AS t FROM syn),
dv AS ({_document_sql()}), dvn AS (SELECT item_id, w, {norm('value')} AS vn FROM dv),
q AS (SELECT query_id, {norm('query')} AS qn, {lexical_sql('query')} AS qu FROM queries),
pts AS (SELECT query_id, item_id, w * 4 AS p, NULL AS u FROM q JOIN dvn ON length(qn) >= 3 AND contains(vn, qn)
  UNION ALL SELECT query_id, item_id, w, u FROM (SELECT item_id, w, unnest({lexical_sql('vn')}) AS u FROM dvn) JOIN (SELECT query_id, unnest(qu) AS u FROM q) USING (u)),
direct AS (SELECT query_id, item_id, round(sum(p), 3) AS score, count(DISTINCT u) AS hits FROM pts GROUP BY 1, 2),
fv AS ({_facets_sql(scoring.FACETS, _ITEM_COLUMNS)}), qv AS ({_facets_sql(scoring.QUICK_FACETS, _ITEM_COLUMNS)}),
hit AS (SELECT DISTINCT item_id, group_id FROM fv JOIN terms USING (facet) WHERE contains(v, t)), qhit AS (SELECT DISTINCT item_id, group_id FROM qv JOIN terms USING (facet) WHERE contains(v, t)),
got AS (SELECT query_id, item_id, count(*) AS n_matched, count(*) FILTER (facet <> 'platform') AS m_required, count(*) FILTER (facet = 'mechanism') AS n_mechanism,
  sum(CASE facet WHEN 'mechanism' THEN 8 WHEN 'scene' THEN 6 WHEN 'style' THEN 5 ELSE 2 END) AS points FROM hit JOIN asked USING (group_id) GROUP BY 1, 2),
own AS (SELECT query_id, item_id, count(*) FILTER (role = 'core') AS m_core, count(*) FILTER (role = 'preference') AS m_pref, count(*) FILTER (role = 'compatibility') AS m_comp,
  count(DISTINCT CASE WHEN role = 'core' THEN facet END) AS m_facets FROM qhit JOIN asked USING (group_id) GROUP BY 1, 2),
want AS (SELECT query_id, count(*) FILTER (role = 'core') AS n_core, count(*) FILTER (role = 'preference') AS n_pref, count(*) FILTER (role = 'compatibility') AS n_comp,
  count(*) FILTER (facet <> 'platform') AS n_required, count(DISTINCT CASE WHEN role = 'core' THEN facet END) AS n_facets FROM asked GROUP BY 1),
pairs AS (SELECT query_id, item_id FROM direct UNION SELECT query_id, item_id FROM got),
base AS (SELECT query_id, item_id, site_id, last_verified, last_check, len(qu) AS n_units, coalesce(score, 0) AS score, coalesce(hits, 0) AS hits, coalesce(n_matched, 0) AS n_matched, coalesce(m_required, 0) AS m_required,
  coalesce(n_mechanism, 0) AS n_mechanism, coalesce(points, 0) AS points, coalesce(m_core, 0) AS m_core, coalesce(m_pref, 0) AS m_pref, coalesce(m_comp, 0) AS m_comp, coalesce(m_facets, 0) AS m_facets,
  coalesce(n_core, 0) AS n_core, coalesce(n_pref, 0) AS n_pref, coalesce(n_comp, 0) AS n_comp, coalesce(n_required, 0) AS n_required, coalesce(n_facets, 0) AS n_facets
  FROM pairs JOIN items USING (item_id) JOIN q USING (query_id) LEFT JOIN direct USING (query_id, item_id) LEFT JOIN got USING (query_id, item_id) LEFT JOIN own USING (query_id, item_id) LEFT JOIN want USING (query_id)),
dir AS (SELECT *, {_COVERAGE} AS dc FROM base),
cand AS (SELECT query_id, item_id, site_id, last_verified, last_check, n_mechanism, n_matched, round(score + points, 3) AS recall_score,
  CASE WHEN n_required > 0 AND n_required = m_required THEN 'exact' WHEN n_matched > 0 THEN 'adjacent' ELSE dc END AS coverage,
  CASE WHEN n_comp > 0 AND m_comp = 0 AND fit = 'strong' THEN 'usable' ELSE fit END AS quick_fit,
  round(CASE WHEN n_core = 0 THEN 0.65 * CASE dc WHEN 'exact' THEN 1.0 WHEN 'adjacent' THEN 0.6 ELSE 0 END + 0.25 * pref + 0.10 * comp ELSE 0.75 * m_core / n_core + 0.15 * pref + 0.10 * comp END, 3) AS quick_score
  FROM (SELECT *, CASE WHEN n_pref = 0 THEN 0.0 ELSE m_pref / n_pref END AS pref, CASE WHEN n_comp = 0 THEN 1.0 ELSE m_comp / n_comp END AS comp,
    CASE WHEN n_core = 0 THEN CASE WHEN dc = 'exact' OR (n_pref > 0 AND m_pref / n_pref >= 0.5) THEN 'strong' WHEN dc = 'adjacent' OR m_pref > 0 THEN 'usable' ELSE 'weak' END
      WHEN n_facets - m_facets > 0 THEN 'weak' WHEN m_core >= n_core THEN 'strong' WHEN m_core / n_core >= 0.5 THEN 'usable' ELSE 'weak' END AS fit FROM dir))"""


def _expanded(spark, sf_dir) -> DataFrame:
    return ladder.enriched(standin.items(spark, sf_dir), standin.motions(spark), standin.queries(spark), standin.groups(spark), "global-expanded")


@query(f"WITH {_ENRICHED} SELECT query_id, item_id, coverage, n_matched, n_mechanism, recall_score FROM cand")
def expanded_coverage(spark, sf_dir):
    return _expanded(spark, sf_dir).select("query_id", "item_id", "coverage", F.col("n_matched").cast("long").alias("n_matched"), F.col("n_mechanism").cast("long").alias("n_mechanism"), "recall_score")


@query(f"WITH {_ENRICHED} SELECT query_id, item_id, quick_fit, quick_score FROM cand")
def quick_fit(spark, sf_dir):
    return _expanded(spark, sf_dir).select("query_id", "item_id", "quick_fit", "quick_score")


_POOL = f"""{_ENRICHED}, ord AS (SELECT *, CASE coverage WHEN 'exact' THEN 2 WHEN 'adjacent' THEN 1 ELSE 0 END AS cr, CASE quick_fit WHEN 'strong' THEN 2 WHEN 'usable' THEN 1 ELSE 0 END AS fr FROM cand WHERE coverage <> 'gap'),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cr DESC, fr DESC, quick_score DESC, n_mechanism DESC, n_matched DESC, last_verified IS NULL, recall_score DESC, last_check DESC, item_id) AS r,
  row_number() OVER (PARTITION BY query_id, site_id ORDER BY cr DESC, fr DESC, quick_score DESC, n_mechanism DESC, n_matched DESC, last_verified IS NULL, recall_score DESC, last_check DESC, item_id) AS rs,
  count(*) OVER (PARTITION BY query_id) AS n FROM ord),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 12 AND rs > 4 THEN 1 ELSE 0 END, r) AS rank FROM rk) WHERE rank <= 12)"""


@query(f"WITH {_POOL} SELECT query_id, rank, item_id, site_id, coverage, quick_fit FROM pool")
def candidate_pool(spark, sf_dir):
    p = ladder.pool(_expanded(spark, sf_dir), 12)
    return p.select("query_id", F.col("rank").cast("long").alias("rank"), "item_id", "site_id", "coverage", "quick_fit")


@query(f"WITH {_POOL} SELECT query_id, coalesce(sum((coverage = 'exact')::INT), 0)::BIGINT AS exact_count, coalesce(sum((coverage = 'adjacent')::INT), 0)::BIGINT AS adjacent_count, CASE WHEN coalesce(sum((coverage = 'exact')::INT), 0) > 0 THEN 'exact' WHEN coalesce(sum((coverage = 'adjacent')::INT), 0) > 0 THEN 'adjacent' ELSE 'gap' END AS status, coalesce(sum((coverage = 'exact')::INT), 0) >= 8 AS complete FROM queries LEFT JOIN pool USING (query_id) GROUP BY 1")
def coverage_summary(spark, sf_dir):
    return ladder.coverage_summary(ladder.pool(_expanded(spark, sf_dir), 12), standin.queries(spark), 8)


_QUICK = f"""{_POOL}, ready AS (SELECT site_id FROM sites WHERE list_has_any(capabilities, ['snippet', 'package', 'asset', 'recreate'])),
s AS (SELECT query_id, count(*) FILTER (quick_fit = 'strong') AS strong_count, count(*) FILTER (quick_fit = 'usable') AS usable_count, count(*) FILTER (quick_fit = 'weak') AS weak_count,
  count(*) FILTER (quick_fit <> 'weak') AS eligible_count, count(DISTINCT CASE WHEN quick_fit <> 'weak' THEN site_id END) AS source_count FROM pool JOIN ready USING (site_id) GROUP BY 1),
t AS (SELECT query_id, coalesce(strong_count, 0) AS strong_count, coalesce(usable_count, 0) AS usable_count, coalesce(weak_count, 0) AS weak_count, coalesce(eligible_count, 0) AS eligible_count, coalesce(source_count, 0) AS source_count FROM queries LEFT JOIN s USING (query_id)),
u AS (SELECT *, eligible_count >= 8 AND source_count >= 3 AS complete FROM t)"""


@query(f"WITH {_QUICK} SELECT query_id, strong_count, usable_count, weak_count, eligible_count, source_count, complete, CASE WHEN strong_count >= 3 AND complete THEN 'strong' WHEN eligible_count > 0 THEN 'usable' ELSE 'gap' END AS status, CASE WHEN complete AND strong_count >= 3 THEN 'skip' WHEN eligible_count >= 4 THEN 'offer' ELSE 'required' END AS decision FROM u")
def external_decision(spark, sf_dir):
    s = ladder.quick_summary(ladder.pool(_expanded(spark, sf_dir), 12), standin.sites(spark, sf_dir), standin.queries(spark), 8)
    return ladder.external_decision(s, 8).drop("ready_count")


@query()
def ladder_trace(spark, sf_dir):
    found = ladder.search(standin.items(spark, sf_dir), standin.motions(spark), standin.sites(spark, sf_dir), standin.queries(spark), standin.groups(spark), limit=24, target=8)
    return found["trace"].join(found["summary"].select("query_id", "decision", "exhausted"), "query_id")


# ---- similarity and fusion


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS length, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def l2_normalize(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return n.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@query(f"SELECT query_id, case_id, round(avg(best), 6) AS score FROM (SELECT a.vec_id // 150 AS query_id, b.label AS case_id, a.vec_id % 150 AS q, max({_COS}) AS best FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def maxsim(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.expr("vec_id div 150").alias("query_id"), (F.col("vec_id") % 150).alias("q_idx"), "embedding")
    return fusion.maxsim(q, e.select(F.col("label").alias("case_id"), "embedding")).select("query_id", "case_id", F.round("score", 6).alias("score"))


def _user_signatures(spark, sf_dir) -> DataFrame:
    """Each user's events as a recording: values in time order are the activity, event types the histogram."""
    e = table(spark, sf_dir, "events")
    act = motion.activity(e, "user_id", "event_id", "value", digits=9)
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    types = counts.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("hist"))
    s = motion.signature({"timing_character": F.col("timing_character"), "activity_curve": F.col("activity_curve"), "direction_histogram": F.col("hist"),
                          "dominant_direction": F.get(F.array(*map(F.lit, ("up", "mixed", "static"))), (F.col("user_id") % 3).cast("int"))})
    return act.join(types, "user_id").select("user_id", s.alias("signature"))


_CAT = "CASE WHEN a = b THEN 1.0 WHEN a = 'mixed' OR b = 'mixed' THEN 0.5 WHEN a = 'static' OR b = 'static' THEN 0.0 ELSE 0.15 END"


@query(f"SELECT event_id, ({_CAT})::DOUBLE AS sim FROM (SELECT event_id, ['up', 'down', 'mixed', 'static'][event_id % 4 + 1] AS a, ['up', 'mixed', 'static'][user_id % 3 + 1] AS b FROM events)")
def categorical_sim(spark, sf_dir):
    pick = lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
    return table(spark, sf_dir, "events").select("event_id", vectors.categorical_similarity(pick(("up", "down", "mixed", "static"), F.col("event_id") % 4), pick(("up", "mixed", "static"), F.col("user_id") % 3)).alias("sim"))


def _channels(spark, sf_dir) -> DataFrame:
    """Three channels a query (an order priority) that rank customers' nations: count, sum and latest order."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("o_orderpriority").alias("query_id"), F.col("c_nationkey").cast("string").alias("id")).agg(
        F.count("*").cast("double").alias("volume"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("value"), F.max("o_orderkey").cast("double").alias("recent"))
    return fusion.ranks(g.unpivot(["query_id", "id"], ["volume", "value", "recent"], "channel", "score"))


_CHANNELS = """g AS (SELECT o_orderpriority AS query_id, c_nationkey::VARCHAR AS id, count(*)::DOUBLE AS volume, round(sum(o_totalprice), 2)::DOUBLE AS value, max(o_orderkey)::DOUBLE AS recent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
l AS (UNPIVOT g ON volume, value, recent INTO NAME channel VALUE score),
ch AS (SELECT query_id, id, channel, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS rank FROM l),
rrf AS (SELECT query_id, id, sum(CASE channel WHEN 'recent' THEN 0.5 ELSE 1.0 END / (60 + rank)) AS s, count(*) AS channel_count FROM ch GROUP BY 1, 2),
fused AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS rank, round(s, 8) AS rrf_score, channel_count FROM rrf)"""


@query(f"WITH {_CHANNELS} SELECT query_id, id, rank, rrf_score, channel_count FROM fused")
def rrf(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(_channels(spark, sf_dir), {"recent": 0.5}).select("query_id", "id", F.col("rank").cast("long").alias("rank"), "rrf_score", "channel_count")


_OVERLAP = f"""{_CHANNELS}, top AS (SELECT query_id, channel, list(id) AS ids FROM ch WHERE rank <= 5 GROUP BY 1, 2),
ov AS (SELECT a.query_id, avg(len(list_intersect(a.ids, b.ids)) / len(list_distinct(list_concat(a.ids, b.ids)))) AS overlap FROM top a JOIN top b ON a.query_id = b.query_id AND a.channel < b.channel GROUP BY 1)"""


@query(f"WITH {_OVERLAP} SELECT query_id, round(overlap, 6) AS overlap FROM ov")
def top_overlap(spark, sf_dir):
    return fusion.top_overlap(_channels(spark, sf_dir)).select("query_id", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {_OVERLAP}, lead AS (SELECT query_id, max(CASE WHEN rank = 1 THEN id END) AS top, max(CASE WHEN rank = 1 THEN rrf_score END) AS s1, max(CASE WHEN rank = 2 THEN rrf_score END) AS s2 FROM fused GROUP BY 1),
v AS (SELECT query_id, count(DISTINCT channel) AS n, sum((id = top AND rank <= 3)::INT) AS votes FROM ch JOIN lead USING (query_id) GROUP BY 1),
x AS (SELECT query_id, n, votes / n AS c, overlap AS o, (s1 - s2) / s1 AS m FROM lead JOIN v USING (query_id) JOIN ov USING (query_id))
SELECT query_id, (c < 0.6 OR (m < 0.04 AND c < 0.8) OR o < 0.2) AS required, round(c, 4) AS top1_consensus, round(o, 4) AS top5_overlap, round(m, 4) AS lead_margin FROM x""")
def vlm_route(spark, sf_dir):
    c = _channels(spark, sf_dir)
    r = fusion.review_routing(fusion.reciprocal_rank_fusion(c, {"recent": 0.5}), c)
    return r.select("query_id", "required", "top1_consensus", "top5_overlap", "lead_margin")


def _manifest(spark, sf_dir) -> DataFrame:
    """Documents with labels as reviewed candidates; each source is a query."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        F.col("source").alias("query_id"), k.cast("string").alias("id"), F.when(F.col("quality") == 1, F.lit("exact")).otherwise(F.lit("adjacent")).alias("match_quality"),
        F.when(k % 5 == 0, F.lit("confirmed")).otherwise(F.lit("not-reviewed")).alias("vlm_verdict"), F.lit("keyframes").alias("analysis_depth"),
        ((k * 7 % 101) / 100).alias("text_fit"), ((k * 13 % 97) / 100).alias("visual_semantic_fit"), ((k * 29 % 89) / 100).alias("motion_trajectory_fit"), ((k * 31 % 83) / 100).alias("delivery_quality"),
    )


_MANIFEST = """c AS (SELECT source AS query_id, doc_id::VARCHAR AS id, CASE WHEN quality = 1 THEN 'exact' ELSE 'adjacent' END AS match_quality, CASE WHEN doc_id % 5 = 0 THEN 'confirmed' ELSE 'not-reviewed' END AS vlm_verdict,
  round((doc_id * 7 % 101) / 100, 4) AS text_fit, round((doc_id * 13 % 97) / 100, 4) AS visual_semantic_fit, round((doc_id * 29 % 89) / 100, 4) AS motion_trajectory_fit, round((doc_id * 31 % 83) / 100, 4) AS delivery_quality
  FROM documents JOIN labels USING (doc_id)),
l AS (UNPIVOT c ON text_fit, visual_semantic_fit, motion_trajectory_fit, delivery_quality INTO NAME channel VALUE score),
rk AS (SELECT query_id, id, channel, score, max(score) OVER (PARTITION BY query_id, channel) AS best, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, id) AS r FROM l),
s AS (SELECT query_id, id, sum(CASE channel WHEN 'motion_trajectory_fit' THEN 0.8 WHEN 'delivery_quality' THEN 0.4 ELSE 1.0 END / (60 + r)) AS s,
  sum((CASE WHEN best > 0 THEN score / best ELSE 0 END >= 0.85)::INT) AS strong, sum((CASE WHEN best > 0 THEN score / best ELSE 0 END >= 0.65)::INT) AS supporting FROM rk GROUP BY 1, 2),
conf AS (SELECT query_id, id, match_quality, vlm_verdict, round(s, 8) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, id) AS fusion_rank,
  CASE WHEN strong >= 3 THEN 'high' WHEN strong >= 2 OR supporting >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM s JOIN c USING (query_id, id))"""


@query(f"WITH {_MANIFEST} SELECT query_id, id, confidence FROM conf")
def confidence(spark, sf_dir):
    rows = _manifest(spark, sf_dir).withColumns({c: F.round(c, 4) for c in fusion.RANKING_WEIGHTS})
    return fusion.with_confidence(rows, tuple(fusion.RANKING_WEIGHTS)).select("query_id", "id", "confidence")


@query(f"""WITH {_MANIFEST}, p AS (SELECT *, CASE WHEN confidence = 'low' AND vlm_verdict = 'confirmed' THEN 'medium' ELSE confidence END AS conf2, lag(rrf_score) OVER (PARTITION BY query_id ORDER BY fusion_rank) AS prev FROM conf),
b AS (SELECT *, CASE WHEN conf2 = 'low' THEN 'low' WHEN match_quality = 'exact' THEN 'formal' ELSE 'adjacent' END AS bucket FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY fusion_rank) AS rank FROM b)
SELECT query_id, id, bucket, rank, fusion_rank, rrf_score, conf2 AS confidence, coalesce((prev - rrf_score) / greatest(prev, 1e-12) < 0.03, false) AS tie FROM f WHERE bucket <> 'formal' OR rank <= 8""")
def rank_manifest(spark, sf_dir):
    r = fusion.rank_candidates(fusion.eligible(_manifest(spark, sf_dir)).where("excluded is null"))
    return r.select("query_id", "id", "bucket", F.col("rank").cast("long").alias("rank"), F.col("fusion_rank").cast("long").alias("fusion_rank"), "rrf_score", "confidence", "tie")


# ---- motion


_CURVE = "c AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1)"


@query(f"""WITH {_CURVE}, b AS (SELECT user_id, v, len(v) AS n, least(8, len(v)) AS k FROM c),
i AS (SELECT user_id, j, v[j * (n // k) + least(j, n % k) + 1 : j * (n // k) + least(j, n % k) + (n // k) + CASE WHEN j < n % k THEN 1 ELSE 0 END] AS part FROM (SELECT *, unnest(range(k)) AS j FROM b))
SELECT user_id, j::INTEGER AS bin, round(list_sum(part) / len(part), 6) AS mean FROM i""")
def curve_bins(spark, sf_dir):
    c = motion.curves(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return c.select("user_id", F.posexplode(vectors.curve_bins(F.col("curve"), digits=9)).alias("bin", "m")).select("user_id", "bin", F.round("m", 6).alias("mean"))


@query(f"""WITH {_CURVE}, w AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, sum(x * i / greatest(n - 1, 1)) / greatest(sum(x), 1e-9) AS c, max(x) AS top, min(i) FILTER (x = m) / greatest(max(n) - 1, 1) AS p FROM (SELECT *, max(x) OVER (PARTITION BY user_id) AS m FROM w) GROUP BY user_id)
SELECT user_id, CASE WHEN top < 0.002 THEN 'static' WHEN c BETWEEN 0.35 AND 0.65 AND p BETWEEN 0.25 AND 0.75 THEN 'peaked' WHEN c < 0.4 THEN 'front-loaded' WHEN c > 0.6 THEN 'rear-loaded' ELSE 'even' END AS timing FROM s""")
def timing_character(spark, sf_dir):
    c = motion.curves(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return c.select("user_id", vectors.timing_character(F.col("curve")).alias("timing"))


_FLOW = "f AS (SELECT event_id, user_id, ((event_id * 37) % 201 - 100) / 1000 AS dx, ((event_id * 53) % 201 - 100) / 1000 AS dy, value AS m FROM events)"


@query(f"WITH {_FLOW} SELECT event_id, CASE WHEN m / 10000 < 0.0008 THEN 'static' WHEN abs(dx) < abs(dy) * 0.7 THEN CASE WHEN dy > 0 THEN 'down' ELSE 'up' END WHEN abs(dy) < abs(dx) * 0.7 THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END ELSE 'mixed' END AS direction, CASE WHEN m > 72 THEN 'full' WHEN dx < -0.05 THEN 'left' WHEN dx > 0.05 THEN 'right' ELSE 'center' END AS region FROM f")
def direction_class(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumns({"dx": ((k * 37) % 201 - 100) / 1000, "dy": ((k * 53) % 201 - 100) / 1000})
    x = F.when(F.col("dx") < -0.05, F.lit(0.1)).when(F.col("dx") > 0.05, F.lit(0.9)).otherwise(F.lit(0.5))
    return e.select("event_id", vectors.direction(F.col("dx"), F.col("dy"), F.col("value") / 10000).alias("direction"), vectors.region(x, F.lit(0.5), F.col("value") / 100).alias("region"))


@query("SELECT user_id, round(((2 * avg(x) * avg(y) + 6.5025) * (2 * covar_pop(x, y) + 58.5225)) / ((avg(x) * avg(x) + avg(y) * avg(y) + 6.5025) * (var_pop(x) + var_pop(y) + 58.5225)), 6) AS ssim FROM (SELECT user_id, (event_id * 17 % 256)::DOUBLE AS x, (event_id * 17 % 256 + value)::DOUBLE AS y FROM events) GROUP BY 1")
def ssim(spark, sf_dir):
    k = F.col("event_id") * 17 % 256
    e = table(spark, sf_dir, "events").select("user_id", k.cast("double").alias("x"), (k + F.col("value")).cast("double").alias("y"))
    return motion.ssim(e, "user_id").select("user_id", F.round("ssim", 6).alias("ssim"))


@query("WITH d AS (SELECT user_id, event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) AS delta FROM events) SELECT user_id, round(avg(delta), 3) AS mean, round(max(delta), 4) AS peak, count(delta) AS n FROM d GROUP BY 1")
def activity_deltas(spark, sf_dir):
    d = motion.consecutive(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return d.groupBy("user_id").agg(F.round(F.avg("delta"), 3).alias("mean"), F.round(F.max("delta"), 4).alias("peak"), F.count("delta").alias("n"))


@query("""WITH s AS (SELECT event_id // 3 AS key, event_id % 3 AS f, list_transform(range(16), lambda i: CASE WHEN event_id % 5 = 0 THEN 100 ELSE (event_id * (i + 3)) % 256 END) AS px FROM events),
p AS (SELECT a.key, list_transform(range(1, 17), lambda i: abs(a.px[i] - b.px[i])) AS d FROM s a JOIN s b ON a.key = b.key AND a.f < b.f)
SELECT key, round(max(len(list_filter(d, lambda x: x > 12)) / 16), 6) AS changed_pixel_ratio, round(max(list_sum(d) / 48), 6) AS mean_absolute_difference, max(len(list_filter(d, lambda x: x > 12)) / 16) >= 0.001 OR max(list_sum(d) / 48) >= 0.25 AS dynamic FROM p GROUP BY 1""")
def frame_change(spark, sf_dir):
    k = F.col("event_id")
    px = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(F.when(k % 5 == 0, F.lit(100).cast("long")).otherwise((k * (i + 3)) % 256).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))
    s = table(spark, sf_dir, "events").select(F.expr("event_id div 3").alias("key"), (k % 3).alias("frame"), px.alias("pixels"))
    r = motion.frame_change(s)
    return r.select("key", F.round("changed_pixel_ratio", 6).alias("changed_pixel_ratio"), F.round("mean_absolute_difference", 6).alias("mean_absolute_difference"), "dynamic")


@query("SELECT user_id, count(DISTINCT event_type) AS unique_frame_hashes, max(event_id % 3) AS running_animations, max(value) - min(value) > 0.05 AS video_advanced, count(DISTINCT event_type) >= 2 OR max(event_id % 3) > 0 OR max(value) - min(value) > 0.05 AS dynamic FROM events GROUP BY 1")
def motion_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("frame_hash"), (F.col("event_id") % 3).alias("running_animations"), F.col("value").alias("video_time"))
    return motion.page_motion(e, "user_id")


# ---- curation


AUDITED = 4001


def _audits(spark, sf_dir) -> DataFrame:
    """Events as repeated audits of AUDITED records: the type is the state, the event's id the report."""
    state = F.when(F.col("event_type") == "view", F.lit("dynamic")).when(F.col("event_type") == "click", F.lit("static")).when(F.col("event_type") == "error", F.lit("broken")).otherwise(F.lit("unverified"))
    return table(spark, sf_dir, "events").select((F.col("event_id") % AUDITED).cast("string").alias("id"), F.col("event_id").alias("report_no"), state.alias("state"))


_AUDITS = f"a AS (SELECT (event_id % {AUDITED})::VARCHAR AS id, event_id AS r, CASE event_type WHEN 'view' THEN 'dynamic' WHEN 'click' THEN 'static' WHEN 'error' THEN 'broken' ELSE 'unverified' END AS state FROM events)"
_REASON = "CASE WHEN d > 0 THEN 'dynamic-verified' WHEN s >= 2 THEN 'static-confirmed-twice' WHEN b >= 2 THEN 'broken-confirmed-twice' WHEN s > 0 THEN 'static-needs-second-confirmation' WHEN b > 0 THEN 'broken-needs-second-confirmation' ELSE 'motion-unverified' END"


@query(f"WITH {_AUDITS}, n AS (SELECT id, count(*) FILTER (state = 'dynamic') AS d, count(*) FILTER (state = 'static') AS s, count(*) FILTER (state = 'broken') AS b, max(r) FILTER (state = 'dynamic') AS winning_report, array_to_string(list(state ORDER BY r), ',') AS states FROM a GROUP BY 1) SELECT id, CASE WHEN d > 0 THEN 'keep' ELSE 'quarantine' END AS decision, {_REASON} AS reason, winning_report, states FROM n")
def audit_decision(spark, sf_dir):
    return curation.audit_decisions(_audits(spark, sf_dir)).select("id", "decision", "reason", "winning_report", F.array_join("audit_states", ",").alias("states"))


def _records(spark, sf_dir) -> DataFrame:
    """Customers as records: some share a url, a media url or a runtime file."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        k.cast("string").alias("id"), F.concat(F.lit("https://h.example/"), F.col("c_nationkey").cast("string"), F.lit("/"), (k % 60).cast("string")).alias("url"),
        F.when(k % 4 == 0, F.concat(F.lit("m"), (k % 90).cast("string"))).alias("media_url"), F.when(k % 5 == 0, F.concat(F.lit("r"), (k % 70).cast("string"))).alias("runtime_url"),
        F.when(k % 3 == 0, F.lit("2024-01-01")).alias("last_verified"), F.when(k % 7 == 0, F.lit("source-with-category-preview")).alias("link_scope"),
        F.when(k % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("evidence_kinds"), F.col("c_mktsegment").alias("site_id"),
    )


def _dedup_sql() -> str:
    order = "(lv IS NOT NULL)::INT DESC, ev DESC, sc DESC, id DESC"
    steps, last = [], "r0"
    for i, (label, key) in enumerate((("duplicate-canonical-url", "url"), ("duplicate-official-media", "mu"), ("duplicate-runtime-file", "ru")), 1):
        steps.append(f"r{i} AS (SELECT id, url, mu, ru, lv, sc, ev, site_id, CASE WHEN reason IS NULL AND {key} IS NOT NULL AND row_number() OVER (PARTITION BY CASE WHEN reason IS NULL THEN {key} END, CASE WHEN reason IS NOT NULL OR {key} IS NULL THEN id END ORDER BY {order}) > 1 THEN '{label}' ELSE reason END AS reason FROM {last})")
        last = f"r{i}"
    return f"""r0 AS (SELECT c_custkey::VARCHAR AS id, 'https://h.example/' || c_nationkey || '/' || (c_custkey % 60) AS url, CASE WHEN c_custkey % 4 = 0 THEN 'm' || (c_custkey % 90) END AS mu, CASE WHEN c_custkey % 5 = 0 THEN 'r' || (c_custkey % 70) END AS ru,
  CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01' END AS lv, (c_custkey % 7 <> 0)::INT AS sc, (c_custkey % 2 = 0)::INT AS ev, c_mktsegment AS site_id, NULL::VARCHAR AS reason FROM customer), {', '.join(steps)}"""


@query(f"WITH {_dedup_sql()} SELECT id, reason FROM r3")
def strongest_records(spark, sf_dir):
    active, gone = curation.deduplicated(_records(spark, sf_dir))
    return active.select("id", F.lit(None).cast("string").alias("reason")).unionByName(gone.select("id", "reason"))


@query(f"WITH {_dedup_sql()}, {_AUDITS}, n AS (SELECT id, count(*) FILTER (state = 'dynamic') AS d, count(*) FILTER (state = 'static') AS s, count(*) FILTER (state = 'broken') AS b FROM a GROUP BY 1) SELECT r3.id, CASE WHEN reason IS NULL AND d > 0 THEN 'keep' ELSE 'quarantine' END AS decision, coalesce(reason, CASE WHEN n.id IS NULL THEN 'motion-unverified' ELSE {_REASON} END) AS reason FROM r3 LEFT JOIN n USING (id)")
def curate(spark, sf_dir):
    return curation.curate(_records(spark, sf_dir), _audits(spark, sf_dir), "2024-06-01").select("id", "decision", "reason")


@query("WITH n AS (SELECT source AS site_id, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total, max(n) AS top FROM n) SELECT site_id, n, round(n / total, 4) AS share, site_id = (SELECT min(site_id) FROM n, t WHERE n = top) AS dominant, CASE WHEN round(top / total, 4) <= 0.8 THEN 'pass' ELSE 'fail' END AS status FROM n, t")
def balance(spark, sf_dir):
    return curation.source_shares(table(spark, sf_dir, "documents").withColumnRenamed("source", "site_id"))


@query("SELECT source AS site_id, count(*) AS before, sum((quality = 1)::INT)::BIGINT AS after, round(sum((quality = 1)::INT) / count(*), 4) AS retention FROM (SELECT source, coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1")
def retention(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumnRenamed("source", "site_id")
    good = d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")
    return curation.source_retention(d, good)


@query("SELECT user_id, sum((event_type = 'view')::INT)::BIGINT AS view, sum((event_type = 'error')::INT)::BIGINT AS error FROM events GROUP BY 1")
def nested_counts(spark, sf_dir):
    return curation.nested_counts(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "error"])


_RULES = [("small-thing", ("small", "mini")), ("ring", ("ring",)), ("metal", ("bolt", "gear", "nut")), ("red-thing", ("red", "crimson"))]


def _rules_sql(test: Callable[[str], str]) -> str:
    parts = ", ".join(f"CASE WHEN {' OR '.join(test(w) for w in words)} THEN '{name}' END" for name, words in _RULES)
    return f"SELECT p_partkey, array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL)[1:3], ',') AS classes FROM part"


@query(_rules_sql(lambda w: f"contains(lower(p_name || ' ' || p_type), '{w}')"))
def rule_classify(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("hay", F.concat_ws(" ", "p_name", "p_type"))
    return curation.rule_classify(p, "hay", _RULES).select("p_partkey", F.array_join("classes", ",").alias("classes"))


@query(_rules_sql(lambda w: f"regexp_matches(lower(p_name || ' ' || p_type), '(?:^|[^a-z0-9]){w}(?:$|[^a-z0-9])')"))
def rule_classify_word(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("hay", F.concat_ws(" ", "p_name", "p_type"))
    return curation.rule_classify(p, "hay", _RULES, whole_words=True).select("p_partkey", F.array_join("classes", ",").alias("classes"))


@query("SELECT p_partkey, t AS trigger, CASE t WHEN 'hover' THEN 800 WHEN 'loop' THEN 1600 WHEN 'click' THEN 1000 ELSE 1200 END AS settle_ms, CASE t WHEN 'loop' THEN 'clip' ELSE 'storyboard' END AS evidence FROM (SELECT p_partkey, ['mount', 'hover', 'click', 'scroll', 'loop'][p_size % 5 + 1] AS t FROM part)")
def capture_recipe(spark, sf_dir):
    t = F.get(F.array(*map(F.lit, ("mount", "hover", "click", "scroll", "loop"))), (F.col("p_size") % 5).cast("int"))
    r = table(spark, sf_dir, "part").select("p_partkey", t.alias("trigger")).withColumn("r", curation.capture_recipe("sitemap", F.col("trigger")))
    return r.select("p_partkey", "trigger", "r.settle_ms", "r.evidence")


def _observations(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    statuses = F.array(F.lit(200), F.lit(403), F.lit(404), F.lit(500), F.lit(302)).cast("array<int>")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.get(statuses, (k % 5).cast("int")).alias("outer_status"), (k % 2 == 0).alias("settled"), (k % 11 == 0).alias("redirected_away"), F.lit(False).alias("access_restricted"),
        (k % 3 == 0).alias("expects_render_target"), (k % 7 < 2).alias("visually_observed"), (k % 4 < 2).alias("capture_attempted"), (k % 4 == 0).alias("capture_succeeded"),
        F.when(k % 13 == 0, F.array(F.lit(503), F.lit(429))).otherwise(F.array().cast("array<int>")).alias("critical_statuses"),
        F.when(k % 17 == 0, F.array(F.lit("Error fetching data"))).otherwise(F.array().cast("array<string>")).alias("console_errors"),
        F.when(k % 6 == 0, F.array(F.struct(F.lit(True).alias("visible"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height")))).alias("render_targets"),
        F.when(k % 2 == 1, F.lit("keyframes")).alias("analysis_depth"),
    )


_HEALTH = """o AS (SELECT event_id AS id, [200, 403, 404, 500, 302][event_id % 5 + 1] AS st, event_id % 2 = 0 AS settled, event_id % 11 = 0 AS away, event_id % 3 = 0 AS expects, event_id % 7 < 2 AS seen, event_id % 4 < 2 AS att, event_id % 4 = 0 AS ok,
  event_id % 13 = 0 AS crit, event_id % 17 = 0 AS err, event_id % 6 = 0 AS target, event_id % 2 = 1 AS deep FROM events),
x AS (SELECT *, st = 403 OR crit AS restricted FROM o),
y AS (SELECT *, (st = 404 OR (st >= 400 AND NOT restricted)) AS b1, settled AND expects AND NOT target AND NOT restricted AS b5, seen OR target AS rendered FROM x),
h AS (SELECT id, deep, CASE WHEN b1 OR crit OR err OR away OR b5 THEN 'broken' WHEN rendered AND att AND NOT ok THEN 'capture_restricted' WHEN rendered THEN 'render_verified' ELSE 'shell_reachable' END AS state,
  array_to_string(list_filter([CASE WHEN b1 THEN 'outer-status-' || st END, CASE WHEN crit THEN 'critical-status-503' END, CASE WHEN err THEN 'content-fetch-error' END, CASE WHEN away THEN 'redirected-away' END, CASE WHEN b5 THEN 'missing-render-target-after-settle' END,
    CASE WHEN b1 OR crit OR err OR away OR b5 THEN NULL WHEN rendered AND att AND NOT ok THEN 'render-confirmed-capture-failed' WHEN rendered THEN 'visible-render-confirmed' WHEN restricted THEN 'access-restricted' WHEN st BETWEEN 200 AND 399 THEN 'outer-shell-only' ELSE 'source-unreachable-or-unconfirmed' END], lambda v: v IS NOT NULL), ',') AS reasons FROM y)"""


@query(f"WITH {_HEALTH} SELECT id, state, reasons FROM h")
def health_class(spark, sf_dir):
    return curation.health_class(_observations(spark, sf_dir)).select("id", "state", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {_HEALTH} SELECT state, count(*) AS n, count(*) FILTER (state IN ('render_verified', 'capture_restricted')) AS quick, count(*) FILTER (state = 'render_verified' AND deep) AS deep FROM h GROUP BY 1")
def health_rollup(spark, sf_dir):
    return curation.health_rollup(curation.health_class(_observations(spark, sf_dir)))


@query("SELECT event_id AS id, array_to_string(list_filter([CASE WHEN event_id % 9 = 0 THEN 'invalid-domain' WHEN event_id % 5 = 0 THEN 'already-in-catalog' END, CASE WHEN event_id % 2 = 1 THEN 'not-exact' END, CASE WHEN event_type <> 'view' THEN 'not-high-confidence' END, CASE WHEN event_id % 7 = 0 THEN 'not-concrete-item' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events")
def suggestion_gate(spark, sf_dir):
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        k.alias("id"), F.when(k % 9 == 0, F.lit("")).otherwise(F.lit("a.example")).alias("domain"), (k % 5 == 0).alias("catalogued"), F.when(k % 2 == 0, F.lit("exact")).alias("match_quality"),
        F.when(F.col("event_type") == "view", F.lit("high")).otherwise(F.lit("low")).alias("confidence"), F.lit("render_verified").alias("source_health"), F.lit("code-backed").alias("support_kind"),
        (k % 7 != 0).alias("concrete_item"), F.lit(False).alias("already_suggested"))
    return curation.suggestion_gate(e).select("id", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT url, ok, round_no FROM (SELECT 'u' || (event_id % 700) AS url, event_type = 'view' AS ok, event_id AS round_no, row_number() OVER (PARTITION BY event_id % 700 ORDER BY (event_type = 'view')::INT DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def retry_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("event_id") % 700).cast("string")).alias("url"), (F.col("event_type") == "view").alias("ok"), F.col("event_id").alias("round"))
    return curation.best_attempts(e).withColumnRenamed("round", "round_no")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_orderstatus NOT IN ('P')")
def exclusion(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("P").alias("status"))
    return joins.excluding(table(spark, sf_dir, "orders"), known, ("o_custkey", "c_custkey"), ("o_orderstatus", "status")).select("o_orderkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def referential_check(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    return joins.unknown_references(table(spark, sf_dir, "orders"), "o_custkey", suppliers, "o_custkey")


_LINE = "CASE conv_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{\"id\": ' || conv_id || ', \"role\": \"' || role || '\"}' WHEN 2 THEN '{\"id\": ' || conv_id || '}' WHEN 3 THEN '{broken ' ELSE '[1, 2]' END"


@query("SELECT conv_id AS file, turn AS line, CASE conv_id % 5 WHEN 1 THEN NULL WHEN 2 THEN 'missing: role' WHEN 3 THEN 'invalid JSON' ELSE 'not an object' END AS error FROM conversations WHERE conv_id % 5 <> 0")
def validate_rows(spark, sf_dir):
    from lodestone.sources.catalog import split_checked

    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.expr(_LINE).alias("value")).where("trim(value) <> ''")
    good, bad = split_checked(lines, "id LONG, role STRING", ["id", "role"])
    return good.select("file", "line", F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 6 = 0 THEN 'id' END, CASE WHEN s_suppkey % 4 = 0 THEN 'status' END, CASE WHEN s_suppkey % 10 = 3 THEN 'homepage' END, CASE WHEN s_suppkey % 8 = 5 THEN 'capabilities' END, CASE WHEN s_suppkey % 9 = 2 THEN 'added_at' END], lambda x: x IS NOT NULL), ',') AS errors FROM supplier")
def validate_sites(spark, sf_dir):
    from lodestone.sources.validation import validate_sites as check

    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    rows = s.select(
        "s_suppkey", F.when(k % 6 == 0, F.concat(F.lit("Bad "), k.cast("string"))).otherwise(F.concat(F.lit("site-"), k.cast("string"))).alias("id"), F.when(k % 4 == 0, F.lit("gone")).otherwise(F.lit("active")).alias("status"),
        F.lit("none").alias("auth"), F.lit("editor").alias("kind"), F.when(k % 10 == 3, F.lit("http://x.example")).otherwise(F.lit("https://x.example")).alias("homepage"),
        F.struct(F.lit("https://x.example/s?q={query}").alias("search"), F.lit(None).cast("string").alias("examples"), F.lit(None).cast("string").alias("blocks"), F.lit(None).cast("string").alias("source"),
                 F.create_map(F.lit("a"), F.lit("https://x.example/a")).alias("categories")).alias("routes"),
        F.when(k % 8 == 5, F.array(F.lit("fly"))).otherwise(F.array(F.lit("snippet"))).alias("capabilities"), F.array(F.lit("css")).alias("stacks"), F.array(F.lit("t")).alias("tags"),
        F.struct(F.lit("explicit").alias("status"), F.lit(None).cast("string").alias("url")).alias("license"), F.when(k % 9 == 2, F.lit("2024-02-30")).otherwise(F.lit("2024-2-3")).alias("added_at"),
        F.lit(None).cast("string").alias("last_shallow_check"), F.lit(None).cast("string").alias("last_deep_review"),
    )
    return check(rows).select("s_suppkey", F.array_join("errors", ",").alias("errors"))


@query("SELECT url, source FROM (SELECT url, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM (SELECT 'u' || (doc_id % 300) AS url, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)) WHERE r <= 5")
def limited_per_source(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string")).alias("url"))
    return ranking.limited_per_source(d, "source", "url", [F.col("doc_id").asc()], 5).select("url", "source")


@query(f"WITH {SQL} SELECT site_id, name, coalesce(n, 0) AS n_items, (SELECT count(*) FROM sites) AS site_count, (SELECT count(*) FROM items)::BIGINT AS item_count FROM sites LEFT JOIN (SELECT site_id, count(*) AS n FROM items GROUP BY 1) USING (site_id)")
def overview(spark, sf_dir):
    from lodestone.sources.sinks import overview as of

    return of(standin.sites(spark, sf_dir).withColumnRenamed("site_id", "id"), standin.items(spark, sf_dir))


# ---- updates and streams


def _event_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'disabled' WHEN event_id % 9 = 1 THEN 'interval_skipped' WHEN event_id % 9 = 2 THEN 'offline_or_unreachable' WHEN event_id % 9 = 3 THEN 'invalid_manifest' WHEN event_id % 9 = 4 THEN 'not_modified'
 WHEN event_id % 9 = 5 THEN 'skill_update_required' WHEN event_id % 20 <= 10 THEN 'current' ELSE 'update_available' END AS status,
 event_id % 9 > 5 AND event_id % 20 > 10 AND NOT (event_id % 20 = 15 AND event_id % 2 = 1) AS notify FROM events""")
def update_status(spark, sf_dir):
    from lodestone.streaming.updates import update_status as of

    k = F.col("event_id")
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    version = F.concat(F.lit("1."), (k % 20).cast("string"))
    e = table(spark, sf_dir, "events").select(
        "event_id", (k % 9 != 0).alias("enabled"), now.alias("now"), F.when(k % 9 == 1, F.lit("2024-06-09 12:00:00").cast("timestamp")).alias("last_checked_at"),
        F.when(k % 9 == 2, F.lit("unreachable")).when(k % 9 == 4, F.lit("not-modified")).otherwise(F.lit("ok")).alias("fetch"), F.when(k % 9 == 3, F.lit(2)).otherwise(F.lit(0)).alias("error_count"),
        F.when(k % 9 != 4, version).alias("latest_version"), F.lit("1.10").alias("current_version"), F.lit("0.5").alias("own_version"), F.when(k % 9 == 5, F.lit("0.6")).otherwise(F.lit("0.5.0")).alias("min_version"),
        F.lit("1.15").alias("last_notified_version"), F.when(k % 2 == 1, F.lit("2024-06-08 00:00:00")).otherwise(F.lit("2024-06-01 00:00:00")).cast("timestamp").alias("last_notified_at"),
    )
    return of(e).select("event_id", "status", "notify")


@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def windowed_activity(spark, sf_dir):
    """The stream query over a file stream of events, run over what is there."""
    from lodestone.streaming import updates

    stream = _event_stream(spark, sf_dir)
    out = updates.windowed_activity(stream, delay="3650 days")
    return updates.run_available(out, f"activity_{abs(hash(sf_dir)) % 10**8}", "complete")


    stream = _event_stream(spark, sf_dir)
    return updates.run_available(updates.first_seen_stream(stream, "event_id", "ts").select("event_id", "user_id"), f"first_seen_{abs(hash(sf_dir)) % 10**8}")


    stream = _event_stream(spark, sf_dir)
    offers = stream.select(F.col("user_id").cast("string").alias("client"), F.col("event_type").alias("version"), F.col("ts").alias("at"))
    return updates.run_available(updates.notices(offers), f"notices_{abs(hash(sf_dir)) % 10**8}")
