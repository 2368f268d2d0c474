"""Operators of the engine against plain-Python versions and decision tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text, urls, vectors
from lodestone.operators import curation, fusion, joins, motion, ranking, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# ---- text


def test_units_of_both_scripts(spark):
    norm = lambda s: text.normalize_text(F.lit(s))
    assert one(spark, norm("  Ab\t C　D ")) == "ab c d"
    assert sorted(one(spark, text.text_units(norm("Hi c++ v1.2 卡片动")))) == sorted(["hi", "c++", "v1.2", "卡", "片", "动", "卡片", "片动"])
    assert sorted(one(spark, text.lexical_units(norm("a UI hero 卡片动 动效 点")))) == sorted(["hero", "卡片动", "卡片", "片动"])
    assert one(spark, text.contains_term(F.lit("a Link here"), F.lit("INK"))) and not one(spark, text.contains_term(F.lit("x"), F.lit("  ")))
    assert one(spark, text.normalize_text(F.lit("ＡＢ ①"), compatibility=True)) == "ab 1"


def test_versions(spark):
    cases = [("1.2", "1.2.0", 0), ("2026.08.9", "2026.8.10", -1), ("v2", "1.9.9", 1), ("1.10", "1.9", 1)]
    assert [one(spark, text.compare_versions(F.lit(a), F.lit(b))) for a, b, _ in cases] == [c for *_, c in cases]
    with pytest.raises(Exception, match="no number"):
        one(spark, text.compare_versions(F.lit("x"), F.lit("1")))


def test_slugs_titles_terms(spark):
    assert one(spark, text.slugify(F.lit("--Héllo, World! 3D--"), 120)) == "h-llo-world-3d"
    assert one(spark, text.slug_title(F.lit("svg-card-o'neil-3d"))) == "SVG Card O'neil 3D"
    assert one(spark, text.search_terms(F.lit("b a-b a-b zz Zz c"))) == ["a-b", "zz"]
    assert one(spark, text.query_variants(F.lit("卡片"), F.array(F.array(F.lit("卡片"), F.lit("card")), F.array(F.lit("点"))))) == ["卡片", "卡片 | card"]
    intent = text.motion_intent(F.lit("Slide UP with a bounce at the top"))
    assert [one(spark, intent[k]) for k in ("dominant_direction", "changed_region", "timing_character")] == ["up", "top", "peaked"]
    assert one(spark, text.escape_markdown(F.lit("a[b]\\c"))) == "a\\[b\\]\\\\c"
    title = text.display_title(F.lit("untitled"), F.lit("12-34-nice-one"), F.lit(None).cast("string"), F.lit("x"), F.lit("f"), ("untitled", ""))
    assert one(spark, title) == "nice one"


# ---- urls


def test_four_url_forms(spark):
    u = F.lit("https://WWW.Ex.com:8443/a%20b/?b=2&utm_source=x&a=1#f")
    assert one(spark, urls.ranking_url(u)) == "https://www.ex.com:8443/a%20b?b=2&a=1"
    assert one(spark, urls.curation_key(u)) == "www.ex.com/a b?a=1&b=2&utm_source=x"
    assert one(spark, urls.expansion_url(u)) == "https://WWW.Ex.com:8443/a%20b"
    assert one(spark, urls.ranking_url(F.lit("https://u:p@ex.com/"))) is None and one(spark, urls.ranking_url(F.lit("http://ex.com/"))) is None
    assert one(spark, urls.ranking_url(F.lit("https://ex.com"))) == "https://ex.com/"
    assert one(spark, urls.redirect_state(F.lit("https://a.b/x"), F.lit("https://a.b/"))) == "redirected-away"
    assert one(spark, urls.redirect_state(F.lit("https://a.b/x"), F.lit("https://A.b/y"))) == "shell-reachable"
    assert one(spark, urls.domain(F.lit("www.Foo.com."))) == "foo.com"
    assert one(spark, urls.is_allowed(F.lit("https://h.com/a/b%20c"), "h.com", "/a/[^/]+")) and not one(spark, urls.is_allowed(F.lit("https://h.com/a/b?q"), "h.com", "/a/[^/]+", plain_only=True))


def test_catalogued_domains(spark):
    df = spark.createDataFrame([(1, "https://a.b.com/x"), (2, "https://bb.com"), (3, None), (4, "https://b.com")], "id int, url string")
    known = spark.createDataFrame([("https://www.b.com/home",)], "site string")
    assert {r["id"]: r["catalogued"] for r in joins.catalogued(df, "url", known, "site").collect()} == {1: True, 2: False, 3: False, 4: True}


def test_contains_pairs_ways_agree(spark, monkeypatch):
    r = random.Random(1)
    words = lambda n: "".join(r.choice("abc ") for _ in range(n))
    hay = spark.createDataFrame([(i, words(r.randint(0, 20))) for i in range(120)], "h int, ht string")
    needles = spark.createDataFrame([(i, words(r.randint(0, 5))) for i in range(60)], "n int, nt string")
    a = {tuple(x) for x in joins.contains_pairs(hay, "ht", needles, "nt").select("h", "n").collect()}
    monkeypatch.setattr(joins, "small", lambda df, rows=0: False)
    b = [tuple(x) for x in joins.contains_pairs(hay, "ht", needles, "nt").select("h", "n").collect()]
    want = {(h, n) for h, t in hay.collect() for n, s in needles.collect() if s and s in t}
    assert a == want == set(b) and len(b) == len(want)


# ---- vectors


def plain_dtw(a, b):
    a, b = ([x / max(max(map(abs, v)), 1e-9) for x in v] for v in (a, b))
    inf = float("inf")
    d = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d[0][0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = abs(x - y) + min(d[i - 1][j], d[i][j - 1], d[i - 1][j - 1])
    return max(0.0, 1 - min(1.0, d[-1][-1] / max(len(a), len(b))))


def test_dtw_and_signatures(spark):
    r = random.Random(2)
    rows = [([r.random() for _ in range(r.randint(1, 6))], [r.random() for _ in range(r.randint(1, 6))]) for _ in range(40)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>").select(vectors.dtw_similarity(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(abs(g["d"] - plain_dtw(a, b)) < 1e-9 for g, (a, b) in zip(got, rows))
    empty = F.array().cast("array<double>")
    assert one(spark, vectors.dtw_similarity(empty, F.array(F.lit(1.0)))) is None
    a = motion.signature({"dominant_direction": F.lit("up"), "timing_character": F.lit("even"), "direction_histogram": F.create_map(F.lit("up"), F.lit(1.0))})
    b = motion.signature({"dominant_direction": F.lit("mixed"), "changed_region": F.lit("top"), "direction_histogram": F.create_map(F.lit("up"), F.lit(1.0), F.lit("down"), F.lit(1.0))})
    assert abs(one(spark, vectors.signature_similarity(a, b)) - (0.5 * 1.2 + 1.0 * 0.5**0.5) / 2.2) < 1e-9
    assert one(spark, vectors.signature_similarity(motion.signature({}), b)) is None


def test_curves(spark):
    curve = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, vectors.curve_bins(curve(1, 2, 3, 4, 5, 6, 7, 8), 3)) == [2.0, 5.0, 7.5]
    assert one(spark, vectors.curve_bins(curve(1, 2), 8)) == [1.0, 2.0]
    assert [one(spark, vectors.timing_character(c)) for c in (curve(0, 0.001), curve(0, 1, 0), curve(1, 0, 0), curve(0, 0, 1))] == ["static", "peaked", "front-loaded", "rear-loaded"]
    assert [one(spark, vectors.direction(F.lit(x), F.lit(y), F.lit(m))) for x, y, m in ((0.0, 1.0, 1.0), (1.0, 0.1, 1.0), (1.0, 1.0, 1.0), (1.0, 1.0, 0.0))] == ["down", "right", "mixed", "static"]


def test_keyframes(spark):
    rows = [("a", i, 1.0 if i in (3, 4) else 0.0, [float(i), 0.0]) for i in range(10)] + [("b", 0, 0.0, [0.0])]
    got = motion.keyframes(spark.createDataFrame(rows, "key string, idx int, activity double, vector array<double>"), most=5).collect()
    a = [x["idx"] for x in got if x["key"] == "a"]
    assert {0, 9, 3, 4} <= set(a) and len(a) == 5 and [x["idx"] for x in got if x["key"] == "b"] == [0]


# ---- ranking


def plain_diversified(rows, limit):
    if len(rows) <= limit:
        return rows
    cap, seen, first, late = max(2, (limit + 2) // 3), {}, [], []
    for x in rows:
        seen[x[1]] = seen.get(x[1], 0) + 1
        (first if seen[x[1]] <= cap else late).append(x)
    return (first + late)[:limit]


def test_diversified_limit(spark):
    r = random.Random(3)
    rows, want = [], {}
    for q in range(60):
        n, limit = r.randint(0, 20), 6
        own = [(i, r.choice("abc"), q) for i in range(n)]
        rows += own
        want[q] = [x[0] for x in plain_diversified(own, limit)]
    df = spark.createDataFrame(rows, "i int, site_id string, q int")
    got = {}
    for x in ranking.diversified(df, 6, [F.col("i").asc()], group=["q"]).orderBy("q", "rank").collect():
        got.setdefault(x["q"], []).append(x["i"])
    assert all(got.get(q, []) == w for q, w in want.items())


def test_first_seen_is_the_ordered_pass(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, *"abcdefgh"]), r.choice([None, *"stuvwxyz"])) for i in range(120)]
    ids, links, want = set(), set(), []
    for i, a, b in rows:
        if (a is not None and a in ids) or (b is not None and b in links):
            continue
        ids |= {a} - {None}
        links |= {b} - {None}
        want.append(i)
    got = ranking.first_seen(spark.createDataFrame(rows, "i int, a string, b string"), "i", ["a", "b"])
    assert sorted(x["i"] for x in got.collect()) == want


# ---- fusion


def test_rank_fusion(spark):
    rows = [("q", "a", " x ", 1), ("q", "a", "", 2), ("q", "a", "y", 3), ("q", "a", "x", 4), ("q", "b", "y", 1), ("q", " ", "z", 1)]
    df = spark.createDataFrame(rows, "query_id string, channel string, id string, rank int")
    got = fusion.reciprocal_rank_fusion(df, {"b": 2.0}).orderBy("rank").collect()
    assert [(x["id"], x["rrf_score"], x["channel_count"]) for x in got] == [("y", round(1 / 62 + 2 / 61, 8), 2), ("x", round(1 / 61, 8), 1)]
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion(df, {"a": 0.0})
    allowed = spark.createDataFrame([("x",)], "id string")
    assert [x["id"] for x in fusion.reciprocal_rank_fusion(df, allowed=allowed).collect()] == ["x"]


def test_review_routing(spark):
    agree = [("q", c, i, k) for c in "ab" for k, i in enumerate("vwxyz", 1)]
    differ = [("r", c, i, k) for c, order in (("a", "vwxyz"), ("b", "klmno")) for k, i in enumerate(order, 1)]
    df = spark.createDataFrame(agree + differ + [("s", "a", "v", 1)], "query_id string, channel string, id string, rank int")
    got = {x["query_id"]: x for x in fusion.review_routing(fusion.reciprocal_rank_fusion(df), df).collect()}
    assert not got["q"]["required"] and got["q"]["candidate_ids"] == [] and got["q"]["top5_overlap"] == 1
    assert set(got["r"]["reasons"]) == {"disagreement", "narrow-lead", "low-overlap"} and len(got["r"]["candidate_ids"]) == 5
    assert got["s"]["reasons"] == ["few-rankers"]


def test_confidence_table(spark):
    got = [one(spark, fusion.confidence(F.lit(a), F.lit(b))) for a, b in ((3, 3), (2, 2), (1, 3), (1, 2), (0, 0))]
    assert got == ["high", "medium", "medium", "low", "low"]


def test_eligibility(spark):
    rows = [("keyframes", "exact", None), ("metadata-only", "exact", None), ("keyframes", "", None), ("keyframes", "exact", "contradicted"), (None, "exact", None)]
    got = fusion.eligible(spark.createDataFrame(rows, "analysis_depth string, match_quality string, vlm_verdict string")).collect()
    assert [x["excluded"] for x in got] == [None, "not-inspected", "unresolved-quality", "contradicted", "not-inspected"]
    with pytest.raises(Exception, match="unknown quality"):
        fusion.eligible(spark.createDataFrame([("keyframes", "fine", None)], "analysis_depth string, match_quality string, vlm_verdict string")).collect()


def test_ranking_status(spark):
    ranked = spark.createDataFrame([("a", "formal")] * 8 + [("b", "low")], "query_id string, bucket string")
    progress = spark.createDataFrame([("a", 0, 0, "none"), ("b", 3, 0, "none"), ("c", 24, 0, "none"), ("d", 1, 1, "exhausted")], "query_id string, live_checked int, captured int, stop_reason string")
    got = {x["query_id"]: (x["status"], x["effective_stop_reason"]) for x in fusion.ranking_status(ranked, progress).collect()}
    assert got == {"a": ("complete", "none"), "b": ("needs-more-review", "none"), "c": ("confidence-shortfall", "live-check-budget-exhausted"), "d": ("confidence-shortfall", "exhausted")}


# ---- scoring


def test_coverage_and_fit_tables(spark):
    rows = [(0.0, 0, 0, "gap"), (12.0, 7, 10, "exact"), (12.0, 6, 10, "adjacent"), (2.0, 1, 1, "adjacent"), (24.0, 0, 3, "adjacent"), (0.0, 0, 2, "gap")]
    got = spark.createDataFrame(rows, "s double, m int, n int, want string").select(scoring.direct_coverage(F.col("s"), F.col("m"), F.col("n")).alias("g"), "want").collect()
    assert all(x["g"] == x["want"] for x in got)
    names = ("direct", "n_core", "n_pref", "n_comp", "m_core", "m_pref", "m_comp", "missing_facets")
    table = [
        (("exact", 0, 0, 0, 0, 0, 0, 0), ("strong", 0.75, "compatible")), (("gap", 0, 2, 0, 0, 1, 0, 0), ("strong", 0.225, "compatible")), (("gap", 0, 3, 0, 0, 1, 0, 0), ("usable", 0.183, "compatible")),
        (("exact", 2, 0, 1, 2, 0, 0, 0), ("usable", 0.75, "reference-only")), (("exact", 2, 0, 0, 1, 0, 0, 1), ("weak", 0.475, "compatible")), (("gap", 2, 0, 0, 1, 0, 0, 0), ("usable", 0.475, "compatible")),
    ]
    df = spark.createDataFrame([c for c, _ in table], ", ".join(f"{n} {'string' if n == 'direct' else 'int'}" for n in names))
    f = scoring.quick_fit({n: F.col(n) for n in names})
    got = df.select(f["quick_fit"].alias("f"), f["quick_score"].alias("s"), f["quick_compatibility"].alias("c")).collect()
    assert [tuple(x) for x in got] == [w for _, w in table]
    e = lambda *a: one(spark, scoring.expanded_coverage(*map(F.lit, a)))
    assert [e("gap", 2, 1, 1), e("exact", 1, 2, 1), e("exact", 0, 0, 0), e("gap", 1, 0, 0)] == ["exact", "adjacent", "exact", "adjacent"]


# ---- curation


def test_audit_decisions(spark):
    rows = [("a", 1, "static"), ("a", 2, "dynamic"), ("a", 3, "broken"), ("b", 1, "static"), ("b", 2, "static"), ("c", 1, "broken"), ("c", 2, "broken"), ("d", 1, "static"), ("d", 2, "broken"), ("e", 1, "broken"), ("f", 1, "unverified")]
    got = {x["id"]: (x["decision"], x["reason"], x["winning_report"]) for x in curation.audit_decisions(spark.createDataFrame(rows, "id string, report_no int, state string")).collect()}
    assert got == {
        "a": ("keep", "dynamic-verified", 2), "b": ("quarantine", "static-confirmed-twice", None), "c": ("quarantine", "broken-confirmed-twice", None),
        "d": ("quarantine", "static-needs-second-confirmation", None), "e": ("quarantine", "broken-needs-second-confirmation", None), "f": ("quarantine", "motion-unverified", None),
    }


RECORD = "id string, url string, media_url string, runtime_url string, last_verified string, link_scope string, evidence_kinds array<string>, evidence_kind string, media_verified_at string, runtime_verified_at string, verification_kind string, verified_at string"


def test_curate(spark):
    base = lambda i, u, **k: (i, u, k.get("m"), None, k.get("v"), None, k.get("e", []), k.get("ek"), k.get("md"), k.get("md"), k.get("vk"), k.get("v"))
    rows = [base("a", "https://h/1"), base("b", "https://h/1/", v="2024-01-01"), base("c", "https://h/2", ek="public-list-api", md="2024-05-01"), base("d", "https://h/3", ek="public-list-api", md="2024-06-01"),
            base("e", "https://h/4", v="2024-01-01", vk="browser-page-motion"), base("f", "https://h/5", m="x"), base("g", "https://h/6", m="x", e=["k"])]
    audits = spark.createDataFrame([(i, 1, "dynamic") for i in "abcdfg"], "id string, report_no int, state string")
    df = spark.createDataFrame(rows, RECORD)
    got = {x["id"]: (x["decision"], x["reason"]) for x in curation.curate(df, audits, "2024-06-01", preserve=True).collect()}
    assert got == {
        "a": ("quarantine", "duplicate-canonical-url"), "b": ("keep", "dynamic-verified"), "c": ("quarantine", "official-assets-not-currently-verified"), "d": ("keep", "dynamic-verified"),
        "e": ("keep", "preserved"), "f": ("quarantine", "duplicate-official-media"), "g": ("keep", "dynamic-verified"),
    }
    assert {x["id"]: x["reason"] for x in curation.curate(df, audits, "2024-06-01").collect()}["e"] == "motion-unverified"
    twice = spark.createDataFrame([rows[1], rows[1], rows[5]], RECORD)
    assert curation.deduplicated(twice)[0].count() == 2 and curation.deduplicated(twice, compatible=True)[0].count() == 1


def test_health_states(spark):
    schema = "id int, outer_status int, settled boolean, redirected_away boolean, access_restricted boolean, expects_render_target boolean, visually_observed boolean, capture_attempted boolean, capture_succeeded boolean, critical_statuses array<int>, console_errors array<string>, render_targets array<struct<visible:boolean,width:double,height:double>>, analysis_depth string"
    case = lambda i, status=200, **k: (i, status, k.get("settled"), k.get("away"), k.get("restricted"), k.get("expects"), k.get("seen"), k.get("tried"), k.get("done"), k.get("critical"), k.get("errors"), k.get("targets"), k.get("depth"))
    rows = [case(1), case(2, 404), case(3, 403), case(4, 200, seen=True, tried=True), case(5, 200, targets=[(None, 1.0, 1.0)], depth="keyframes"), case(6, 200, settled=True, expects=True, targets=[(True, 0.0, 1.0)]),
            case(7, 200, critical=[404]), case(8, 200, errors=["The project 7 was not found"]), case(9, None), case(10, 403, settled=True, expects=True)]
    got = {x["id"]: (x["state"], x["reasons"]) for x in curation.health_class(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("shell_reachable", ["outer-shell-only"]) and got[2] == ("broken", ["outer-status-404"]) and got[3] == ("shell_reachable", ["access-restricted"])
    assert got[4] == ("capture_restricted", ["render-confirmed-capture-failed"]) and got[5] == ("render_verified", ["visible-render-confirmed"])
    assert got[6] == ("broken", ["missing-render-target-after-settle"]) and got[7] == ("broken", ["critical-status-404"]) and got[8] == ("broken", ["content-fetch-error"])
    assert got[9] == ("shell_reachable", ["source-unreachable-or-unconfirmed"]) and got[10][0] == "shell_reachable"


# ---- sources, sinks, streams


def test_checked_lines(spark, tmp_path):
    from lodestone.sources import catalog

    (tmp_path / "x.jsonl").write_text('{"id": "a", "title": "t"}\n\n{"id": "b"}\n{broken\n[1]\n{"id": "c", "title": "u"}\n')
    good, bad = catalog.checked_lines(spark, f"file://{tmp_path}/x.jsonl", "id string, title string", ["id", "title"])
    assert [(x["line"], x["id"]) for x in good.orderBy("line").collect()] == [(1, "a"), (6, "c")]
    assert [(x["line"], x["error"]) for x in bad.orderBy("line").collect()] == [(3, "missing: title"), (4, "invalid JSON"), (5, "not an object")]


def test_links_and_sitemaps(spark):
    from lodestone.sources import catalog

    html = "<a href=\"/x\">1</a><script>'<a href=\"/no\">'</script><A class='c' HREF='/y'>2</A>"
    df = spark.createDataFrame([(1, html)], "id int, html string")
    assert [x["href"] for x in catalog.links(df).orderBy("pos").collect()] == ["/x", "/y"]
    assert df.select(catalog.exact_links("html").alias("l")).first()["l"] == ["/x", "/y"]
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a/1 </loc></url><url><loc>https://a/2</loc></url></urlset>'
    assert [x["loc"] for x in catalog.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).orderBy("pos").collect()] == ["https://a/1", "https://a/2"]


def test_paged_source(spark):
    from lodestone.sources import catalog

    pages = [{"cursor": "a", "items": [1, 2]}, {"cursor": "b", "items": [3]}, {"cursor": "a", "items": [9]}]
    spark.dataSource.register(catalog.PagedFiles)
    df = spark.read.format("paged_files").option("pages", json.dumps(pages)).load()
    assert [x["item"] for x in catalog.api_records(df).orderBy("page_no", "pos").collect()] == ["1", "2", "3"]
    assert catalog.api_records(df, target=2).count() == 2


def test_catalog_reader_and_validation(spark, tmp_path):
    from lodestone.sources import catalog, sinks, validation

    site = {"id": "a-b", "name": "N", "status": "active", "auth": "none", "kind": "editor", "homepage": "https://x.example", "routes": {"search": "https://x.example/?q={query}", "categories": {"c": "https://x.example/c"}},
            "capabilities": ["snippet"], "stacks": ["css"], "tags": ["t"], "license": {"status": "explicit", "url": None}, "added_at": "2024-2-3", "last_shallow_check": None, "last_deep_review": None}
    bad = site | {"id": "A", "homepage": "http://x", "added_at": "2024-02-30", "routes": {"search": "https://x.example/{page}"}}
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "catalog_version": "1.2", "sites": [site, bad]}, indent=1))
    sites = catalog.sites(spark, f"file://{tmp_path}/s.json")
    got = {x["id"]: x["errors"] for x in validation.validate_sites(sites).collect()}
    assert got == {"a-b": [], "A": ["id", "homepage", "routes", "added_at"]}
    assert catalog.route_urls(sites.where("id = 'a-b'")).count() == 3
    s = validation.summary(validation.validate_sites(sites)).first()
    assert (s["total"], s["failed"], s["ok"]) == (2, 1, False)
    manifest, asset = sinks.release_manifest(b"c", "1.2", "2024-01-01T00:00:00Z", "https://x.example/c.json", examples=b"e", examples_url="https://x.example/e.gz", compress=True)
    rows = spark.createDataFrame([{"min_version": "0", "examples_compression": None, "examples_content_sha256": None} | manifest])
    assert validation.validate_manifest(rows).first()["errors"] == [] and asset[:2] == b"\x1f\x8b"
    board = sinks.evidence_board(spark.createDataFrame([("i", "T", "https://x.example/1", "clip", [("p", 3)])], "id string, title string, url string, kind string, media array<struct<path:string,size:bigint>>"), "B</script>")
    assert "T" in board and "</script><" not in board.split('id="data">')[1].split("</script>")[0]


def test_release_is_one_step(spark, tmp_path):
    from lodestone.streaming import release

    root = f"file://{tmp_path}/r"
    a = spark.createDataFrame([("1.2",)], "catalog_version string")
    release.apply_release(spark, {"sites": a, "items": spark.range(3)}, root, "1")
    release.apply_release(spark, {"sites": a, "items": spark.range(5)}, root, "2")
    assert release.current_version(spark, root) in ("1", "2") and release.read_current(spark, root, "items").count() in (3, 5)
    newer = spark.createDataFrame([("1.10",)], "catalog_version string")
    assert release.effective(a, newer).first()[0] == "1.10" and release.effective(newer, a).first()[0] == "1.10" and release.effective(a, newer, errors=1).first()[0] == "1.2"


def test_notices_stream(spark, tmp_path):
    from lodestone.streaming import updates

    rows = [("a", "1", "2024-01-01 00:00:00"), ("a", "1", "2024-01-02 00:00:00"), ("a", "1", "2024-01-09 00:00:00"), ("a", "2", "2024-01-09 01:00:00"), ("b", "1", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "client string, version string, t string").selectExpr("client", "version", "cast(t as timestamp) as at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("client string, version string, at timestamp").parquet(f"{tmp_path}/in")
    got = updates.run_available(updates.notices(stream), "notices_test").orderBy("client", "at").collect()
    assert [(x["client"], x["version"], x["at"].day) for x in got] == [("a", "1", 1), ("a", "1", 9), ("a", "2", 9), ("b", "1", 1)]


def test_visual_index_round_trip(spark, tmp_path):
    from lodestone.sources import catalog, sinks

    df = spark.createDataFrame([("a", "full", 0, [3.0, 4.0]), ("b", "full", 0, [0.0, 2.0])], "case_id string, region string, frame_idx int, embedding array<double>")
    sinks.write_index(df, f"{tmp_path}/i")
    meta = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = {x["case_id"]: x["embedding"] for x in catalog.visual_index(spark, f"{tmp_path}/i", meta).collect()}
    assert [round(x, 3) for x in rows["a"]] == [0.6, 0.8]
    with pytest.raises(ValueError):
        catalog.visual_index(spark, f"{tmp_path}/i", meta.where("id = 'a'"))
