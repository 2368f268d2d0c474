"""Sessions, records, updates, ordered duplicates and signatures: edge cases against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import helpers, vectors
from lodestone.operators import delivery, ladder, motion, ranking, scoring, signatures
from lodestone.plans import standin


def test_next_page_skips_what_was_shown_and_ends(spark):
    rows = [("q", f"i{k}", f"https://a.example/{k % 4}", k) for k in range(8)] + [("q", "none", None, 99), ("r", "i0", "https://a.example/0", 1)]
    c = spark.createDataFrame(rows, "query_id string, item_id string, url string, score int")
    shown = spark.createDataFrame([("q", "i7", None), ("q", None, "https://a.example/2/")], "query_id string, item_id string, url string")
    order = [F.col("score").desc(), F.col("item_id")]
    page = delivery.next_page(c, shown, order, 3)
    assert [x["item_id"] for x in page.where("query_id = 'q'").orderBy("rank").collect()] == ["none", "i5", "i4"]
    again = delivery.next_page(c, delivery.page_ledger(shown, page), order, 3)
    assert [(x["query_id"], x["item_id"]) for x in again.orderBy("query_id", "rank").collect()] == [("q", "i3")]
    with pytest.raises(ValueError):
        delivery.next_page(c, shown, order, 11)


def test_review_stops_at_three_failures_in_a_row(spark):
    outcomes = ["failed", "failed", "checked", "failed", "failed", "failed", "captured"]
    rows = [("q", i, o, False) for i, o in enumerate(outcomes)] + [("r", 0, "stopped", None), ("s", 0, "captured", True)]
    got = delivery.review_stop(spark.createDataFrame(rows, "query_id string, step int, outcome string, formal boolean")).orderBy("query_id", "step").collect()
    assert [(x["query_id"], x["step"], x["stop"]) for x in got] == [*(("q", i, None) for i in range(5)), ("q", 5, "three-failures"), ("r", 0, "user-stopped"), ("s", 0, None)]


def test_first_seen_with_ties_and_a_long_chain(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i // 2, r.choice([None, *map(str, range(40))]), r.choice([None, *map(str, range(40))])) for i in range(300)]
    rows += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(400)] + [(7, None, None), (7, None, None)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    tie = {tuple(x)[:3]: x["t"] for x in df.withColumn("t", F.xxhash64("a", "b")).collect()}
    seen, want = set(), []
    for row in sorted(set(rows), key=lambda x: (x[0], tie[x])):
        own = {(j, v) for j, v in enumerate(row[1:]) if v is not None}
        if seen.isdisjoint(own):
            seen |= own
            want.append(row)
    key = lambda x: tuple("" if v is None else str(v) for v in x)
    for limit in (100_000, 3):
        monkeypatch.setattr(ranking, "FOLD_ROWS", limit)
        got = [tuple(x) for x in ranking.first_seen(df, "i", ["a", "b"]).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_signatures_in_numpy_equal_the_expression(spark):
    r = random.Random(6)
    pick = lambda *x: r.choice([None, *x])

    def one(i):
        curve = pick([r.choice([0.0, 1.5, -2.0, None, float("nan"), r.random()]) for _ in range(r.randint(0, 6))])
        hist = pick({k: r.choice([0.0, 1.0, 2.5]) for k in r.sample("abcd", r.randint(0, 3))})
        return (i, pick("up", "mixed", "static", ""), pick("top", "full"), pick("even", "mixed"), curve, hist)

    schema = "id int, dominant_direction string, changed_region string, timing_character string, activity_curve array<double>, direction_histogram map<string,double>"
    parts = lambda: {c: F.col(c) for c in ("dominant_direction", "changed_region", "timing_character", "activity_curve", "direction_histogram")}
    s = spark.createDataFrame([one(i) for i in range(40)], schema).select("id", motion.signature(parts()).alias("signature"))
    q = spark.createDataFrame([one(i) for i in range(12)], schema).select(F.col("id").alias("query_id"), motion.signature(parts()).alias("intent"))
    want = s.join(F.broadcast(q)).select("query_id", "id", vectors.signature_similarity(F.col("intent"), F.col("signature")).alias("score")).where("score is not null")
    want = {(x["query_id"], x["id"]): x["score"] for x in want.collect()}
    got = {(x["query_id"], x["id"]): x["score"] for x in signatures.scores(s, q).collect()}
    assert got.keys() == want.keys() and len(got) > 200
    assert np.allclose([got[k] for k in got], [want[k] for k in got], atol=1e-8)
    few = {(x["query_id"], x["id"]): x["score"] for x in signatures.scores(s.coalesce(1), q, limit=3).collect()}
    for k in range(12):
        own = sorted((v for (a, _), v in got.items() if a == k), reverse=True)
        assert sorted((v for (a, _), v in few.items() if a == k), reverse=True)[:3] == own[:3]
    assert signatures.scores(s, q.limit(0)).count() == 0 and signatures.scores(s.limit(0), q).count() == 0


def test_stated_sets_in_blocks(spark, monkeypatch):
    s = spark.range(30).select("id", motion.signature({"dominant_direction": F.lit("up")}).alias("signature"))
    q = spark.range(25).select(F.col("id").alias("query_id"), motion.signature({"dominant_direction": F.when(F.col("id") % 2 == 0, F.lit("up")).otherwise(F.lit("down"))}).alias("intent"))
    whole = sorted(tuple(x) for x in signatures.scores(s, q).collect())
    monkeypatch.setattr(signatures, "small", lambda df: False)
    monkeypatch.setattr(signatures, "BROADCAST_ROWS", 7)
    assert sorted(tuple(x) for x in signatures.scores(s, q).collect()) == whole and len(whole) == 750


def test_cursors_that_loop_or_end(spark):
    from lodestone.sources import records

    pages = [("", "a", ["1"]), ("a", "b", ["2", "3"]), ("b", "c", ["4"]), ("c", "a", ["5"]), ("x", "y", ["9"]), ("e", None, [])]
    df = spark.createDataFrame(pages, "cursor string, next_cursor string, items array<string>")
    got = records.follow_cursors(df)
    assert [(x["page_no"], x["cursor"]) for x in got.orderBy("page_no").collect()] == [(0, ""), (1, "a"), (2, "b"), (3, "c")]
    assert [x["item"] for x in records.taken(got, 4).orderBy("page_no", "pos").collect()] == ["1", "2", "3", "4"]
    assert [x["item"] for x in records.taken(got, 4, have=2).orderBy("page_no", "pos").collect()] == ["1", "2"]
    assert records.follow_cursors(df, "e").count() == records.follow_cursors(df, "nowhere").count() == 0
    line = spark.range(300).select(F.col("id").cast("string").alias("cursor"), (F.col("id") + 1).cast("string").alias("next_cursor"), F.array(F.lit("i")).alias("items"))
    assert records.follow_cursors(line, "0").where("page_no = cast(cursor as long)").count() == 300


def test_lines_are_numbered_across_splits(spark, tmp_path):
    from lodestone.sources import catalog

    lines = ['{"id": "%s"}' % ("x" * (i % 90)) if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("{\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        good, bad = catalog.checked_lines(spark, f"file://{tmp_path}", "id string", ["id"])
        assert sorted((x["line"], len(x["id"])) for x in good.collect()) == [(i + 1, i % 90) for i in range(5000) if i % 7]
        assert [(x["line"], x["error"]) for x in bad.collect()] == [(1, "invalid JSON")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_release_checks_references_and_goes_back(spark, tmp_path):
    from lodestone.streaming import release

    root = f"file://{tmp_path}/r"
    sites = spark.createDataFrame([("a",), ("b",)], "id string")
    items = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, site_id string")
    keys = {("items", "site_id"): ("sites", "id")}
    release.apply_release(spark, {"sites": sites, "items": items}, root, "1", keys)
    release.apply_release(spark, {"sites": sites, "items": items.limit(1)}, root, "2", keys)
    assert release.current_version(spark, root) == "2" and release.read_current(spark, root, "items").count() == 1
    with pytest.raises(ValueError, match="site_id"):
        release.apply_release(spark, {"sites": sites.limit(0), "items": items}, root, "3", keys)
    assert release.current_version(spark, root) == "2"
    assert release.restore(spark, root) == "1" and release.read_current(spark, root, "items").count() == 2


def test_fetch_state(spark):
    from lodestone.streaming import updates

    state = spark.createDataFrame([("a", "e1", '{"v":1}'), ("b", "e2", '{"v":1}')], "client string, etag string, manifest string")
    checks = spark.createDataFrame([("a", 304, "x", None), ("b", 200, "e3", '{"v":2}'), ("c", 304, None, None), ("d", None, None, None), ("e", 200, "e5", "nothing")], "client string, http_status int, etag string, manifest string")
    fetched = updates.conditional_fetch(checks, state)
    assert {x["client"]: (x["fetch"], x["etag"], x["manifest"]) for x in fetched.collect()} == {
        "a": ("not-modified", "e1", '{"v":1}'), "b": ("ok", "e3", '{"v":2}'), "c": ("not-modified", None, None), "d": ("unreachable", None, None), "e": ("invalid", None, None),
    }
    assert {x["client"]: x["etag"] for x in updates.next_state(state, fetched).collect()} == {"a": "e1", "b": "e3"}
    assert updates.checked_config({"schema_version": 1}) and pytest.raises(ValueError, updates.checked_config, {"schema_version": 2})


def test_helpers(spark):
    assert helpers.pretty_json({"a": ["é"]}) == '{\n  "a": [\n    "é"\n  ]\n}\n'.encode()
    assert spark.range(1).select(helpers.utc_now().alias("x")).first()["x"].endswith("Z")
    rollup = spark.createDataFrame([("broken", 0), ("render_verified", 3)], "state string, n long")
    assert helpers.health_exit_code(rollup) == 0 and helpers.health_exit_code(rollup.withColumn("n", F.lit(1))) == 1
    bad = spark.createDataFrame([("[1]", "q")], "g string, q string").select(helpers.load_intent(F.col("g"), F.col("q")).alias("i"))
    with pytest.raises(Exception, match="JSON object"):
        bad.collect()


def test_ladder_filters(spark, tmp_path):
    items, motions = spark.createDataFrame([("i1", "s1", "red lamp", ["Brand#1"]), ("i2", "s2", "red lamp", ["Brand#2"]), ("i3", "s1", "red lamp", ["Brand#2"])], "item_id string, site_id string, title string, stacks array<string>"), standin.motions(spark)
    items = items.select("*", F.lit("https://x.example/").alias("url"), F.array(F.lit("red")).alias("search_terms"), F.lit("mount").alias("trigger_kind"), F.lit(None).cast("string").alias("target_hint"), F.array(F.lit("m-red")).alias("motion_ids"), F.lit("2024-01-01").alias("last_verified"), F.lit("2024-01-01").alias("last_check"))
    sites = spark.createDataFrame([("s1", "editor", ["snippet"]), ("s2", "community", ["inspiration"])], "site_id string, kind string, capabilities array<string>")
    sites = sites.select("*", F.col("site_id").alias("name"), F.lit("active").alias("status"), F.array(F.lit("Brand#1"), F.lit("Brand#2")).alias("stacks"), F.array(F.lit("calm")).alias("tags"), F.lit("explicit").alias("license_status"))
    queries = spark.createDataFrame([(1, "red")], "query_id int, query string")
    found = lambda **f: {x["item_id"] for x in ladder.search(items, motions, sites, queries, standin.groups(spark), limit=8, target=8, **f)["candidates"].collect()}
    assert found() == {"i1", "i2", "i3"}
    assert found(capability="inspiration", strategy="global") == {"i2"}
    only = ladder.search(items, motions, sites, queries, standin.groups(spark), limit=8, stack="Brand#2", kind="editor", strategy="taxonomy")
    assert {x["item_id"] for x in only["candidates"].collect()} == {"i3"} and {x["site_id"] for x in only["sites"].collect()} == {"s1"}
    assert scoring.site_score(sites, motions).count() == 2 * motions.count()


def test_lexical_pass_equals_the_joins(spark):
    from lodestone.operators import lexical

    r = random.Random(8)
    words = ["the lamp", "river", "Stone", "a", "动效", "春天动", "v1.2", "ui", "lamp  river", ""]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))) or None, f"s{i % 3}") for i in range(60)]
    queries = spark.createDataFrame([(1, "the lamp"), (2, "river stone"), (3, "春天动"), (4, "ui"), (5, ""), (6, "a"), (7, "river stone")], "query_id int, query string")
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    want = scoring.query_in_value_score(df.select("doc_id", F.col("text").alias("value"), F.lit(6.0).alias("weight")), "doc_id", queries)
    got = lexical.text_scores(df, "doc_id", "text", 6.0, queries, ("source",))
    rows = lambda t: sorted((x["query_id"], x["doc_id"], x["score"], tuple(sorted(x["matched_units"])), x["n_units"]) for x in t.collect())
    assert rows(got) == rows(want) and got.count() > 20
    assert all(x["source"] == f"s{x['doc_id'] % 3}" for x in got.collect())


def test_command_line(spark, tmp_path, capsys):
    import json

    from lodestone.__main__ import main

    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"state": s}) for s in ("broken", "render_verified")))
    assert main(["health", f"file://{tmp_path}/c.jsonl"], spark) == 1 and "broken\t1" in capsys.readouterr().out
    (tmp_path / "u.jsonl").write_text(json.dumps({"client": "a", "enabled": True, "now": "2024-06-10T00:00:00", "fetch": "invalid"}))
    assert main(["updates", f"file://{tmp_path}/u.jsonl"], spark) == 2 and "invalid_manifest\t1" in capsys.readouterr().out
    assert main(["list"], spark) == 0 and "next_page" in capsys.readouterr().out
    assert main(["run", "no such", "x"], spark) == 2
    with pytest.raises(SystemExit):
        main(["run", "x", "y", "--rows", "0"], spark)
