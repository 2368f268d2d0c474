"""Steps whose memory, time or shuffle must not grow faster than their tables."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import batches, fusion, itempass, ladder, lexical, scoring, signatures
from lodestone.plans import standin


def _maxsim_by_hand(queries, frames):
    best = {}
    for q, i, v in queries:
        for c, w in frames:
            known = None not in (*v, *w) and len(v) == len(w)
            unit = lambda x: np.array(x) / max(np.sqrt(np.dot(x, x)), 1e-12)
            best.setdefault((q, c), {}).setdefault(i, []).extend([float(unit(v) @ unit(w))] if known else [])
    tops = {k: [max(x) for x in v.values() if x] for k, v in best.items()}
    return {k: sum(x) / len(x) if x else None for k, x in tops.items()}


def test_maxsim_multiplies_blocks_on_python_workers(spark, monkeypatch):
    """The values of all pairs, for null cases, other dimensions, nulls and zeros too, whatever the sizes of blocks; no join of pairs."""
    from lodestone.functions import vectors

    r = np.random.default_rng(5)
    queries = [(i // 3, i, r.standard_normal(4).tolist()) for i in range(11)] + [(9, 0, [0.0] * 4), (9, 1, [1.0, 2.0])]
    frames = [(f"c{i % 7}", r.standard_normal(4).tolist()) for i in range(90)] + [(None, [1.0, 0.0, 0.0, 0.0]), ("two", [3.0, 4.0]), ("null", [1.0, None, 2.0, 3.0]), ("c1", [2.0, 1.0])]
    q = spark.createDataFrame(queries, "query_id long, q_idx int, embedding array<double>")
    f = spark.createDataFrame(frames, "case_id string, embedding array<double>").repartition(3)
    want = _maxsim_by_hand(queries, frames)
    plan = fusion.maxsim(q, f)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    for tasks, held in ((100_000_000, 2_000_000), (200, 20)):
        monkeypatch.setattr(vectors, "TASK_PAIRS", tasks)
        run = vectors.best_cosines
        monkeypatch.setattr(vectors, "best_cosines", lambda shared, held=held: _with_held(run, shared, held))
        found = {(x["query_id"], x["case_id"]): x["score"] for x in fusion.maxsim(q, f).collect()}
        monkeypatch.setattr(vectors, "best_cosines", run)
        assert found.keys() == want.keys()
        assert all((found[k] is None) == (want[k] is None) and (want[k] is None or abs(found[k] - want[k]) < 1e-12) for k in want)


def _with_held(make, shared, held):
    def run(batches):
        from lodestone.functions import vectors

        before, vectors.HELD = vectors.HELD, held
        yield from make(shared)(batches)
        vectors.HELD = before

    return run


def test_only_the_cases_of_an_index_are_scored(spark, monkeypatch):
    """Signatures of no case are no results and take no rank, so they are not scored either."""
    from lodestone.operators import fusion as module

    sig = "struct<dominant_direction:string,changed_region:string,timing_character:string,activity_curve:array<double>,direction_histogram:map<string,double>>"
    rows = [(str(i), (("up", "mixed", "static")[i % 3], None, "even", [float(i % 7 + 1), 2.0], {"a": float(i + 1)})) for i in range(40)]
    signatures = spark.createDataFrame(rows, f"id string, signature {sig}")
    intents = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(rows[:6])], f"query_id long, intent {sig}")
    cases = spark.createDataFrame([("3",), ("17",), ("5",), ("none",)], "id string")
    scored = []
    plain = module.signature_scores
    monkeypatch.setattr(module, "signature_scores", lambda s, *a, **b: (scored.append(s.count()), plain(s, *a, **b))[1])
    moves = fusion.motion_ranking(intents, signatures, allowed=cases)
    want = fusion.clean_rankings(fusion.motion_ranking(intents, signatures), cases)
    key = lambda df: sorted((x["query_id"], x["id"], x["rank"]) for x in df.collect())
    assert key(moves) == key(want) and len(key(moves)) == 18
    none = spark.createDataFrame([], "query_id long, channel string, id string, rank int")
    found = fusion.index_search(intents, cases, none, {}, None, signatures, limit=5)
    assert key(found["results"]) == key(fusion.reciprocal_rank_fusion(want, module.SEARCH_WEIGHTS))
    assert sorted(scored) == [3, 3, 40]


def _items(spark):
    """Items with both scripts, nulls, repeated, missing and unknown tags."""
    rows = []
    for i in range(60):
        title = ("red widget", "a  Calm Blue RING", "卡片动效 blue", None, "", "gear small ring", "azure circle")[i % 7]
        tags = (["m-red"], ["m-blue", "m-blue"], [], None, ["m-small", None, "none"], ["m-turn", "m-large"])[i % 6]
        rows.append((f"p-{i}", f"s-{i % 4}", title, f"https://x.example/red/{i}", ["small", None, "Quiet"] if i % 5 else None, [("Brand#4", "Brand#1")[i % 2]], ("hover", "mount", None)[i % 3], None if i % 4 else "ring", tags, None if i % 3 else "2024-05-01", f"2024-01-{i % 28 + 1:02d}"))
    return spark.createDataFrame(rows, "item_id string, site_id string, title string, url string, search_terms array<string>, stacks array<string>, trigger_kind string, target_hint string, motion_ids array<string>, last_verified string, last_check string")


def test_items_are_matched_on_their_row_as_by_joins(spark, monkeypatch):
    """A table of all values and its aggregation in one task grew with the items of a file; the row's pass has neither."""
    items, motions, queries, groups = _items(spark), standin.motions(spark), standin.queries(spark), standin.groups(spark)
    queries = queries.unionByName(spark.createDataFrame([(11, "卡片动效 red"), (12, "ri"), (13, None), (14, "")], "query_id int, query string"))
    recall = spark.createDataFrame([(1, "p-3", 2.5), (7, "p-9", 0.0), (2, "p-1", 99.0), (3, "gone", 1.0)], "query_id int, item_id string, recall_score double")
    whole = lambda df: sorted(map(repr, df.collect()))
    for stage, earlier in (("global-expanded", None), ("global", None), ("taxonomy", recall)):
        monkeypatch.setattr(itempass, "ITEM_ROWS", 50_000)
        found = ladder.enriched(items, motions, queries, groups, stage, earlier)
        if earlier is None:
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Generate explode(transform(array(" not in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(itempass, "ITEM_ROWS", 7)
        again = whole(ladder.enriched(items, motions, queries, groups, stage, earlier))
        with monkeypatch.context() as m:
            m.setattr(itempass, "stated", lambda *sets: False)
            want = whole(ladder.enriched(items, motions, queries, groups, stage, earlier))
        assert len(want) > 20 and whole(found) == want and again == want


def test_tasks_of_items_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(itempass, "ITEM_ROWS", 7)
    out = itempass.item_matches(_items(spark).coalesce(1), standin.motions(spark), standin.queries(spark), standin.groups(spark))
    assert out.rdd.getNumPartitions() == 9


def test_texts_are_matched_in_slices_of_bounded_size(spark):
    """Ten thousand long texts and all their matches were in a worker's memory at once."""
    texts = ["red widget " * 2000 if i % 3 else None if i % 2 else "red" for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["id", "_norm"])
    assert [x for part in batches.text_slices([batch], 1) for x in part.column(0).to_pylist()] == list(range(400))
    shared = type("Shared", (), {"value": ([1, 2], [("red widget", ["red", "widget"]), ("red", ["red"])])})
    scored = lexical._scorer(shared, pa.int64(), 1, 6.0)
    texts = [t or "" for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["id", "_norm"])
    out = list(scored([batch]))
    sizes = [sum(len(texts[i]) for i in set(x.column(1).to_pylist())) for x in out]
    assert len(out) > 3 and max(sizes) <= batches.SLICE_BYTES + max(map(len, texts))
    assert sum(len(x) for x in out) == 2 * sum(t != "" for t in texts)
    one = spark.createDataFrame([(1, "red")], "k long, t string")
    lexical.text_scores(one, "k", "t", 1.0, spark.createDataFrame([(1, "red")], "query_id long, query string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= batches.BATCH_BYTES


_PARTS = "dominant_direction string, changed_region string, timing_character string, activity_curve array<double>, direction_histogram map<string,double>"


def _recordings(n):
    """Signatures with missing parts, odd numbers, names and values that no query has, and many ties."""
    r = random.Random(8)
    pick = lambda *x: r.choice([None, *x])
    odd = (0.0, 1.5, -2.0, None, float("nan"), float("inf"), 0.25)
    return [
        (pick("up", "mixed", "static", "", f"own{i % 50}"), pick("top", "full"), pick("even", "mixed", "static"), pick([r.choice(odd) for _ in range(r.randint(0, 6))], [1.0, 2.0]),
         pick({k: r.choice((0.0, 1.0, 2.5, None, float("nan"), float("inf"), 2.5)) for k in r.sample("abcdxyz", r.randint(0, 4))}, {"a": 1.0}))
        for i in range(n)
    ]


def test_all_pairs_are_ranked_without_a_shuffle_of_pairs(spark, monkeypatch):
    """All scored pairs went through a shuffle and a window to get their rank, and their number grows with the square."""
    sig = f"struct<{_PARTS}>".replace(" string", ":string").replace(" array", ":array").replace(" map", ":map")
    rows = _recordings(300)
    intents = spark.createDataFrame([(i, s) for i, s in enumerate(rows[:25])], f"query_id long, intent {sig}")
    whole = lambda df: sorted(map(repr, df.select("query_id", "id", "score", "rank").collect()))
    for kind, make in (("string", lambda i: (None, "", "é", "z", "卡片", "🙂")[i] if i < 6 else f"{i}"), ("long", lambda i: 150 - i)):
        s = spark.createDataFrame([(make(i), x) for i, x in enumerate(rows)], f"id {kind}, signature {sig}").repartition(3)
        want = fusion.ranks(signatures.scores(s, intents).selectExpr("query_id", "'motion' as channel", "id", "score"))
        first = whole(want.where("rank <= 7"))
        want = whole(want)
        found = fusion.motion_ranking(intents, s)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort" not in plan
        assert whole(found) == want and len(want) > 4000 and whole(fusion.motion_ranking(intents, s, 7)) == first
        with monkeypatch.context() as m:
            m.setattr(signatures, "TASK_PAIRS", 500)
            many = fusion.motion_ranking(intents, s)
            assert many.rdd.getNumPartitions() == 15 and whole(many) == want
            m.setattr(signatures, "RANKED_ROWS", 299)
            assert whole(fusion.motion_ranking(intents, s)) == want and whole(fusion.motion_ranking(intents, s, 7)) == first
    again = intents.unionByName(intents.where("query_id < 3"))
    other = spark.createDataFrame([(float(i), x) for i, x in enumerate(rows[:40])], f"id double, signature {sig}")
    for a, b in ((again, s.limit(40)), (intents, other)):
        scored = signatures.scores(b, a).selectExpr("query_id", "'motion' as channel", "id", "score")
        ranked = fusion.motion_ranking(a, b)
        assert sorted(ranked.select("query_id", "rank", "score").collect()) == sorted(fusion.ranks(scored).select("query_id", "rank", "score").collect())
    assert fusion.motion_ranking(intents.limit(0), s).count() == 0 and fusion.motion_ranking(intents, s.limit(0)).count() == 0


def test_blocks_of_any_size_rank_the_same(monkeypatch):
    """A task's queries, chunks, packed rows and batches, and copies for several tasks that come to one."""
    names = [x.split()[0] for x in _PARTS.split(", ")]
    rows = _recordings(90)
    asked = {c: [list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows[:13]] for i, c in enumerate(names)}
    kinds = [pa.string()] * 3 + [pa.list_(pa.float64()), pa.map_(pa.string(), pa.float64())]
    columns = [pa.array([list(r[i].items()) if isinstance(r[i], dict) else r[i] for r in rows], k) for i, k in enumerate(kinds)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(90, 0, -1)), *columns], names=["id", *names])
    known = {c: {v: i for i, v in enumerate(dict.fromkeys(("mixed", "static", *filter(None, asked[c]))), 1)} for c in names[:3]} | {"direction_histogram": {"a": 0, "b": 1, "c": 2, "d": 3, "x": 4, "y": 5, "z": 6}}
    shared = type("Shared", (), {"value": (pa.array(range(13)), signatures._packed(asked, known), known)})
    given = set()
    for pack, held, chunk, rows_given, tasks in ((5_000, 4_000_000, 32_768, 200_000, 1), (7, 200, 11, 3, 4), (89, 1, 1, 1, 13)):
        for name, value in (("PACK", pack), ("HELD", held), ("CHUNK", chunk), ("GIVEN", rows_given)):
            monkeypatch.setattr(signatures, name, value)
        packed = list(signatures._packer(shared)([batch.slice(0, 50), batch.slice(50)]))
        assert sum(p.column("n")[0].as_py() for p in packed) == 90
        copies = [pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), p.column("ids"), p.column("packed")], names=["_task", "ids", "packed"]) for p in packed for t in range(tasks)]
        out = list(signatures._ranker(shared, tasks, None)(copies))
        assert max(map(len, out)) <= rows_given
        given.add(tuple(sorted((q, r, i, s) for x in out for q, i, s, r in zip(*(c.to_pylist() for c in x.columns)))))
    assert len(given) == 1 and len(next(iter(given))) > 500


def test_taxonomy_items_are_scored_on_their_row_as_by_joins(spark, monkeypatch):
    """Item scores came from a table of all values, aggregated in the tasks of the file, and met their items in a join."""
    items = _items(spark).unionByName(_items(spark).limit(2).selectExpr("cast(null as string) as item_id", "* except (item_id)"))
    motions = standin.motions(spark)
    queries = standin.queries(spark).unionByName(spark.createDataFrame([(11, "卡片动效 red"), (12, "ri"), (13, None), (14, ""), (15, "a red calm blue ring 动 gear small ring"), (16, "azure circle")], "query_id int, query string"))
    best = spark.createDataFrame([(q, m, i, 0.5 * i) for q in (1, 2, 3, 7, 11, 13, 15) for i, m in enumerate(("m-red", "m-blue", "m-small", "m-large", "m-turn", "m-red"), 1)][:40], "query_id int, motion_id string, motion_rank int, score double")
    sites = spark.createDataFrame([(f"s-{i}", standin.KINDS[i % 5], "degraded" if i == 2 else "active", ["snippet"] if i % 2 else [], [f"Brand#{i}", "agnostic"], ["calm", "color"], "explicit" if i == 1 else None) for i in range(1, 9)],
                                  "site_id string, kind string, status string, capabilities array<string>, stacks array<string>, tags array<string>, license_status string")
    whole = lambda df: sorted(map(repr, df.collect()))
    ways = ({}, {"sites": sites}, {"sites": sites, "stack": "Brand#1", "capability": "snippet"})
    found = [whole(ladder.taxonomy_items(items, motions, queries, best, 3, **w)) for w in ways]
    scores = whole(scoring.item_score(items.where("item_id is not null"), queries).select("query_id", "item_id", "score"))
    plan = ladder.taxonomy_items(items, motions, queries, best, 3, sites)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortMergeJoin" not in plan
    with monkeypatch.context() as m:
        m.setattr(itempass, "ITEM_ROWS", 7)
        assert itempass.item_points(items.coalesce(1), queries).rdd.getNumPartitions() == 9
        assert [whole(ladder.taxonomy_items(items, motions, queries, best, 3, **w)) for w in ways] == found
    with monkeypatch.context() as m:
        m.setattr(scoring, "small", lambda df, *a: df is not queries and "kind" not in df.columns)
        assert [whole(ladder.taxonomy_items(items, motions, queries, best, 3, **w)) for w in ways] == found
        assert whole(scoring.item_score(items.where("item_id is not null"), queries).select("query_id", "item_id", "score")) == scores
    assert len(scores) > 100 and min(map(len, found)) > 3 and len(found[0]) > 50


def test_units_and_values_in_queries_as_in_sql(spark):
    texts = ["卡片动效 red-1 a", "卡", "a b.c+ #d 3d.", "", "é x", "卡片 动", "動畫動畫"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.text_units(F.col("t")).alias("u")).collect()
    assert all(set(x["u"]) == lexical.text_units_of(x["t"]) for x in rows)
    queries = [("red ring", ["red", "ring"]), ("", []), ("ring", ["ring"]), ("a ring ring", ["a", "ring"])]
    contained = itempass.Contained(queries)
    want = lambda v: {i: n for i, (q, u) in enumerate(queries) if (n := 4 * (v != "" and v in q) + len(lexical.text_units_of(v) & set(u)))}
    assert all(contained.match(v) == want(v) for v in ("ring", "red", "g r", "ring ring", "", "none", "r", "gear ring"))
