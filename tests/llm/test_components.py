"""Connected components: at once and in rounds, and the jobs that op8 asks of the driver."""

import random

import numpy as np

from lodestone.llm import lattice, simhash
from lodestone.llm.common import Scratch, components


def by_hand(edges):
    above = {x: x for e in edges if e[0] != e[1] for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            above[max(a, b)] = min(a, b)
    return {x: top(x) for x in above}


def test_components_at_once_and_in_rounds(spark):
    r = random.Random(7)
    chain = r.sample(range(-(2**61), 2**61), 300)
    star = [(5, x) for x in range(6, 200)]
    loose = [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(250)]
    edges = [*zip(chain, chain[1:]), *star, *star, *loose, (3, 3), (2**63 - 1, -(2**63))]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    want = by_hand(edges)
    for name, at_once in (("once", len(edges)), ("rounds", 10)):
        scratch = Scratch(spark, name)
        rows = components(df, scratch, at_once=at_once).collect()
        assert len(rows) == len(want) and {x["id"]: x["component"] for x in rows} == want
    scratch = Scratch(spark, "none")
    assert components(df.limit(0), scratch).count() == 0


def test_simhash_asks_few_jobs_of_the_driver(spark):
    """What the driver holds grows with jobs, their threads and broadcasts; rounds over a few edges made a hundred of them."""
    r = np.random.default_rng(3)
    words = [str(x) for x in r.integers(0, 10_000, 900)]
    texts = []
    for i in range(120):  # each text is the one before with a word changed, so that links make chains
        words[i * 7] = f"new{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spark.sparkContext.setJobGroup("op8-jobs", "op8")
    try:
        got = {x["doc_id"]: x["component_id"] for x in simhash.classes(df).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    fps = [simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i in range(120) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = by_hand(near)
    assert got == {i: want.get(i, i) for i in range(120)}
    assert len(set(got.values())) < 60
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("op8-jobs")) < 50


def test_exploded_tables_meet_in_a_shuffle(spark, monkeypatch):
    """Spark sizes an exploded table as its source; a broadcast of it, which the driver builds, is many times as large."""
    plans = {}
    put = Scratch.put

    def told(self, df, name, **options):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, name, **options)

    monkeypatch.setattr(Scratch, "put", told)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 0
    df = spark.createDataFrame([(i, f"some words that are said {i % 7} times over and over again") for i in range(60)], "doc_id long, text string")
    assert simhash.classes(df).groupBy("component_id").count().count() <= 7
    assert simhash.dedup(df).count() <= 7
    vectors = spark.createDataFrame([(i, [float(i % 5 + 1), 1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert lattice.near_duplicates(vectors).count() == 20
    # cc0: edges of components; pairs: candidates of the pipeline's stage and of op5
    joined = [p for name in ("cc0", "pairs") for p in plans[name] if "Generate explode" in p and "Join" in p]
    assert len(joined) >= 4
    assert not [p for p in joined if "BroadcastHashJoin" in p]
