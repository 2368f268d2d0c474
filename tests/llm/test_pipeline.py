"""The pipeline's stages against brute-force versions on a small table."""

import random

import corpus_pipeline
from lodestone.llm import mixing, pieces, pii, quality, simhash


def test_stages(spark, tmp_path):
    r = random.Random(12)
    words = "the of and to in lamp river stone quiet garden window letter morning paper house bridge that for with".split()
    text = lambda: ". ".join(" ".join(r.choice(words) for _ in range(12)).capitalize() for _ in range(12)) + "."
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s0", 0) for i in range(10)]
    rows += [(200, "one two three four five six " * 30, "en", "s1", 0), (201, None, "en", "s1", 0), (202, text() + " mail x.y@z.example", "en", None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) in (4, 5)
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out/{name}")
        at = spark.read.parquet(f"{tmp_path}/out/{name}")
        seen[name] = at
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == list(corpus_pipeline.COLUMNS)
    good = {x["doc_id"] for x in seen["quality_rules"].collect()}
    assert good == {i for i, *_ in rows} - {200, 201}
    once = {x["doc_id"] for x in seen["simhash_near_dedup"].collect()}
    assert once == good - {100 + i for i in range(10)}
    private = {x["doc_id"]: x["text"] for x in seen["pii"].collect()}
    assert set(private) == once and "<EMAIL>" in private[202] and not any("@" in t for t in private.values())
    mixed = [x["doc_id"] for x in seen["mixing"].collect()]
    assert set(mixed) == once and len(mixed) >= len(once)
    v = pieces.load(pieces.default_model())
    for x in seen["sentencepiece"].collect():
        assert x["lossless"] and pieces.decode(x["ids"], pieces.vocabulary_bytes(v)) == private[x["doc_id"]]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"], tuple(x["ids"])) for x in whole.collect()) == sorted((x["doc_id"], tuple(x["ids"])) for x in seen["sentencepiece"].collect())
    assert all(m for m in (mixing, pii, quality, simhash))


def test_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
