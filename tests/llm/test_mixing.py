"""A source of few rows and a large weight: its copies are spread over tasks and the mix is the same."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import mixing


def test_one_row_with_a_large_weight(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.lit("one")).otherwise(F.lit("many")).alias("source"))
    out = mixing.mix(df, weights={"one": 99.0, "many": 1.0})
    tasks = out.where("source = 'one'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    total = sum(x["count"] for x in tasks)
    assert total > 1_900_000 and len(tasks) >= 6 and max(x["count"] for x in tasks) < 0.4 * total
    assert out.select("position").distinct().count() == out.count()
    # at every slot, no source is a whole block from its share
    slots = out.groupBy("slot").agg(F.first("source").alias("s"), F.count_distinct("source").alias("k")).orderBy("slot").limit(3_000).collect()
    ones = 0
    for i, x in enumerate(slots):
        ones += x["s"] == "one"
        assert x["k"] == 1 and x["slot"] == i and abs(ones - 0.99 * (i + 1)) < 1


def test_epochs_in_lots_equal_epochs_at_once(spark, monkeypatch):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3, F.lit("few")).otherwise(F.lit("many")).alias("source"), F.lit("x").alias("epoch"))
    rows = lambda: Counter(tuple(x) for x in mixing.mix(df, weights={"few": 5.0, "many": 1.0}).collect())
    whole = rows()
    monkeypatch.setattr(mixing, "EPOCHS_AT_ONCE", 4)
    assert rows() == whole and len(whole) == whole.total()
