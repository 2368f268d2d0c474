"""Mixing of sources to target weights by Pfair scheduling.

A source's rows come in blocks, one block a slot. Of a period of Q slots a source owns p; its k-th block of the
period is released at slot floor(k Q / p) and due by slot ceil((k + 1) Q / p). Earliest deadline first among the
released blocks fills every slot, and no source is ever a whole block away from its share of the slots so far. The
schedule of one period, at most ``slots`` plus the number of sources long, is made by one SQL expression and holds
for every period.

Each source's rows are put in an order that a hash of their key decides; ranks come from counts by hash range, as many
ranges as the largest source needs, so no source is gathered in one task. A row that is taken more than
``EPOCHS_AT_ONCE`` times is first copied once for each so many epochs, and the copies are dealt out. The mix ends when the scarcest source in relation to its weight, taken once, is
used up; the others start again (``epoch``) until then, so that the shares are the targets and no row is left out.

A null source is a source of its own. A source without a weight in ``weights`` is an error; a weight without rows
is left out. Repeated rows are rows of their own. An empty table gives an empty mix. Added columns get free names
if the caller's table has theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, free_name

BLOCK_ROWS = 16
SLOTS = 1_000
#: Without explicit weights, a source's weight is its number of rows to this power.
SMOOTHING = 0.7
HASH_BITS = 60
#: Ranges of the hash, as a power of two at the least, and rows that a range of the largest source has, about.
RANGE_BITS, RANGE_ROWS = 10, 50_000
EPOCHS_AT_ONCE = 256

#: The period's schedule from src (array of key, n, p) and q (sum of p): for each slot, the source and its block.
_SCHEDULE = """
aggregate(
  sequence(0, cast(q as int) - 1),
  named_struct('k', array_repeat(cast(0 as bigint), size(src)), 'out', cast(array() as array<struct<i:int,k:bigint,slot:int>>)),
  (acc, t) -> transform(
    array(array_min(transform(
      filter(sequence(0, size(src) - 1), i -> acc.k[i] < src[i].p and (acc.k[i] * q) div src[i].p <= t),
      i -> named_struct('due', ((acc.k[i] + 1) * q + src[i].p - 1) div src[i].p, 'i', i))).i),
    i -> named_struct(
      'k', transform(acc.k, (x, j) -> if(j = i, x + 1, x)),
      'out', concat(acc.out, array(named_struct('i', i, 'k', acc.k[i], 'slot', t)))))[0],
  acc -> acc.out)
"""


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def order_hash(key: Column) -> Column:
    """60 bits of the MD5 of the key's text."""
    return F.conv(F.left(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(HASH_BITS // 4)), 16, 10).cast("long")


def shares(counts: DataFrame, weights: dict[str, float] | None = None, smoothing: float = SMOOTHING, slots: int = SLOTS) -> DataFrame:
    """From rows (key, n): one row of src (array of key, n, p by key) and q. More sources than slots are an error."""
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(smoothing))
    else:
        table = F.create_map(*[x for k, v in weights.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))])
        w = F.coalesce(F.element_at(table, F.col("key")), F.raise_error(F.concat(F.lit("no weight for source "), F.col("key"))).cast("double"))
    few = F.assert_true(F.count("*") <= slots, f"more than {slots} sources; raise slots")
    rows = F.array_sort(F.collect_list(F.struct("key", "n", "w")))
    return counts.withColumn("w", w).agg(rows.alias("src"), F.sum("w").alias("sum"), few.alias("few")).where("size(src) > 0 and few is null").select(
        F.transform("src", lambda s: F.struct(
            s["key"].alias("key"), s["n"].alias("n"), F.greatest(F.lit(1), F.round(s["w"] / F.col("sum") * slots)).cast("long").alias("p"))).alias("src"),
    ).withColumn("q", F.aggregate("src", F.lit(0).cast("long"), lambda a, s: a + s["p"]))


def schedule(share: DataFrame) -> DataFrame:
    """One row per slot of a period: key, k (block of its source), slot, n, p, q and ``take``, the rows wanted of the source."""
    # rows of the whole mix: what the source that is scarcest for its weight needs to be used once
    whole = F.aggregate("src", F.lit(0).cast("long"), lambda a, s: F.greatest(a, F.ceil(s["n"] * F.col("q") / s["p"])))
    slots = share.withColumn("whole", whole).withColumn("out", F.when((F.size("src") > 0) & (F.col("q") > 0), F.expr(_SCHEDULE)))
    one = slots.select("src", "q", "whole", F.explode("out").alias("o"))
    own = F.get(F.col("src"), F.col("o.i"))
    return one.select(
        own["key"].alias("key"), F.col("o.k").alias("k"), F.col("o.slot").cast("long").alias("slot"), own["n"].alias("n"), own["p"].alias("p"), "q",
        F.greatest(own["n"], F.ceil(F.col("whole") * own["p"] / F.col("q"))).cast("long").alias("take"),
    )


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str, float] | None = None, smoothing: float = SMOOTHING,
        block_rows: int = BLOCK_ROWS, slots: int = SLOTS, names: tuple[str, ...] = ("epoch", "block", "slot", "position")) -> DataFrame:
    """The rows of the mix with epoch, block (of the source), slot and position; ordering by position is the mix.

    ``position`` counts ``block_rows`` for each slot, so it has gaps after the last block of a source only.
    """
    scratch = Scratch(df.sparkSession, "mix")
    names = tuple(free_name(df, n) for n in names)
    row, s, h, r, rank = (free_name(df, n) for n in ("row", "source_key", "order_hash", "hash_range", "rank"))
    # the counts read only the source and the key
    own = df.select(_source_key(source).alias("key"), F.lit(1).alias("one"))
    counts = scratch.put(own.groupBy("key").agg(F.count("*").alias("n")), "counts")
    period = scratch.put(schedule(shares(counts, weights, smoothing, slots)), "period")
    stream = period.groupBy("key").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("q").alias("q"), F.first("take").alias("take"))
    most, again = stream.agg(F.max("n"), F.max(F.ceil(F.col("take") / F.col("n")))).first()
    bits = max(RANGE_BITS, (-(-(most or 1) // RANGE_ROWS) - 1).bit_length())
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if not _unhashable(df, c)])
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), _source_key(source).alias(s), order_hash(F.col(f"`{key}`")).alias(h), tie.alias(rank))
    keyed = keyed.withColumn(r, F.shiftright(h, HASH_BITS - bits))
    ranges = df.select(_source_key(source).alias(s), F.shiftright(order_hash(F.col(f"`{key}`")), HASH_BITS - bits).alias(r)).groupBy(s, r).agg(F.count("*").alias("n"))
    before = ranges.withColumn("before", F.sum("n").over(Window.partitionBy(s).orderBy(r).rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col(s).alias("s"), F.col(r).alias("r"), F.coalesce("before", F.lit(0)).alias("before"))

    within = F.row_number().over(Window.partitionBy(s, r).orderBy(h, rank))
    ranked = keyed.withColumn("within", within).join(before, (F.col(s) == F.col("s")) & (F.col(r) == F.col("r")))
    ranked = ranked.select(row, s, (F.col("before") + F.col("within") - 1).alias(rank))
    # at most slots plus sources rows each
    ranked = ranked.join(F.broadcast(stream), F.col(s) == F.col("key")).drop("key")
    last = F.floor((F.col("take") - 1 - F.col(rank)) / F.col("n")).cast("long")
    zero = F.lit(0).cast("long")
    if (again or 0) <= EPOCHS_AT_ONCE:
        epochs = ranked.withColumn("e", F.explode(F.sequence(zero, last)))
    else:
        lots = ranked.withColumn("e0", F.explode(F.sequence(zero, F.floor(last / EPOCHS_AT_ONCE).cast("long"))))
        lots = lots.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(rank), F.col("e0"), F.col(s))
        first = F.col("e0") * EPOCHS_AT_ONCE
        epochs = lots.withColumn("e", F.explode(F.sequence(first, F.least(last, first + EPOCHS_AT_ONCE - 1)))).drop("e0")
    index = F.col("e") * F.col("n") + F.col(rank)
    blocks = epochs.withColumn("b", F.floor(index / block_rows)).withColumn("at", F.pmod(index, F.lit(block_rows)))
    blocks = blocks.withColumn("k0", F.pmod("b", F.col("p"))).drop("n", "p", "take")
    placed = blocks.drop("q").join(F.broadcast(period.select("key", "k", F.col("slot").alias("in_period"), "p", "q")), (F.col(s) == F.col("key")) & (F.col("k0") == F.col("k")))
    slot = F.floor(F.col("b") / F.col("p")) * F.col("q") + F.col("in_period")
    values = (F.col("e").cast("int"), F.col("b"), slot, slot * block_rows + F.col("at"))
    return scratch.keep(placed.select(*[F.col(row).getField(c).alias(c) for c in df.columns], *[v.alias(n) for v, n in zip(values, names)]))


def _unhashable(df: DataFrame, c: str) -> bool:
    return "map<" in df.schema[c].dataType.simpleString() or "variant" in df.schema[c].dataType.simpleString()


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the mix of all documents, weights being the sources' sizes to the power SMOOTHING."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)


#: The query's rows in DuckDB: the schedule slot by slot in a recursive query.
ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT source, n, coalesce('=' || source, 'null') AS key, pow(n, {SMOOTHING}) AS w FROM n),
s AS (SELECT source, key, n, greatest(1, round(w / (SELECT sum(w ORDER BY key) FROM w) * {SLOTS}))::BIGINT AS p, row_number() OVER (ORDER BY key) AS i FROM w),
c AS (SELECT list(p ORDER BY i) AS ps, sum(p)::BIGINT AS q, max(i) AS m FROM s),
whole AS (SELECT max(ceil(n * q / p)) AS whole FROM s, c),
edf(t, k, pick) AS (
  SELECT -1::BIGINT, list_transform(ps, lambda x: 0::BIGINT), 0::BIGINT FROM c
  UNION ALL
  SELECT t + 1, list_transform(k, lambda x, j: CASE WHEN j = nxt THEN x + 1 ELSE x END), nxt FROM (
    SELECT t, k, list_min(list_transform(list_filter(range(1, m + 1), lambda i: k[i] < ps[i] AND (k[i] * q) // ps[i] <= t + 1), lambda i: ((k[i] + 1) * q + ps[i] - 1) // ps[i] * 1000000 + i)) % 1000000 AS nxt FROM edf, c WHERE t + 1 < q)),
period AS (SELECT t AS slot, pick AS i, k[pick] - 1 AS k FROM edf WHERE t >= 0),
r AS (SELECT doc_id, d.source, i, n, p, q, greatest(n, ceil(whole * p / q))::BIGINT AS take,
  row_number() OVER (PARTITION BY d.source ORDER BY ('0x' || left(md5(doc_id::VARCHAR), 15))::BIGINT) - 1 AS rank
  FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source, c, whole),
e AS (SELECT *, unnest(range((take - 1 - rank) // n + 1)) AS e FROM r),
b AS (SELECT *, (e * n + rank) // {BLOCK_ROWS} AS b, (e * n + rank) % {BLOCK_ROWS} AS w FROM e)
SELECT doc_id, source, e::INTEGER AS epoch, b AS block, (b // p) * q + slot AS slot, ((b // p) * q + slot) * {BLOCK_ROWS} + w AS position
FROM b JOIN period ON period.i = b.i AND period.k = b.b % b.p
"""
