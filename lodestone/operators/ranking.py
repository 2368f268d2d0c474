"""Orders and limits: candidate order, source-diversified limits, top rows per group, order-dependent duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.scoring import COVERAGE_RANK, FIT_RANK


def level(column: str, ranks: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(column))


def candidate_order() -> list[Column]:
    """The nine levels of the candidate order; the id decides at last."""
    return [
        level("coverage", COVERAGE_RANK).desc(), level("quick_fit", FIT_RANK).desc(), F.col("quick_score").desc(), F.col("n_mechanism").desc(),
        F.col("n_matched").desc(), F.col("last_verified").isNull().asc(), F.col("recall_score").desc(), F.col("last_check").desc(), F.col("item_id").asc(),
    ]


def first_pass_cap(limit: int) -> int:
    return max(2, (limit + 2) // 3)


def diversified(df: DataFrame, limit: int, order: list[Column], source: str = "site_id", group: list[str] | None = None, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group, where rows past a source's cap wait until others had their turn.

    A row of a group can only be taken if it is among the first ``limit`` of its source, so each source is cut to
    that before the group is ranked: no task orders a whole group. Groups of at most ``limit`` rows keep their order.
    """
    group = group or []
    cap = first_pass_cap(limit)
    in_source = F.row_number().over(Window.partitionBy(*group, source).orderBy(*order))
    few = df.withColumn("_in_source", in_source).where(F.col("_in_source") <= limit)
    counted = Window.partitionBy(*group)
    ordered = few.withColumn("_all", F.count("*").over(counted)).withColumn("_rank", F.row_number().over(counted.orderBy(*order)))
    late = F.when(F.col("_all") <= limit, F.lit(0)).otherwise((F.col("_in_source") > cap).cast("int"))
    final = F.row_number().over(Window.partitionBy(*group).orderBy(late, "_rank"))
    return ordered.withColumn(rank, final).where(F.col(rank) <= limit).drop("_in_source", "_all", "_rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group with their rank; Spark cuts each task's rows first."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def positive_or_all(df: DataFrame, score: str, group: list[str]) -> DataFrame:
    """Rows with a positive score; in groups without any, all rows."""
    best = F.max(score).over(Window.partitionBy(*group))
    return df.withColumn("_best", best).where((F.col(score) > 0) | (F.col("_best") <= 0)).drop("_best")


#: Groups of rows that hang together by keys and have at most so many rows are folded in one call each.
FOLD_ROWS = 100_000


def first_seen(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Rows kept by an ordered pass that drops a row one of whose keys a kept row had; dropped rows register nothing.

    Rows of the same order come in the order of a hash of their keys, equal ones once. Null keys are no keys; a row
    without a key is kept.

    The pass is sequential only among rows that hang together by keys, so rows are grouped by connected component, and
    each component is folded in one call. A component of more than FOLD_ROWS is settled in rounds over the table: each
    keeps the rows that come first for all their keys and drops the rows that share a key with them.
    """
    from lodestone.plans.storage import checkpointed

    tie = F.xxhash64(*keys)
    rows = df.select(F.struct(F.col(order).alias("o"), tie.alias("t")).alias("_o"), *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]).distinct()
    names = [f"_k{i}" for i in range(len(keys))]
    rows = checkpointed(rows)
    labelled = checkpointed(_linked(rows, names))
    sizes = checkpointed(labelled.groupBy("_c").agg(F.count("*").alias("n")).where(F.col("n") > FOLD_ROWS))
    large = labelled.join(sizes, "_c", "left_semi")
    kept = _folded(labelled.join(sizes, "_c", "left_anti"), names)
    if not sizes.isEmpty():
        kept = kept.unionByName(_settled(large.select("_o", *names), names))
    kept = checkpointed(kept)
    whole = df.withColumn("_o", F.struct(F.col(order).alias("o"), tie.alias("t")))
    once = whole.withColumn("_n", F.row_number().over(Window.partitionBy("_o").orderBy(F.lit(1)))).where("_n = 1").drop("_n")
    return once.join(kept, "_o", "left_semi").drop("_o")


def _linked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The rows with ``_c``: the least order that they are linked with through shared keys.

    The least order goes from rows to keys and back until nothing changes, and jumps: a row also takes what the row
    that gave it its label has found by then.
    """
    from lodestone.plans.storage import checkpointed

    now = rows.withColumn("_c", F.col("_o"))
    while True:
        step = now
        for k in names:
            least = now.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_c").alias(f"_l{k}"))
            step = step.join(least, k, "left")
        step = step.withColumn("_new", F.least("_c", *[F.coalesce(f"_l{k}", "_c") for k in names])).drop(*[f"_l{k}" for k in names])
        jump = step.select(F.col("_o").alias("_new"), F.col("_new").alias("_further"))
        step = step.join(jump, "_new", "left").withColumn("_to", F.least("_new", F.coalesce("_further", "_new")))
        step = checkpointed(step.select("_o", *names, F.col("_c").alias("_old"), F.col("_to").alias("_c")))
        if step.where("_old <> _c").isEmpty():
            return step.drop("_old")
        now = step.drop("_old")


def _folded(rows: DataFrame, names: list[str]) -> DataFrame:
    """The orders kept, component by component."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        seen: set[tuple[int, str]] = set()
        kept = []
        part = part.sort_values(["_at", "_tie"], kind="stable")
        for at, *values in zip(part.index, *[part[n] for n in names]):
            own = {(i, v) for i, v in enumerate(values) if v is not None and v == v}
            if seen.isdisjoint(own):
                seen |= own
                kept.append(at)
        return part.loc[kept, ["_row"]]

    flat = rows.select("_c", F.col("_o.o").alias("_at"), F.col("_o.t").alias("_tie"), F.to_json("_o").alias("_row"), *names)
    found = flat.groupBy("_c").applyInPandas(fold, "_row string")
    return found.join(rows.select(F.to_json("_o").alias("_row"), "_o"), "_row").select("_o")


def _settled(open_rows: DataFrame, names: list[str]) -> DataFrame:
    """The orders kept, in rounds over all rows at once."""
    from lodestone.plans.storage import checkpointed

    kept = None
    while True:
        firsts = open_rows
        for k in names:
            least = open_rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("_o").alias(f"_f{k}"))
            firsts = firsts.join(least, k, "left")
        for k in names:
            firsts = firsts.where(F.col(f"_f{k}").isNull() | (F.col(f"_f{k}") == F.col("_o")))
        settled = checkpointed(firsts.select("_o", *names))
        if settled.isEmpty():
            return open_rows.select("_o").limit(0) if kept is None else kept
        kept = checkpointed(settled.select("_o") if kept is None else kept.unionByName(settled.select("_o")))
        rest = open_rows.join(settled.select("_o"), "_o", "left_anti")
        for k in names:
            rest = rest.join(settled.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        open_rows = checkpointed(rest.select("_o", *names))


def limited_per_source(df: DataFrame, source: str, url: str, order: list[Column], n: int) -> DataFrame:
    """The first n distinct urls of each source."""
    once = df.withColumn("_seen", F.row_number().over(Window.partitionBy(source, url).orderBy(*order))).where("_seen = 1").drop("_seen")
    return top_per_group(once, [source], order, n, "_rank").drop("_rank")


