"""Column functions on vectors, curves and motion signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector over its length (at least FLOOR)."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(FLOOR))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(FLOOR))


#: Pairs of vectors that a task compares, that are compared at once, and best values that are held before they are given.
TASK_PAIRS, PAIRS, HELD = 100_000_000, 500_000, 2_000_000


def unit_rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: places and unit vectors of the rows that have no null; the same values as l2_normalize."""
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    starts, flat = column.offsets.to_numpy(), column.values
    sizes = np.diff(starts)
    ok = column.is_valid().to_numpy(zero_copy_only=False)
    if flat.null_count:
        gone = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        ok = ok & (gone[starts[1:]] == gone[starts[:-1]])
    values = flat.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes[ok]).tolist():
        at = np.nonzero(ok & (sizes == dim))[0]
        x = values[starts[at][:, None] + np.arange(dim)[None, :]]
        with np.errstate(invalid="ignore", over="ignore"):
            out[dim] = at, x / np.maximum(np.sqrt((x * x).sum(axis=1)), FLOOR)[:, None]
    return out


def best_cosines(shared):
    """From rows (case_id, v), against a broadcast table (query_id, q_idx, v): the best cosine per query vector and case of the rows so far.

    Null if no frame of the case has the vector's dimension.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        ids, idx = (asked.column(i).combine_chunks() for i in (0, 1))
        sides = unit_rows(asked.column(2).combine_chunks())
        n = len(ids)
        held: dict = {}
        kind = None

        def given() -> Iterator[pa.RecordBatch]:
            cases, best = list(held), list(held.values())
            step = max(1, HELD // 8 // n)
            for at in range(0, len(cases), step):
                value, some = np.concatenate(best[at : at + step]), len(cases[at : at + step])
                rows, of = pa.array(np.tile(np.arange(n), some)), pa.array(np.repeat(np.arange(some), n))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), idx.take(rows), pa.array(cases[at : at + step], kind).take(of), pa.array(value, mask=np.isneginf(value))], names=["query_id", "q_idx", "case_id", "best"]
                )
            held.clear()

        def place(case) -> Iterator[pa.RecordBatch]:
            # what is held goes out before its memory grows; a case that comes again is given again
            if case not in held:
                if held and (len(held) + 1) * n > HELD:
                    yield from given()
                held[case] = np.full(n, -np.inf)

        for batch in batches:
            kind = batch.schema.field(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            cases, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            met = set()
            for dim, (at, x) in unit_rows(batch.column(1)).items():
                if dim not in sides:
                    continue
                columns, y = sides[dim]
                order = np.argsort(codes[at], kind="stable")
                own, x, step = codes[at][order], x[order], max(1, PAIRS // len(columns))
                for lo in range(0, len(own), step):
                    part = own[lo : lo + step]
                    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                    top = np.maximum.reduceat(x[lo : lo + step] @ y.T, cuts, axis=0)
                    for code, best in zip(part[cuts].tolist(), top):
                        met.add(code)
                        yield from place(cases[code])
                        row = held[cases[code]]
                        row[columns] = np.maximum(row[columns], best)
            for code in set(range(len(cases))) - met:
                yield from place(cases[code])
        yield from given()

    return run


def _finite(curve: Column) -> Column:
    clean = F.filter(curve, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    top = F.greatest(F.array_max(F.transform(clean, lambda x: F.abs(x))), F.lit(1e-9))
    return F.transform(clean, lambda x: x / top)


def dtw_similarity(left: Column, right: Column) -> Column:
    """1 less the time-warped distance of two curves scaled to their peaks; null if either has no number."""
    a, b = _finite(left), _finite(right)
    inf = F.lit(float("inf"))

    def row(previous: Column, x: Column) -> Column:
        # one row of the cost table: the running cell is the last element
        steps = F.sequence(F.lit(1), F.size(b))

        def cell(current: Column, j: Column) -> Column:
            best = F.least(F.element_at(current, -1), F.get(previous, j), F.get(previous, j - 1))
            return F.concat(current, F.array(F.abs(x - F.get(b, j - 1)) + best))

        return F.aggregate(steps, F.array(inf), cell)

    start = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: inf))
    last = F.element_at(F.aggregate(a, start, row), -1)
    distance = last / F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), distance)))


def categorical_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.5 if one is mixed, 0 if one is static, else 0.15; null if one is missing."""
    either = lambda v: (a == v) | (b == v)
    missing = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(~missing, F.when(a == b, F.lit(1.0)).when(either("mixed"), F.lit(0.5)).when(either("static"), F.lit(0.0)).otherwise(F.lit(0.15)))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Cosine of two maps from name to weight, 0 to 1; null if one is all zero."""
    names = F.array_distinct(F.concat(F.map_keys(a), F.map_keys(b)))
    of = lambda m: F.transform(names, lambda k: F.coalesce(F.try_element_at(m, k), F.lit(0.0)))
    norm = F.sqrt(dot(of(a), of(a)) * dot(of(b), of(b)))
    return F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(of(a), of(b)) / norm)))


#: Weights of the parts of a signature.
SIGNATURE_WEIGHTS = {"dominant_direction": 1.2, "changed_region": 0.8, "timing_character": 0.8, "activity_curve": 1.2, "direction_histogram": 1.0}


def weighted_present(parts: dict[str, tuple[Column, float]]) -> Column:
    """The weighted mean of the parts that are not null; null if none is."""
    top = reduce(lambda s, p: s + F.coalesce(p[0] * p[1], F.lit(0.0)), parts.values(), F.lit(0.0))
    weight = reduce(lambda s, p: s + F.when(p[0].isNotNull(), F.lit(p[1])).otherwise(F.lit(0.0)), parts.values(), F.lit(0.0))
    return F.when(weight > 0, top / weight)


def signature_similarity(a: Column, b: Column) -> Column:
    """Similarity of two signature structs over the parts both have."""
    parts = {k: (categorical_similarity(a[k], b[k]), SIGNATURE_WEIGHTS[k]) for k in ("dominant_direction", "changed_region", "timing_character")}
    parts["activity_curve"] = (dtw_similarity(a["activity_curve"], b["activity_curve"]), SIGNATURE_WEIGHTS["activity_curve"])
    parts["direction_histogram"] = (histogram_similarity(a["direction_histogram"], b["direction_histogram"]), SIGNATURE_WEIGHTS["direction_histogram"])
    return weighted_present(parts)


def curve_bins(curve: Column, bins: int = 8, digits: int = 4) -> Column:
    """Means of at most ``bins`` consecutive runs of a curve; the first runs are one longer if it does not divide."""
    n = F.size(curve)
    k = F.least(F.lit(bins), n)
    base, extra = F.floor(n / k).cast("int"), F.pmod(n, k).cast("int")
    start = lambda i: i * base + F.least(i, extra)
    size = lambda i: base + F.when(i < extra, F.lit(1)).otherwise(F.lit(0))
    mean = lambda i: F.round(F.aggregate(F.slice(curve, start(i) + 1, size(i)), F.lit(0.0), lambda s, x: s + x) / size(i), digits)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), k - 1), mean)).otherwise(F.array().cast("array<double>"))


def timing_character(curve: Column) -> Column:
    """static, peaked, front-loaded, rear-loaded or even, by the weighted centre and the first peak of a curve."""
    n, top = F.size(curve), F.array_max(curve)
    last = F.greatest(n - 1, F.lit(1))
    weighted = F.aggregate(F.transform(curve, lambda x, i: x * i / last), F.lit(0.0), lambda s, x: s + x)
    center = weighted / F.greatest(F.aggregate(curve, F.lit(0.0), lambda s, x: s + x), F.lit(1e-9))
    peak = (F.array_position(curve, top) - 1) / last
    return (
        F.when((n == 0) | (top < 0.002), F.lit("static"))
        .when(center.between(0.35, 0.65) & peak.between(0.25, 0.75), F.lit("peaked"))
        .when(center < 0.4, F.lit("front-loaded"))
        .when(center > 0.6, F.lit("rear-loaded"))
        .otherwise(F.lit("even"))
    )


def region(x: Column, y: Column, changed: Column) -> Column:
    """Where a picture changes: full, left, right, top, bottom or center, in this order of tests."""
    return (
        F.when(changed > 0.72, F.lit("full")).when(x < 0.34, F.lit("left")).when(x > 0.66, F.lit("right")).when(y < 0.34, F.lit("top")).when(y > 0.66, F.lit("bottom")).otherwise(F.lit("center"))
    )


def direction(dx: Column, dy: Column, magnitude: Column) -> Column:
    """static, up, down, left, right or mixed."""
    return (
        F.when(magnitude < 0.0008, F.lit("static"))
        .when(F.abs(dx) < F.abs(dy) * 0.7, F.when(dy > 0, F.lit("down")).otherwise(F.lit("up")))
        .when(F.abs(dy) < F.abs(dx) * 0.7, F.when(dx > 0, F.lit("right")).otherwise(F.lit("left")))
        .otherwise(F.lit("mixed"))
    )


def ssim(x: Column, y: Column) -> Column:
    """Structural similarity of two columns of values 0 to 255 over a group, as one window (an aggregate)."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    mx, my = F.avg(x), F.avg(y)
    top = (2 * mx * my + c1) * (2 * F.covar_pop(x, y) + c2)
    return top / ((mx * mx + my * my + c1) * (F.var_pop(x) + F.var_pop(y) + c2))
