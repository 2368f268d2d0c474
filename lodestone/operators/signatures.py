"""Motion signatures against intents, in numpy over Arrow batches: all intents at once for each batch of signatures.

The same values as ``vectors.signature_similarity``, which is for one pair in SQL.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import FLOOR, SIGNATURE_WEIGHTS
from lodestone.operators.batches import bounded_batches
from lodestone.operators.joins import BROADCAST_ROWS, small

CATEGORIES = ("dominant_direction", "changed_region", "timing_character")
#: Pairs that are scored at once, and the decimals of a score (sums of floats depend on their order).
PAIRS, DIGITS = 500_000, 9
#: Ranking without a shuffle of pairs: the most signatures, and bytes of them, that a task holds, signatures of a packed
#: row, pairs that are worth a task, most tasks (and of a core), scores held and scored at once, and rows of a batch given.
RANKED_ROWS, RANKED_BYTES, PACK, TASK_PAIRS, TASKS, CORE_TASKS, HELD, CHUNK, GIVEN = 4_000_000, 256 << 20, 5_000, 50_000, 36, 3, 4_000_000, 32_768, 200_000


def _clean(curve) -> np.ndarray:
    """A curve without what is no number, over its peak."""
    x = np.array([np.nan if v is None else v for v in curve or ()], np.float64)
    x = x[np.isfinite(x)]
    return x / max(np.abs(x).max(initial=0.0), 1e-9)


def _warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Time-warped distances of all rows of a and of b, (rows of a, rows of b), over the longer length."""
    n, m = a.shape[1], b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    before, now = np.full((2, m + 1, a.shape[1], b.shape[1]), np.inf)
    before[0] = 0.0
    for i in range(n):
        now[0] = np.inf
        for j in range(m):
            least = np.minimum(now[j], before[j + 1])
            np.minimum(least, before[j], out=least)
            np.subtract(a[i][:, None], b[j][None, :], out=now[j + 1])
            np.abs(now[j + 1], out=now[j + 1])
            now[j + 1] += least
        before, now = now, before
    return before[m] / max(n, m)


def dtw(left: list, right: list) -> np.ndarray:
    """Similarities of all pairs of curves; NaN where one has no number. Curves of equal lengths go together."""
    sides = [[_clean(c) for c in curves] for curves in (left, right)]
    sizes = [np.array([len(c) for c in side], np.int64) for side in sides]
    out = np.full((len(left), len(right)), np.nan)
    for n in np.unique(sizes[0][sizes[0] > 0]):
        rows = np.nonzero(sizes[0] == n)[0]
        a = np.stack([sides[0][i] for i in rows])
        for m in np.unique(sizes[1][sizes[1] > 0]):
            columns = np.nonzero(sizes[1] == m)[0]
            d = _warped(a, np.stack([sides[1][j] for j in columns]))
            out[np.ix_(rows, columns)] = np.maximum(0.0, 1 - np.minimum(1.0, d))
    return out


def categories(left: list, right: list) -> np.ndarray:
    """1 if equal, 0.5 if one is mixed, 0 if one is static, else 0.15; NaN if one is missing."""
    a, b = np.array(left, dtype=object)[:, None], np.array(right, dtype=object)[None, :]
    is_ = lambda v: (a == v) | (b == v)
    missing = np.array([not x for x in left])[:, None] | np.array([not x for x in right])[None, :]
    return np.where(missing, np.nan, np.where(a == b, 1.0, np.where(is_("mixed"), 0.5, np.where(is_("static"), 0.0, 0.15))))


def histograms(left: list, right: list) -> np.ndarray:
    """Cosines, 0 to 1, of weights by name; NaN if one is missing or all zero."""
    names = {n: i for i, n in enumerate(sorted({k for h in (*left, *right) for k, _ in h or ()}))}

    def table(side: list) -> np.ndarray:
        out = np.zeros((len(side), len(names)))
        for i, h in enumerate(side):
            for k, v in h or ():
                out[i, names[k]] = v or 0.0
        return out

    a, b = table(left), table(right)
    norm = np.sqrt((a * a).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm > 0, np.clip(a @ b.T / np.maximum(norm, FLOOR * FLOOR), 0.0, 1.0), np.nan)


def similarity(left: dict[str, list], right: dict[str, list]) -> np.ndarray:
    """The weighted mean of the parts that both have; NaN if there is none."""
    parts = {c: categories(left[c], right[c]) for c in CATEGORIES}
    parts |= {"activity_curve": dtw(left["activity_curve"], right["activity_curve"]), "direction_histogram": histograms(left["direction_histogram"], right["direction_histogram"])}
    top, weight = 0.0, 0.0
    for k, value in parts.items():
        known = ~np.isnan(value)
        top = top + np.where(known, value, 0.0) * SIGNATURE_WEIGHTS[k]
        weight = weight + known * SIGNATURE_WEIGHTS[k]
    with np.errstate(invalid="ignore"):
        return np.where(weight > 0, np.round(top / np.maximum(weight, FLOOR), DIGITS), np.nan)


def _blocks(stated: DataFrame, key: str) -> Iterator[DataFrame]:
    """A stated table as it is if it is small, else in parts by a hash of its key that are."""
    n = 1 if small(stated) else -(-2 * stated.count() // BROADCAST_ROWS)
    for i in range(n):
        yield stated if n == 1 else stated.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)


def scores(signatures: DataFrame, intents: DataFrame, limit: int | None = None, ranked: bool = False) -> DataFrame:
    """Rows (query_id, id, score) of all pairs that have something in common, from (id, signature) and (query_id, intent).

    Intents are a stated set: they go to the executors in blocks of a checked size. With ``limit``, a batch gives no
    more than its best so many of each query, so what is ranked later does not grow with the signatures. With
    ``ranked``, the rows have their rank in the query by score, then id, and ``limit`` keeps the first so many.
    """
    fields = (*CATEGORIES, "activity_curve", "direction_histogram")
    slim = signatures.select("id", *[F.col(f"signature.{c}").alias(c) for c in fields])
    types = {"query_id": intents.schema["query_id"].dataType.simpleString(), "id": slim.schema["id"].dataType.simpleString()}
    schema = f"query_id {types['query_id']}, id {types['id']}, score double"
    out = None
    for block in _blocks(intents, "query_id"):
        rows = block.select("query_id", *[F.col(f"intent.{c}").alias(c) for c in fields]).toArrow()
        if not rows.num_rows:
            continue
        ids, asked = rows.column("query_id").combine_chunks(), {c: rows.column(c).to_pylist() for c in fields}
        found = _ranked(slim, ids, asked, limit, schema) if ranked else None
        if found is None:
            found = slim.mapInArrow(_scorer(ids, asked, limit), schema)
            if ranked:
                order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
                found = found.withColumn("rank", F.row_number().over(order))
                found = found if limit is None else found.where(F.col("rank") <= limit)
        out = found if out is None else out.unionByName(found)
    return signatures.sparkSession.createDataFrame([], schema + (", rank int" if ranked else "")) if out is None else out


def _scorer(queries: pa.Array, asked: dict[str, list], limit: int | None):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, PAIRS // len(queries))):
                part = batch.slice(at, max(1, PAIRS // len(queries)))
                own = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in asked}
                value = similarity(own, asked).T
                known = ~np.isnan(value)
                if limit is not None and value.shape[1] > limit:
                    # all that reach the limit's last score stay, so that ties are broken by id later
                    floor = -np.sort(-np.where(known, value, -1.0), axis=1)[:, limit - 1 : limit]
                    known &= value >= floor
                q, i = np.nonzero(known)
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), part.column(0).take(pa.array(i)), pa.array(value[q, i])], names=["query_id", "id", "score"])

    return run


# ---- all signatures ranked for each intent


def _ranked(slim: DataFrame, ids: pa.Array, asked: dict[str, list], limit: int | None, schema: str) -> DataFrame | None:
    """The pairs with their rank; None if a task cannot hold all signatures, or if ids do not order as in Arrow or repeat.

    All pairs of a query in one place would be a shuffle of all pairs. Instead each task takes some of the queries and
    a packed copy of all signatures, scores them and gives its queries' rows in order: what is shuffled is the
    signatures, once for each of a set number of tasks.
    """
    kind = slim.schema["id"].dataType.simpleString()
    if kind not in ("string", "tinyint", "smallint", "int", "bigint", "date") or len(pc.unique(ids)) < len(ids):
        return None
    from lodestone.plans.storage import checkpointed

    context = bounded_batches(slim.sparkSession).sparkContext
    known = {c: {v: i for i, v in enumerate(dict.fromkeys(("mixed", "static", *filter(None, asked[c]))), 1)} for c in CATEGORIES}
    known["direction_histogram"] = {n: i for i, n in enumerate(sorted({k for h in asked["direction_histogram"] for k, _ in h or ()}))}
    shared = context.broadcast((ids, _packed(asked, known), known))
    packed = checkpointed(slim.mapInArrow(_packer(shared), f"ids array<{kind}>, packed binary, n long, bytes long"))
    n, size = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n > RANKED_ROWS or size > RANKED_BYTES:
        return None
    tasks = max(1, min(-(-n * len(ids) // TASK_PAIRS), len(ids), max(TASKS, CORE_TASKS * context.defaultParallelism)))
    dealt = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("_task"), "ids", "packed").repartitionById(tasks, F.col("_task"))
    return dealt.mapInArrow(_ranker(shared, tasks, limit), schema + ", rank int")


def _packed(rows: dict[str, list], known: dict[str, dict]) -> dict[str, np.ndarray]:
    """Signatures as flat arrays: codes of categories (0 is missing, the last one not asked for), curves, histograms."""
    out = {c: np.array([known[c].get(v, len(known[c]) + 1) if v else 0 for v in rows[c]], np.int32) for c in CATEGORIES}
    curves = [_clean(c) for c in rows["activity_curve"]]
    out["length"], out["curve"] = np.array([len(c) for c in curves], np.int64), np.concatenate([*curves, np.empty(0)])
    names = known["direction_histogram"]
    weights = [[(names.get(k, -1), v or 0.0) for k, v in h or ()] for h in rows["direction_histogram"]]
    # names that no query has count in the norm alone; what is not finite makes the cosine no number
    squares = np.array([sum(v * v for _, v in h) if all(map(np.isfinite, [v for _, v in h])) else np.nan for h in weights], np.float64)
    weights = [[(k, v) for k, v in h if k >= 0] for h in weights]
    out["norm"], out["names"] = squares, np.array([len(h) for h in weights], np.int64)
    out["name"], out["weight"] = np.array([k for h in weights for k, _ in h], np.int32), np.array([v for h in weights for _, v in h], np.float64)
    return out


def _packer(shared):
    def run(batches):
        _, _, known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                rows = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in (*CATEGORIES, "activity_curve", "direction_histogram")}
                packed, ids = pickle.dumps(_packed(rows, known)), part.column(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([packed], pa.binary()), pa.array([len(ids)]), pa.array([len(packed) + ids.nbytes])],
                    names=["ids", "packed", "n", "bytes"],
                )

    return run


class _Side:
    """Packed signatures, of which some rows can be taken at a time."""

    def __init__(self, packed: list[dict[str, np.ndarray]]):
        self.flat = {k: np.concatenate([p[k] for p in packed]) for k in packed[0]}
        self.at = {k: np.cumsum(self.flat[k]) - self.flat[k] for k in ("length", "names")}

    def taken(self, rows: np.ndarray) -> dict:
        """The rows' categories and norms, curves as {length: (places, curves)}, and histograms as (places, names, weights)."""
        out = {k: self.flat[k][rows] for k in (*CATEGORIES, "norm")}
        sizes, starts = self.flat["length"][rows], self.at["length"][rows]
        out["curves"] = {}
        for n in np.unique(sizes[sizes > 0]):
            places = np.flatnonzero(sizes == n)
            out["curves"][n] = places, self.flat["curve"][starts[places, None] + np.arange(n)]
        sizes, starts = self.flat["names"][rows], self.at["names"][rows]
        places = np.repeat(np.arange(len(rows)), sizes)
        entries = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(places))
        out["histogram"] = places, self.flat["name"][entries], self.flat["weight"][entries]
        return out


def _similar(queries: dict, found: dict, known: dict[str, dict]) -> np.ndarray:
    """As ``similarity``, (queries, found), of rows taken from two sides."""
    shape = len(queries["norm"]), len(found["norm"])
    parts = {}
    for c in CATEGORIES:
        # what each query's value is worth by code of the other side
        codes, own = np.arange(len(known[c]) + 2)[None, :], queries[c][:, None]
        worth = np.where((own == 0) | (codes == 0), np.nan, np.where(own == codes, 1.0, np.where((own == 1) | (codes == 1), 0.5, np.where((own == 2) | (codes == 2), 0.0, 0.15))))
        parts[c] = worth[:, found[c]]
    parts["activity_curve"] = warped = np.full(shape, np.nan)
    for i, a in queries["curves"].values():
        for j, b in found["curves"].values():
            warped[np.ix_(i, j)] = np.maximum(0.0, 1 - np.minimum(1.0, _warped(a, b)))
    names, place = np.unique(queries["histogram"][1], return_inverse=True)
    left, right = np.zeros((shape[0], len(names))), np.zeros((shape[1], len(names)))
    left[queries["histogram"][0], place] = queries["histogram"][2]
    rows, name, weight = found["histogram"]
    at = np.searchsorted(names, name)
    asked = np.flatnonzero(np.append(names, -1)[at] == name)
    right[rows[asked], at[asked]] = weight[asked]
    norm = np.sqrt(queries["norm"][:, None] * found["norm"][None, :])
    top, total = 0.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        parts["direction_histogram"] = np.where(norm > 0, np.clip(left @ right.T / np.maximum(norm, FLOOR * FLOOR), 0.0, 1.0), np.nan)
        for k, value in parts.items():
            has = ~np.isnan(value)
            top = top + np.where(has, value, 0.0) * SIGNATURE_WEIGHTS[k]
            total = total + has * SIGNATURE_WEIGHTS[k]
        return np.where(total > 0, np.round(top / np.maximum(total, FLOOR), DIGITS), np.nan)


def _ranker(shared, tasks: int, limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, asked, known = shared.value
        own, first, ids, packed = set(), None, [], []
        for batch in batches:
            for i, task in enumerate(batch.column(0).to_pylist()):
                # copies are the same: one is enough for all tasks that come here
                first = task if first is None else first
                if task == first:
                    ids.append(pc.list_flatten(batch.column(1).slice(i, 1)))
                    packed.append(pickle.loads(batch.column(2)[i].as_py()))
                own.add(task)
        if not own:
            return
        ids, left, right = pa.concat_arrays(ids), _Side([asked]), _Side(packed)
        packed.clear()
        by_id = pc.sort_indices(ids, null_placement="at_start")
        ids, rows = ids.take(by_id), by_id.to_numpy().astype(np.int64)
        for task in sorted(own):
            mine = np.arange(task, len(queries), tasks)
            for few in np.split(mine, range(max(1, HELD // len(rows)), len(mine), max(1, HELD // len(rows)))):
                asked_rows, step = left.taken(few), max(1, CHUNK // len(few))
                value = np.concatenate([_similar(asked_rows, right.taken(rows[at : at + step]), known) for at in range(0, len(rows), step)], axis=1)
                for q, scored in zip(few, value):
                    yield from _in_order(queries[int(q)], ids, scored, limit)

    return run


def _in_order(query: pa.Scalar, ids: pa.Array, scored: np.ndarray, limit: int | None) -> Iterator[pa.RecordBatch]:
    """The rows of a query by score, then by place; a score and a place make one number to sort."""
    one = 10**DIGITS
    places = np.flatnonzero(~np.isnan(scored))
    keys = np.sort((one - np.rint(scored[places] * one).astype(np.int64)) << 32 | places)[:limit]
    for at in range(0, len(keys), GIVEN):
        place = keys[at : at + GIVEN] & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(query, len(place)), ids.take(pa.array(place)), pa.array(scored[place]), pa.array(np.arange(at + 1, at + 1 + len(place), dtype=np.int32))], names=["query_id", "id", "score", "rank"]
        )


def curve_scores(curves: DataFrame, asked: DataFrame, key: str = "id", curve: str = "curve") -> DataFrame:
    """Rows (query_id, key, dtw): time-warped similarity of every curve to every asked one (query_id, curve); null without a number."""
    slim = curves.select(key, F.col(curve).cast("array<double>").alias("curve"))
    kind = slim.schema[key].dataType.simpleString()
    out = None
    for block in _blocks(asked, "query_id"):
        rows = block.select("query_id", F.col(curve).cast("array<double>").alias("curve")).toArrow()
        if not rows.num_rows:
            continue
        ids, right = rows.column("query_id").combine_chunks(), rows.column("curve").to_pylist()

        def run(batches, ids=ids, right=right):
            for batch in batches:
                for at in range(0, batch.num_rows, max(1, PAIRS // len(ids))):
                    part = batch.slice(at, max(1, PAIRS // len(ids)))
                    value = np.round(dtw(part.column(1).to_pylist(), right), DIGITS)
                    i, q = (x.ravel() for x in np.indices(value.shape))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), part.column(0).take(pa.array(i)), pa.array(value.ravel(), from_pandas=True)], names=["query_id", key, "dtw"])

        found = slim.mapInArrow(run, f"query_id {asked.schema['query_id'].dataType.simpleString()}, {key} {kind}, dtw double")
        out = found if out is None else out.unionByName(found)
    return curves.sparkSession.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, {key} {kind}, dtw double") if out is None else out
