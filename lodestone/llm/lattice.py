"""Embedding near-duplicates by lattice hashing.

Each table projects the unit vectors to eight dimensions by random orthonormal rows, scales them and decodes them
to the nearest point of the E8 lattice. A vector is stored in its own cell of every table and also looks into the
neighbouring cells that lie nearest to it. Of the pairs that meet, those whose 128 sign bits of other projections
differ in more than ``_max_signs`` places go at once (a pair at the threshold is seven deviations away from that);
the rest are verified by cosine in double precision.

Equal vectors are one row for the search, with the number of their copies, so copies are not expanded into pairs.
Pairs of different near copies are counted pair by pair, since the number of links is part of the result; only
their two row numbers are shuffled.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths do not link. Repeated ids: each row is a vector, and a component's id is the least. Rows without an id
count as links, but name no component. Empty tables give empty results; extra columns are not looked at.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, components, met

THRESHOLD = 0.95
#: With these, pairs at the threshold are found with a probability over 0.9998, and one random pair in 400 meets.
TABLES = 8
PROBES = 16
#: The lattice's unit, in distances that two vectors at the threshold have in a projection.
SCALE = 1.0
SEED = 5


def e8_roots() -> np.ndarray:
    """The 240 shortest vectors: the steps to a cell's neighbours."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((-1.0, 1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest points of D8: integers with an even sum."""
    near = np.rint(x)
    odd = np.nonzero(near.sum(axis=1) % 2)[0]
    if len(odd):
        gap = x[odd] - near[odd]
        worst = np.abs(gap).argmax(axis=1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def e8_nearest(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    """A hash of each lattice point: of doubled coordinates, which are integers."""
    h = np.full(points.shape[:-1], (table + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(8):
            h = (h ^ np.rint(points[..., i] * 2).astype(np.int64).view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Hash:
    """Projections of ``tables`` tables for vectors of a dimension."""

    def __init__(self, dim: int, threshold: float = THRESHOLD, tables: int = TABLES, scale: float = SCALE, seed: int = SEED):
        r = np.random.default_rng(seed)
        k = min(8, dim)
        self.rows = [np.linalg.qr(r.standard_normal((dim, dim)))[0][:, :k] for _ in range(tables)]
        self.shift = r.random((tables, 8))
        # what a pair at the threshold is apart in k of dim dimensions, typically
        apart = np.sqrt(max(2 - 2 * threshold, 1e-6) * k / dim)
        self.unit = scale * apart
        self.roots = e8_roots()
        self.planes = r.standard_normal((dim, 128))

    def cells(self, unit: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of own cells, (rows, tables), and of the nearest neighbouring cells, (rows, tables, probes)."""
        own, near = [], []
        for t, rows in enumerate(self.rows):
            x = np.zeros((len(unit), 8))
            x[:, : rows.shape[1]] = unit @ rows
            x = x / self.unit + self.shift[t]
            point = e8_nearest(x)
            side = (x - point) @ self.roots.T
            best = np.argpartition(-side, probes, axis=1)[:, :probes] if probes < len(self.roots) else np.tile(np.arange(len(self.roots)), (len(x), 1))
            own.append(_key(point, t))
            near.append(_key(point[:, None, :] + self.roots[best], t))
        return np.stack(own, axis=1), np.stack(near, axis=1)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """128 sign bits of random projections as two longs a row."""
        bits = unit @ self.planes > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


@lru_cache(8)
def hash_for(dim: int, threshold: float, tables: int, scale: float, seed: int) -> Hash:
    return Hash(dim, threshold, tables, scale, seed)


def _max_signs(threshold: float) -> int:
    p = float(np.arccos(min(1.0, threshold)) / np.pi)
    return int(np.ceil(128 * p + 7.4 * np.sqrt(128 * p * (1 - p)))) + 1


def unit_vector(x) -> np.ndarray | None:
    """The vector over its length, or None if it can link with nothing."""
    if x is None or not len(x) or any(c is None for c in x):
        return None
    v = np.asarray(x, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0 or np.isnan(v).any():
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _units(df: DataFrame, vector: str, id: str) -> DataFrame:  # noqa: A002
    """Rows (id, uid, unit): uid is the same for equal directions, null for vectors that cannot link."""

    def run(batches):
        for batch in batches:
            units = [unit_vector(x) for x in batch.column(1).to_pylist()]
            uids = [None if u is None else xxhash.xxh64_intdigest(u.tobytes(), len(u)) >> 1 for u in units]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(uids, pa.int64()), pa.array(units, pa.list_(pa.float64()))], names=["id", "uid", "unit"])

    slim = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("unit"))
    return slim.mapInArrow(run, "id long, uid long, unit array<double>")


def _cells(classes: DataFrame, threshold: float, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """Rows (uid, own, near, s0, s1): keys of own and of neighbouring cells, and sign bits."""

    def run(batches):
        for batch in batches:
            uid = batch.column(0).to_numpy()
            units = batch.column(1).to_pylist()
            for dim in sorted({len(u) for u in units}):
                at = np.array([i for i, u in enumerate(units) if len(u) == dim])
                for part in np.array_split(at, -(-len(at) // 2000)):
                    unit = np.array([units[i] for i in part])
                    h = hash_for(dim, threshold, tables, scale, seed)
                    own, near = h.cells(unit, probes)
                    signs = h.signs(unit)
                    lists = [pa.array(list(own ^ dim)), pa.array((near ^ dim).tolist(), pa.list_(pa.list_(pa.int64())))]
                    yield pa.RecordBatch.from_arrays([pa.array(uid[part]), *lists, pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=["uid", "own", "near", "s0", "s1"])

    return classes.select("uid", "unit").mapInArrow(run, "uid long, own array<long>, near array<array<long>>, s0 long, s1 long")


def _packed(tables: int) -> list[Column]:
    """32 bits of each table's own key, two tables a long."""
    low = lambda t: F.get("own", F.lit(t)).bitwiseAND(F.lit(0xFFFFFFFF))
    return [low(t).bitwiseOR(F.shiftleft(low(t + 1), 32)) if t + 1 < tables else low(t) for t in range(0, tables, 2)]


def _same(t: int) -> Column:
    """Whether two vectors share their own cell of table t, by 32 bits of its key."""
    both = F.col(f"o{t // 2}").bitwiseXOR(F.col(f"q{t // 2}"))
    return (F.shiftrightunsigned(both, 32) if t % 2 else both.bitwiseAND(F.lit(0xFFFFFFFF))) == 0


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine reaches the threshold, with the copies on both sides."""
    side = lambda n: classes.select(F.col("uid").alias(n), F.col("unit").alias(f"u{n}"), F.col("n").alias(f"n{n}"), F.size("unit").alias(f"d{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("da = db").select("a", "b", "na", "nb", "ua", "ub")

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x, y = (col[n].flatten().to_numpy() for n in ("ua", "ub"))
            starts = col["ua"].offsets.to_numpy()
            starts = (starts - starts[0])[:-1]
            ok = np.add.reduceat(x * y, starts) >= threshold if len(starts) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([col[n] for n in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long, na long, nb long")


def near_duplicates(df: DataFrame, vector: str = "embedding", id: str = "vec_id", threshold: float = THRESHOLD, tables: int = TABLES,  # noqa: A002
                    probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable) and kept (it is the least)."""
    scratch = Scratch(df.sparkSession, "lattice")
    rows = scratch.put(_units(df, vector, id), "rows")
    classes = scratch.put(
        rows.where("uid is not null").groupBy("uid").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("unit").alias("unit")), "classes"
    )
    cells = scratch.put(_cells(classes, threshold, tables, probes, scale, seed), "cells")
    packed = _packed(tables)
    index = cells.select("uid", "s0", "s1", *[c.alias(f"o{i}") for i, c in enumerate(packed)], F.explode("own").alias("key"))
    # a table's own cell comes first, then its neighbours
    looks = [F.struct(F.lit(t if own else -1).alias("t"), (F.array(F.get("own", F.lit(t))) if own else F.get("near", F.lit(t))).alias("keys")) for t in range(tables) for own in (True, False)]
    ball = cells.select(F.col("uid").alias("p"), F.col("s0").alias("p0"), F.col("s1").alias("p1"), *[c.alias(f"q{i}") for i, c in enumerate(packed)], F.explode(F.array(*looks)).alias("l"))
    ball = ball.select("p", "p0", "p1", *[f"q{i}" for i in range(len(packed))], "l.t", F.explode("l.keys").alias("key"))
    differ = F.bit_count(F.col("s0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("p1")))
    # a pair is given once, by the first table whose own cell it shares; by neighbouring cells only if there is none
    before, first = F.lit(False), F.lit(False)
    for t in range(tables):
        first = first | ((F.col("t") == t) & ~before)
        before = before | _same(t)
    once = F.when(F.col("t") < 0, ~before).otherwise((F.col("uid") < F.col("p")) & first)
    near = met(index, ball, "key").where((F.col("uid") != F.col("p")) & (differ <= _max_signs(threshold)) & once)
    pairs = scratch.put(near.select(F.least("uid", "p").alias("a"), F.greatest("uid", "p").alias("b")).distinct(), "pairs")
    linked = scratch.put(_verified(pairs, classes, threshold), "links")
    sums = linked.select(F.col("a").alias("uid"), F.col("nb").alias("m")).union(linked.select("b", "na")).groupBy("uid").agg(F.sum("m").alias("m"))
    comps = scratch.put(components(linked, scratch), "components").select(F.col("id").alias("uid"), "component")
    named = classes.drop("unit").join(comps, "uid", "left").join(sums, "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    top = named.groupBy("component").agg(F.min("least").alias("top"))
    found = scratch.put(named.join(top, "component").select("uid", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"), "top"), "found")
    out = rows.select("id", "uid").join(found, "uid", "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("top", "id").alias("component_id"))
    return scratch.keep(out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(False))))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The query's rows in DuckDB, by comparing all pairs and following links.
ORACLE = f"""
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY 1), k AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
