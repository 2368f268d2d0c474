"""Shared pieces: tables in the cluster's shared folder, connected components, text batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker handles at once.
SLICE_CHARS = 4_000_000
#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Edges that one task settles at once: 16 MB of ids. More are settled in rounds over the table.
SETTLED_EDGES = 1 << 20
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one made here if all run in one process, else an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of BATCH_BYTES at the most, so that a Python worker's memory does not follow the length of the texts."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub("[^0-9]", "", spark.conf.get(size))) > BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Parquet tables in the shared folder that cut lineage; a lost executor loses nothing of them.

    ``put`` writes and rereads; ``drop`` deletes a table that nothing refers to any more. What a returned DataFrame
    needs stays, whatever is derived from it, until :func:`release` is called with it, or the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._end = weakref.finalize(self, _try_delete, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).mode("overwrite").parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _try_delete(self.spark, self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        """The tables stay until ``release(df)``."""
        df._lodestone_scratch = [*getattr(df, "_lodestone_scratch", []), self]
        _alive.append(self)
        return df


_alive: list[Scratch] = []
atexit.register(_alive.clear)


def release(df: DataFrame) -> None:
    """Deletes the tables behind a DataFrame that an operator returned; it and what is derived from it cannot be read any more."""
    for scratch in df.__dict__.pop("_lodestone_scratch", []):
        _alive.remove(scratch)
        scratch._end()


def _try_delete(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is the cluster's to clean
        pass


def met(left: DataFrame, right: DataFrame, on: str | list[str]) -> DataFrame:
    """A join of exploded tables that meet in a shuffle: Spark sizes what was exploded as if it had its source's rows, and would broadcast it through the driver."""
    return left.join(right.hint("merge"), on)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def arrow_slices(batches: Iterator[pa.RecordBatch], text: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of batches with texts of about so many bytes; at least one row each."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars)) + 1
            yield batch.slice(at, until - at)
            at = until


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of batches of about SLICE_CHARS, each with its texts; at least one row each."""
    for part in arrow_slices(batches, text):
        yield part, part.column(part.schema.get_field_index(text)).to_pylist()


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v) and the least node that each reaches.

    Roots take their least neighbouring root until no edge joins two; each time at least half of the open ones go.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return nodes, nodes[root]
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _settled(edges: DataFrame) -> DataFrame:
    """Components (id, component) of few edges (u, v), in one task."""

    def run(batches):
        parts = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
        if parts:
            found = pa.RecordBatch.from_arrays([pa.array(x) for x in settle(*map(np.concatenate, zip(*parts)))], names=["id", "component"])
            for i in range(0, len(found), 1 << 16):
                yield found.slice(i, 1 << 16)

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", at_once: int = SETTLED_EDGES) -> DataFrame:
    """Connected components of undirected ``edges`` (longs): rows (id, component), the least id reachable.

    Up to ``at_once`` distinct edges are settled in one task: a round is a dozen of jobs, and what the driver keeps of
    jobs, threads and broadcasts is what it runs out of. More edges alternate large-star and small-star steps, each
    written to the shared folder, until the edges are stars and a round changes nothing: rounds grow as the square of
    the logarithm of the longest chain. Only counts come to the driver. Nodes without an edge are absent.
    """
    e = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).distinct()
    e, last, names = scratch.put(e, "cc0"), None, ["cc0"]
    if e.count() <= at_once:
        return _settled(e)
    for k in count(1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small_min, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v")))
        e = scratch.put(small.where("u <> v").distinct(), f"cc{k}")
        names.append(f"cc{k}")
        if len(names) > 2:
            scratch.drop(names.pop(0))
        now = tuple(
            e.agg(
                F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
            ).first()
        )
        if now == last or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        last = now
