"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the text's word
shingles. Fingerprints at Hamming distance up to ``radius`` link. They are cut into segments; every segment has a
table of all fingerprints, and a small Hamming ball around each fingerprint's segment is looked up in it. The
balls' radii t satisfy sum(t + 1) > radius, so a pair within the radius meets in some table. The whole distance
is verified inside the join.

Only distinct fingerprints are compared: exact copies count once, whatever their number. Links to the least
fingerprint of the same segment are joined to components first; the balls then only look for pairs between
different components, so a large group of near copies does not give all its pairs.

Null or empty text: no words, fingerprint zero, linked like any other. Repeated rows: the same class. Rows with a
null id get a fingerprint and, as component, their class's least id. Extra columns do no harm.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Scratch, components, free_name, met, slices

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Segments as (low bit, bits, ball radius): the radii plus one sum to 5, over RADIUS.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))


def _bits(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")
        # eight counters of a byte in each word: they can take 255 rows before they run over
        sums = np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0)
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_words(text: str | None, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """The unsigned 64-bit fingerprint of a whole text for each seed."""
    # bytes.lower and bytes.split know ASCII only, as the words are defined
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * len(seeds)
    line = b" ".join(words)
    ends = [x + i for i, x in enumerate(accumulate(map(len, words)))]
    starts = [0, *(x + 1 for x in ends[:-1])]
    parts = [line[a:b] for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])]
    digest = xxhash.xxh64_intdigest
    return [_bits(np.array([digest(x, seed) for x in parts], dtype="<u8")) for seed in seeds]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    return fingerprint_words(text, shingle)[0]


def fingerprints(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """The carried columns as k0, k1 ... and f0, f1 ..., the fingerprint of each seed as a signed long."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    source = df.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(carry))]
    words = [f"f{i}" for i in range(len(seeds))]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select(*names).schema.fields]

    def run(batches):
        for batch, texts in slices(batches, "text"):
            fps = np.array([fingerprint_words(t, shingle, seeds) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *map(pa.array, np.ascontiguousarray(fps.T))], names=[*names, *words])

    return source.mapInArrow(run, ", ".join([*fields, *(f"{w} long" for w in words)]))


def _segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _distance(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, segments=SEGMENTS) -> DataFrame:
    """Components (id, component) of distinct fingerprints ``fp``; a fingerprint without links is absent."""
    if sum(t + 1 for *_, t in segments) <= radius or any(t > 1 for *_, t in segments):
        raise ValueError("the balls' radii (0 or 1) do not cover the radius")
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), _segment(F.col("fp"), low, bits).alias("key")) for i, (low, bits, _) in enumerate(segments)]))
    index = distinct.select("fp", tables.alias("s")).select("fp", "s.t", "s.key")
    pivots = index.groupBy("t", "key").agg(F.min("fp").alias("pivot"))
    stars = (
        met(index, pivots, ["t", "key"])
        .where((F.col("fp") != F.col("pivot")) & (_distance(F.col("fp"), F.col("pivot")) <= radius))
        .select(F.col("fp").alias("a"), F.col("pivot").alias("b"))
    )
    first = scratch.put(components(stars, scratch), "first")
    labelled = scratch.put(
        distinct.join(first.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")),
        "labelled",
    )
    index = labelled.select("fp", "comp", tables.alias("s")).select("fp", "comp", "s.t", "s.key")
    probes = []
    for i, (low, bits, t) in enumerate(segments):
        key = _segment(F.col("fp"), low, bits)
        flips = [0, *(1 << b for b in range(bits))] if t else [0]
        probes += [F.struct(F.lit(i).alias("t"), key.bitwiseXOR(F.lit(x).cast("long")).alias("key")) for x in flips]
    ball = labelled.select(F.col("fp").alias("pfp"), F.col("comp").alias("pcomp"), F.explode(F.array(*probes)).alias("s")).select("pfp", "pcomp", "s.t", "s.key")
    more = (
        met(index, ball, ["t", "key"])
        .where((F.col("comp") != F.col("pcomp")) & (_distance(F.col("fp"), F.col("pfp")) <= radius))
        .select(F.least("comp", "pcomp").alias("a"), F.greatest("comp", "pcomp").alias("b"))
        .distinct()
    )
    second = scratch.put(components(more, scratch), "second").select(F.col("id").alias("comp"), F.col("component").alias("top"))
    return labelled.join(second, "comp", "left").select(F.col("fp").alias("id"), F.coalesce("top", "comp").alias("component"))


def classes(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:  # noqa: A002
    """Per row: the id, fingerprint (16 hex digits) and component_id, the least id reachable by links."""
    scratch = Scratch(df.sparkSession, "simhash")
    rows = scratch.put(fingerprints(df, text, (id,), shingle).withColumnRenamed("f0", "fp"), "rows")
    ids = scratch.put(rows.groupBy("fp").agg(F.min("k0").alias("least")), "ids")
    comps = links(ids.select("fp"), scratch, radius)
    labelled = ids.join(comps.withColumnRenamed("id", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    top = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.put(labelled.join(top, "component").select("fp", "component_id"), "named")
    out = rows.join(named, "fp").select(
        F.col("k0").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
    return scratch.keep(out)


# ---- similarity of 0.8 and more: fingerprints of several words give candidates, the whole sets decide


#: Pairs link from this Jaccard similarity of their distinct shingles on, as a fraction.
SIMILARITY = (4, 5)
#: The part of the pairs exactly at the similarity that meet in some table; pairs above it meet more often.
RECALL = 0.997
#: A segment has so many bits less than a number of the table's rows: the rows of a key do not grow with the table.
SPARE_BITS = 5
#: Deviations of the distance, beyond its mean at the similarity, up to which a pair is a candidate.
DEVIATIONS = 3.5
#: Words that the fingerprints of crowds have besides: there, many pairs are a little under the similarity.
CROWD_WORDS = 16
#: Least hashes of a set, and how many sets one of them has to have in common to make them a crowd.
LEAST_HASHES, STAR_ROWS = 3, 64
#: Crowds, and sets to be looked up, are broadcast up to so many rows; more meet in a shuffle.
BROADCAST_ROWS = 500_000


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 hashes of a whole text's word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line = b" ".join(words)
    ends = [x + i for i, x in enumerate(accumulate(map(len, words)))]
    starts = [0, *(x + 1 for x in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])], dtype="<u8").view(np.int64))


def _mix(x: np.ndarray, i: int) -> np.ndarray:
    """Another 64-bit hash of each hash."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def set_words(s: np.ndarray, words: int) -> list[int]:
    """The fingerprint of a shingle set, in words of 64 bits; zeros for an empty set."""
    u = s.view(np.uint64)
    return [_bits(_mix(u, i) if i else u) for i in range(words)] if len(u) else [0] * words


def set_least(s: np.ndarray) -> list[int]:
    u = s.view(np.uint64)
    return [int(_mix(u, 1000 + i).min()) for i in range(LEAST_HASHES)] if len(u) else [0] * LEAST_HASHES


class Tables:
    """Segments of the fingerprint for a number of rows: two-sided balls of radius 1 meet up to a distance of 2.

    A bit of two sets at Jaccard similarity j differs with a probability of arccos(2 j / (1 + j)) / pi; there are so
    many segments that RECALL of the pairs have one with two differing bits at the most.
    """

    def __init__(self, rows: int, similarity: tuple[int, int] = SIMILARITY):
        j = similarity[0] / similarity[1]
        p = acos(min(1.0, 2 * j / (1 + j))) / pi
        self.bits = min(32, max(8, max(rows - 1, 1).bit_length() - SPARE_BITS))
        met = sum(comb(self.bits, k) * p**k * (1 - p) ** (self.bits - k) for k in range(3))
        self.segments = ceil(log(1 - RECALL) / log(1 - met))
        self.per_word = 64 // self.bits
        self.words = max(2, -(-self.segments // self.per_word))
        self.names = [f"f{i}" for i in range(self.words)]
        n = 64 * self.words
        # in sets of a few shingles bits differ more often, as sums are often zero
        reach = lambda n: tuple(ceil(n * q + DEVIATIONS * sqrt(n * q * (1 - q))) for q in (p, 1.25 * p))
        self.radius, self.crowd_radius = reach(n), reach(64 * CROWD_WORDS)

    def segment(self, i: int, prefix: str = "f") -> Column:
        return _segment(F.col(f"{prefix}{i // self.per_word}"), i % self.per_word * self.bits, self.bits)

    def keys(self) -> Column:
        """All keys of a row: each segment's value and those one bit from it."""
        flips = [0, *(1 << b for b in range(self.bits))]
        return F.array(*[self.segment(i).bitwiseXOR(F.lit(x).cast("long")).bitwiseOR(F.lit(i << 40).cast("long")) for i in range(self.segments) for x in flips])

    def distance(self, prefix: str = "g") -> Column:
        return reduce(lambda x, y: x + y, [_distance(F.col(f"f{i}"), F.col(f"{prefix}{i}")) for i in range(self.words)])

    def near(self, distance: Column, n: Column) -> Column:
        return distance <= F.when(n < SMALL_SET, self.radius[1]).otherwise(self.radius[0])

    def near_in_crowd(self, x: Column, y: Column, n: Column) -> Column:
        """Whether the further words of two sets of a crowd are near, too; true where one is not of a crowd."""
        distance = F.aggregate(F.zip_with(x, y, _distance), F.lit(0), lambda a, b: a + b)
        return x.isNull() | y.isNull() | (distance <= F.when(n < SMALL_SET, self.crowd_radius[1]).otherwise(self.crowd_radius[0]))

    def once(self, key: Column, prefix: str = "g") -> Column:
        """Whether a key is the one by which a pair is given: of its first segment with a distance up to 2, one key."""
        place = F.lit(-1).cast("long")
        for i in reversed(range(self.segments)):
            own = self.segment(i)
            differ = own.bitwiseXOR(self.segment(i, prefix))
            lowest = differ.bitwiseAND(-differ)
            met = F.when(F.bit_count(differ) == 2, own.bitwiseXOR(lowest)).otherwise(own).bitwiseOR(F.lit(i << 40).cast("long"))
            place = F.when(F.bit_count(differ) <= 2, met).otherwise(place)
        return key == place


SMALL_SET = 32


def _sets(source: DataFrame, shingle: int) -> DataFrame:
    """From rows (uid, text): uid and the sorted shingles ``s``."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, shingle) for t in texts], pa.list_(pa.int64()))], names=["uid", "s"])

    return source.select("uid", "text").mapInArrow(run, "uid long, s array<long>")


def with_words(source: DataFrame, shingle: int, words: int) -> DataFrame:
    """From rows (k0, h, text): k0, h, the hash ``uid`` of the shingle set, its size n, its fingerprint f0, f1 ... and least hashes."""
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select("k0", "h").schema.fields]
    names = [f"f{i}" for i in range(words)]

    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = [shingle_set(t, shingle) for t in texts]
            uids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            found = np.array([set_words(s, words) for s in sets], dtype=np.uint64).view(np.int64)
            least = np.array([set_least(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(uids), pa.array([len(s) for s in sets], pa.int32()), *map(pa.array, np.ascontiguousarray(found.T)), pa.array(list(least), pa.list_(pa.int64()))],
                names=["k0", "h", "uid", "n", *names, "least"],
            )

    return source.select("k0", "h", "text").mapInArrow(run, ", ".join([*fields, "uid long, n int", *(f"{x} long" for x in names), "least array<long>"]))


def _crowd_words(sets: DataFrame) -> DataFrame:
    """From rows (uid, s): uid and CROWD_WORDS words ``x`` of the fingerprint, other than its first ones."""

    def run(batches):
        for batch in batches:
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            words = [[_bits(_mix(flat[a:b].view(np.uint64), 100 + i)) if b > a else 0 for i in range(CROWD_WORDS)] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            found = np.array(words, dtype=np.uint64).reshape(len(words), CROWD_WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.int64()))], names=["uid", "x"])

    return sets.select("uid", "s").mapInArrow(run, "uid long, x array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast a table whose rows were counted and are few."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def set_links(distinct: DataFrame, texts: DataFrame, tables: Tables, scratch: Scratch, shingle: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """Components (id, component) of shingle sets (uid, h, n, f0 ..., least) whose Jaccard similarity is reached; ``texts`` has h and text.

    Crowds first: of the sets that share a least hash, the one nearest to the majority of their bits is compared with
    the others, so that a large group becomes one component by one pair a row. Then the tables give every pair of
    rows of different components once, by a key that their balls share, if the whole distance is within the radius.
    In a crowd, shingles that no other row of the crowds has are no part of any overlap; that leaves out most of
    the pairs that miss the similarity. Every link is verified on the whole sets.
    """
    p, q = similarity
    f, g = tables.names, [f"g{i}" for i in range(tables.words)]

    def sets_of(wanted: DataFrame, name: str) -> DataFrame:
        wanted = scratch.put(distinct.select("uid", "h").join(wanted.select("uid").distinct(), "uid", "left_semi"), f"{name}_wanted")
        # few wanted rows go to the texts; else copies go before the texts are shuffled
        hinted = _small(wanted)
        found = texts.join(hinted, "h") if hinted is not wanted else texts.dropDuplicates(["h"]).join(wanted, "h")
        return scratch.put(_sets(found.dropDuplicates(["h"]), shingle), f"{name}_sets")

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda c: sets.select(F.col("uid").alias(c), F.col("s").alias(f"s{c}"))
        both = F.size(F.array_intersect("sa", "sb")).cast("long")
        alike = both * (p + q) >= (F.size("sa").cast("long") + F.size("sb")) * p
        return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).drop("sa", "sb")

    mins = distinct.select("uid", "n", *f, F.explode("least").alias("key"))
    crowds = scratch.put(mins.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > STAR_ROWS), "crowds")
    crowd = scratch.put(mins.join(_small(crowds), "key"), "crowd")
    bit = lambda i: F.shiftrightunsigned(F.col(f"f{i // 64}"), i % 64).bitwiseAND(F.lit(1).cast("long"))
    counts = crowd.groupBy("key").agg(F.count("*").alias("c"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(64 * tables.words)])
    majority = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [F.when(2 * F.col(f"b{64 * w + i}") > F.col("c"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)])
    centers = scratch.put(counts.select("key", *[majority(w).alias(f"g{w}") for w in range(tables.words)]), "centers")
    nearest = crowd.join(_small(centers), "key").groupBy("key").agg(F.min(F.struct(tables.distance().alias("d"), "uid", *f)).alias("p"))
    pivots = scratch.put(nearest.select("key", F.col("p.uid").alias("b"), *[F.col(f"p.{x}").alias(y) for x, y in zip(f, g)]), "pivots")
    distance = tables.distance()
    stars = crowd.join(_small(pivots), "key").where((F.col("uid") != F.col("b")) & tables.near(distance, F.col("n")))
    stars = scratch.put(stars.groupBy("uid").agg(F.min(F.struct(distance.alias("d"), "b")).alias("p")).select(F.col("uid").alias("a"), F.col("p.b").alias("b")), "stars")
    crowded = sets_of(crowd.select("uid"), "crowd")
    first = scratch.put(components(verified(stars, crowded), scratch), "first")
    # own: shingles that no other set near a pivot has; null elsewhere
    beside = stars.select(F.col("a").alias("uid")).union(stars.select("b")).distinct()
    close = crowded.join(beside, "uid", "left_semi")
    alone = close.select("uid", F.explode("s").alias("x")).groupBy("x").agg(F.count("*").alias("c"), F.min("uid").alias("uid")).where("c = 1")
    owned = beside.join(alone.groupBy("uid").agg(F.count("*").alias("own")), "uid", "left").select("uid", F.coalesce("own", F.lit(0)).alias("own"))
    labelled = distinct.join(first.withColumnRenamed("id", "uid"), "uid", "left").join(owned, "uid", "left").join(_crowd_words(crowded), "uid", "left")
    labelled = scratch.put(labelled.select("uid", "h", F.coalesce("component", "uid").alias("comp"), "n", F.coalesce("own", F.lit(-1)).cast("int").alias("own"), "x", *f), "labelled")
    left = labelled.select(F.explode(tables.keys()).alias("key"), "uid", "comp", "n", "own", "x", *f)
    right = left.select("key", F.col("x").alias("y"), F.col("uid").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("m"), F.col("own").alias("other"), *[F.col(x).alias(y) for x, y in zip(f, g)])
    n, m, own, other = (F.col(c).cast("long") for c in ("n", "m", "own", "other"))
    sizes = F.least(n, m) * q >= F.greatest(n, m) * p
    room = (own < 0) | (other < 0) | (F.least(n - own, m - other) * (p + q) >= (n + m) * p)
    once = (F.col("uid") < F.col("b")) & tables.near(distance, F.least("n", "m")) & (F.col("comp") != F.col("cb")) & sizes & room & tables.once(F.col("key")) & tables.near_in_crowd(F.col("x"), F.col("y"), F.least("n", "m"))
    pairs = scratch.put(met(left, right, "key").where(once).select(F.col("uid").alias("a"), "b", F.col("comp").alias("ca"), "cb"), "pairs")
    needed = sets_of(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")), "pairs")
    more = verified(pairs, needed).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = scratch.put(components(more, scratch), "second")
    return labelled.join(second.select(F.col("id").alias("comp"), F.col("component").alias("top")), "comp", "left").select(F.col("uid").alias("id"), F.coalesce("top", "comp").alias("component"))


def dedup(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = 5, similarity: tuple[int, int] = SIMILARITY, without_id: bool = False) -> DataFrame:  # noqa: A002
    """One row of each class of copies and near copies (a Jaccard similarity of 0.8 and more of the distinct shingles), that of the least id.

    Fingerprints of the shingle sets give the candidates by multi-index hashing, as many bits and segments as the
    table's number of rows asks for; every link is verified on the whole sets. Shingles take five words unless told
    otherwise. Rows are told apart by id and text. Rows without an id are left out unless ``without_id``; then they
    are taken where their class has no other. Texts without words are copies of each other.
    """
    scratch = Scratch(df.sparkSession, "dedup")
    if not without_id:
        df = df.where(F.col(f"`{id}`").isNotNull())
    words = F.col(f"`{text}`").cast("string")
    source = df.select(F.col(f"`{id}`").alias("k0"), F.xxhash64(words).alias("h"), words.alias("text"))
    tables = Tables(df.count(), similarity)
    rows = scratch.put(with_words(source, shingle, tables.words), "rows")
    plain = [F.first(c).alias(c) for c in ("n", *tables.names)]
    least = [F.first(F.get("least", F.lit(i))).alias(f"l{i}") for i in range(LEAST_HASHES)]
    distinct = rows.groupBy("uid").agg(F.min("h").alias("h"), *plain, *least)
    distinct = scratch.put(distinct.select("uid", "h", "n", *tables.names, F.array(*[f"l{i}" for i in range(LEAST_HASHES)]).alias("least")), "distinct")
    comps = set_links(distinct, source.select("h", "text"), tables, scratch, shingle, similarity)
    named = rows.select("uid", F.struct(F.col("k0").isNull().alias("none"), "k0", "h").alias("r")).groupBy("uid").agg(F.min("r").alias("r"))
    keep = named.join(comps.withColumnRenamed("id", "uid"), "uid").groupBy("component").agg(F.min("r").alias("r"))
    row = free_name(df, "row")
    keep = scratch.put(keep.select(F.struct(F.col("r.k0").alias("id"), F.col("r.h").alias("h")).alias(row)), "keep")
    tagged = df.withColumn(row, F.struct(F.col(f"`{id}`").alias("id"), F.xxhash64(words).alias("h")))
    out = tagged.join(keep, row, "left_semi").dropDuplicates([row])
    return scratch.keep(out.select(*[F.col(f"`{c}`") for c in df.columns]))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: fingerprints and components of all documents."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
