"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and reduced to letters, with one space for each run of anything else. The n-grams of one to
three characters are hashed to buckets. Counts per language come from a bounded sample of the labelled rows; the
matrix of log probabilities is broadcast (buckets x languages floats) and whole texts are scored in numpy, n-gram
by n-gram.

Null text or a text without a letter: ``und``, score 0. Nothing to learn from: ``und`` for every row. Labels that
are null teach nothing. Equal scores: the language first in the alphabet. Texts of any length are counted whole, in
pieces that carry the last letters over. Repeated rows are predicted alike; extra columns are not looked at, and
carried columns named like results are an error.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, slices

UNKNOWN = "und"
#: Hash buckets of n-grams, a power of two.
BUCKET_BITS = 15
MAX_N = 3
#: About so many labelled rows are learned from, the ones whose keys have the lowest hashes; all rows are predicted.
MAX_TRAIN_ROWS = 40_000
#: The matrix has a column per language (a quarter of a MB of counts); more labels than this are an error, not cut off.
MAX_LANGUAGES = 200
SMOOTHING = 0.5
#: Characters whose n-grams are held at once.
PIECE_CHARS = 400_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_TABLE_SIZE = 0x34000


@lru_cache(1)
def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for what is not a letter."""
    out = np.full(_TABLE_SIZE, 32, np.uint32)
    for i in range(_TABLE_SIZE - 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, with a space after a run of them that something else follows; the number of the text of each; whether a text has a letter."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    points = np.frombuffer(b"".join(raw), "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    c = _letters()[np.minimum(points, _TABLE_SIZE - 1)]
    letter = c != 32
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])  # the first of each run of other characters
    return c[keep], owner[keep], has


def grams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, the number of the text of each, and whether a text has a letter."""
    c, owner, has = _normal(texts)
    c = c.astype(np.uint64)
    found, owners = [], []
    h = np.zeros(len(c), np.uint64)
    for n in range(1, MAX_N + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(_MULTIPLIERS[0]) + c[n - 1 :] * np.uint64(_MULTIPLIERS[1])
        same = owner[: len(h)] == owner[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(_MULTIPLIERS[2]) + np.uint64(n * _MULTIPLIERS[0] % 2**64)
        found.append((mixed >> np.uint64(64 - bits)).astype(np.int64)[same])
        owners.append(owner[: len(h)][same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), has
    return np.concatenate(found), np.concatenate(owners), has


def pieces(texts: list[str | None]):
    """Lists of (piece, number of its text, 1 or -1) of about PIECE_CHARS together, so that a text of any length fits in memory.

    A piece begins with the last letters of the one before; those are also given by themselves, to be taken off.
    """
    group, size = [], 0
    for i, t in enumerate(texts):
        lead = ""
        for at in range(0, len(t) if t else 0, PIECE_CHARS):
            piece = lead + t[at : at + PIECE_CHARS]
            group.append((piece, i, 1))
            if lead:
                group.append((lead, i, -1))
            size += len(piece)
            if at + PIECE_CHARS < len(t):
                lead = "".join(map(chr, _normal([piece])[0][-MAX_N:].tolist()))
            if size >= PIECE_CHARS:
                yield group
                group, size = [], 0
    if group:
        yield group


class Model:
    """Languages and their log probabilities: ``matrix`` is (buckets, languages), ``prior`` (languages,)."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray, bits: int = BUCKET_BITS):
        self.languages, self.bits = languages, bits
        if languages:
            p = counts + SMOOTHING
            self.matrix = np.log(p / p.sum(axis=0)).astype(np.float32)
            self.prior = np.log(rows / rows.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its posterior probability."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        has, logs = np.zeros(len(texts), bool), np.tile(self.prior, (len(texts), 1))
        for group in pieces(texts):
            at, sign = (np.array([x[k] for x in group]) for k in (1, 2))
            buckets, owner, letters = grams([t for t, *_ in group], self.bits)
            np.logical_or.at(has, at, letters)
            for k in range(len(self.languages)):
                np.add.at(logs[:, k], at, sign * np.bincount(owner, self.matrix[buckets, k], minlength=len(group)))
        best = logs.argmax(axis=1)
        weights = np.exp(logs - logs.max(axis=1, keepdims=True))
        score = np.where(has, weights.max(axis=1) / weights.sum(axis=1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], score


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAIN_ROWS, bits: int = BUCKET_BITS, key: str | None = "doc_id") -> Model:
    """A model of about ``max_rows`` labelled rows, those whose ``key`` (without one, the text) has the lowest hash; all if there are fewer.

    The driver gets languages x buckets counts, however many rows there are.
    """
    bounded_batches(labelled.sparkSession)
    mark = F.xxhash64(F.col(f"`{key or text}`").cast("string"))
    labelled = labelled.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), mark.alias("mark")).where(
        "text is not null and lang is not null"
    )
    n = labelled.count()
    if n > max_rows:
        share = int(max_rows / n * sys.maxsize * 2) - sys.maxsize
        labelled = labelled.where(F.col("mark") <= F.lit(share))
    labelled = labelled.select("text", "lang")
    known = labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages; the matrix takes no more")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch, texts in slices(batches, "text"):
            langs = batch.column(1).to_pylist()
            codes = {x: i for i, x in enumerate(sorted(set(langs)))}
            code = np.array([codes[x] for x in langs], np.int64)
            table = np.zeros((len(codes), 1 << bits), np.int64)
            for group in pieces(texts):
                at, sign = (np.array([x[k] for x in group]) for k in (1, 2))
                buckets, owner, _ = grams([t for t, *_ in group], bits)
                for s in (1, -1):
                    part = sign[owner] == s
                    table += s * np.bincount(code[at][owner[part]] << bits | buckets[part], minlength=table.size).reshape(table.shape)
            for x, i in codes.items():
                totals[x] = totals.get(x, 0) + table[i]
                rows[x] = rows.get(x, 0) + langs.count(x)
        for x, counts in totals.items():
            at = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(counts[at], rows[x]))], names=["lang", "bucket", "n"]
            )

    sums = labelled.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    languages = sorted(found["lang"].unique())
    counts, rows = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    for k, x in enumerate(languages):
        own = found[found["lang"] == x]
        at, c = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[at[at >= 0], k] = c[at >= 0]
        rows[k] = c[at < 0].sum()
    return Model(languages, counts, rows, bits)


def predict(df: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, lang_pred and score of every row; only the text is looked at."""
    if {c.lower() for c in carry} & {"lang_pred", "score"}:
        raise ValueError("a carried column is named like a result")
    shared = bounded_batches(df.sparkSession).sparkContext.broadcast(model)
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    source = df.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(carry))]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select(*names).schema.fields]

    def run(batches):
        for batch, texts in slices(batches, "text"):
            langs, score = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"]
            )

    out = source.mapInArrow(run, ", ".join([*fields, "lang_pred string, score double"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(carry)})


def held_out(id: str = "doc_id", folds: int = 5) -> Column:  # noqa: A002
    """Whether a row is never learned from: the CRC of its id's text is divisible by ``folds``."""
    return F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")) % folds == 0


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the language of every document, learned from the documents that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
