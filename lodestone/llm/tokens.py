"""Token ids of texts in Parquet files, and selective reads of them.

The file format: one row per document in ascending id order, ``part`` (folder), id, ``n_tokens`` and ``ids`` (list
of int32, an end id after each document). Ids are dictionary encoded, or delta encoded where a dictionary would
not pay (``encoding="delta"``); row groups and pages have a set size, and the page indexes let a reader skip to the
documents asked for. Spark's own writer makes the files, so any store that Spark reaches will do and a lost
executor's part is written again.

Texts are encoded by the tokenizers library. A text is cut where the pre-tokenizer of a byte-level BPE always cuts:
before a space that a non-space follows, and between a letter and a full stop, comma or line end. So the ids of the
pieces are the ids of the text, and each piece is encoded once as long as a bounded cache holds it.

Null or empty text: the end id only. Texts of any length are encoded whole. Equal ids (repeated rows) stay in one
file, ordered by the row's tokens; null ids come first. An empty table gives an empty table. Other columns are not
written.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BATCH_BYTES, Scratch, arrow_slices, bounded_batches

END = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 2_000
PAGE_BYTES = 256 << 10
#: Bytes, about, in each of the two generations of pieces that a worker remembers, and of one piece beside its text and ids.
CACHE_BYTES, PIECE_BYTES = 12 << 20, 180
#: Bytes of text that a worker encodes at once: half a batch, and no small rest, which would cost as much.
ENCODE_CHARS = BATCH_BYTES * 33 // 64
#: Bytes of text that a file's documents have, about.
PART_BYTES = 32 << 20
#: Marks a piece that no space goes before, and the place of a cut.
JOINED, CUT = "\x01", "\x02"
#: Texts with more than one space in a row, a space before other white space or at the end, or the marks themselves, are
#: encoded in one piece (RE2, so white space is spelled out; controls that are none do no harm).
_ODD = f" (?:[\\x00-\\x20\\x7f-\\x{{9f}}]|\\p{{Z}}|\\z)|[{JOINED}{CUT}]"
#: The pre-tokenizer also cuts between letters and these, and between a stop or comma and a line's end.
_INNER = (r"(\pL)([.,\n])", r"([.,])([\n\pL])", r"(\S\n)(\pL)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Letters(dict):
    """Characters as a byte-level BPE spells them: printable Latin-1 bytes for themselves, the rest from U+0100 on."""

    def __init__(self):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def __missing__(self, point: int) -> str:
        spelled = self[point] = "".join(map(self.bytes.__getitem__, chr(point).encode()))
        return spelled


class Encoder:
    """Ids of texts, each distinct piece encoded once while the cache holds it.

    The cache has two generations of a set size: when the new one is full the old one goes, so pieces in use stay.
    """

    def __init__(self, definition: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _Letters()
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.cache_bytes = 0, cache_bytes
        pre = self.tokenizer.pre_tokenizer
        self.cut = type(pre).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not pre.add_prefix_space and pre.use_regex

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces; a word goes to the model at once, as it spells it, others to the whole tokenizer."""
        if self.size > self.cache_bytes:
            self.new, self.old, self.size = {}, self.new, 0
        new, old, tokenize, letters, raw, rest = self.new, self.old, self.model.tokenize, self.letters, self.raw, []
        found = list(map(new.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            p = pieces[i]
            x = old.get(p)
            if x is None:
                if p.isalpha():
                    word = "\u0120" + (p if p.isascii() else p.translate(letters))
                elif p[:1] == JOINED and p[1:].isalpha():
                    word = p[1:].translate(letters)
                else:
                    rest.append(i)
                    continue
                x = b"".join([raw[t.id] for t in tokenize(word)])
            found[i] = new[p] = x
        if rest:
            # pieces are distinct, so each is one of the list
            for i, x in zip(rest, self._whole([pieces[i][1:] if pieces[i][:1] == JOINED else " " + pieces[i] for i in rest])):
                found[i] = new[pieces[i]] = x
        # an id for each character at the most, a few more bytes where they are not ASCII
        self.size += PIECE_BYTES * len(missing) + 5 * sum([len(pieces[i]) for i in missing])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; a null text has none."""
        texts = texts.cast(pa.large_string())
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False) if self.cut else pc.is_valid(texts)
        odd = odd.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(JOINED, pa.large_string()), plain, pa.scalar("", pa.large_string())), " ")
        places = lists.offsets.to_numpy()
        words = lists.flatten().dictionary_encode()
        # pieces of letters only are whole; the others are cut, and the parts of all are encoded once
        letters = pc.utf8_is_alpha(words.dictionary)
        cut = words.dictionary.filter(pc.invert(letters))
        for pattern in _INNER:
            cut = pc.replace_substring_regex(cut, pattern, f"\\1{CUT}{JOINED}\\2")
        cut = pc.split_pattern(cut, CUT)
        whole = words.dictionary.filter(letters)
        parts = pa.concat_arrays([whole, cut.flatten()]).dictionary_encode()
        ids, ends = _ragged(*_joined(self._ids(parts.dictionary.to_pylist())), parts.indices.to_numpy())
        first = np.empty(len(words.dictionary), np.int64)
        count = np.ones(len(words.dictionary), np.int64)
        letters = letters.to_numpy(zero_copy_only=False)
        first[letters] = np.arange(len(whole))
        first[~letters] = len(whole) + cut.offsets.to_numpy()[:-1]
        count[~letters] = np.diff(cut.offsets.to_numpy())
        begin = ends[first]
        ids, ends = _ragged(ids, begin, (ends[first + count] - begin).astype(np.int32), words.indices.to_numpy())
        counts = np.diff(ends[places - places[0]])
        if not odd.any():
            return ids, counts
        own = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        rest = iter(self._whole(texts.filter(pa.array(odd)).to_pylist()))
        each = [np.frombuffer(next(rest), "<i4") if o else next(own) for o in odd]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def _joined(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row; where each list begins, and its length."""
    size = np.array([len(x) >> 2 for x in lists], np.int32)
    return np.frombuffer(b"".join(lists), "<i4"), np.cumsum(size, dtype=np.int32) - size, size


def _ragged(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of the codes in a row, and the place where each ends, after a 0."""
    sizes = size[codes]
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)))
    kind = np.int32 if ends[-1] < 1 << 31 else np.int64
    places = np.repeat((begin[codes] - ends[:-1]).astype(kind), sizes)
    places += np.arange(ends[-1], dtype=kind)
    return flat[places], ends


@lru_cache(2)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def encoded(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, end: int | None = END) -> DataFrame:
    """The carried columns, n_tokens and ids of each row, in the order of the rows."""
    spark = bounded_batches(df.sparkSession)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    source = df.select(*kept, F.col(f"`{text}`").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(carry))]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select(*names).schema.fields]

    def run(batches):
        encoder = _encoder(shared.value)
        for part in arrow_slices(batches, "text", ENCODE_CHARS):
            ids, sizes = encoder.encode(part.column(len(names)))
            if end is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), np.int32(end)), sizes + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(sizes, pa.int64()), lists], names=[*names, "n_tokens", "ids"])

    return source.mapInArrow(run, ", ".join([*fields, "n_tokens long, ids array<int>"])).withColumnsRenamed({f"k{i}": c for i, c in enumerate(carry)})


def _size(df: DataFrame) -> int:
    """Bytes of the texts, about: as the plan tells for files, else summed."""
    told = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 2 * told if told < 1 << 60 else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def write(df: DataFrame, path: str, text: str = "text", id: str = "doc_id", tokenizer: str | None = None, end: int | None = END,  # noqa: A002
          encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES) -> None:
    """Writes the files: range partitions of ``id`` in folders part=0, 1, ..., each sorted by it."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}: dictionary or delta")
    slim = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    ranged = slim.repartitionByRange(max(-(-_size(slim) // PART_BYTES), df.sparkSession.sparkContext.defaultParallelism), "id")
    rows = encoded(ranged.sortWithinPartitions("id", F.xxhash64("text")), "text", ("id",), tokenizer, end)
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.dictionary.page.size": 1 << 20,
        "compression": "snappy",
    }
    rows.withColumn("part", F.spark_partition_id()).write.options(**options).partitionBy("part").mode("overwrite").parquet(path)


SCHEMA = "id long, n_tokens long, ids array<int>, part int"


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The files' rows (id, n_tokens, ids, part). A filter on id or n_tokens skips row groups and pages; ids are read only if selected."""
    return spark.read.schema(SCHEMA.replace("id long", f"id {id_type}", 1)).parquet(path)


def starts(files: DataFrame) -> DataFrame:
    """Rows (part, id, n_tokens, start): the ids before each document. Reads no ids.

    Sums by part come first; only they, a row for each file, meet in one task.
    """
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("part", "id", "n_tokens", own.alias("own")).join(F.broadcast(before), "part").select("part", "id", "n_tokens", (F.col("before") + F.col("own")).alias("start"))


def digests(files: DataFrame) -> DataFrame:
    """Rows (id, n_tokens, start, ids_crc32) in file order, each part read in one go from its sorted file."""
    bounded_batches(files.sparkSession)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = col["ids"]
            offsets = lists.offsets.to_numpy()
            offsets = 4 * (offsets - offsets[0])
            raw = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([col["part"], col["id"], col["n_tokens"], pa.array(crc, pa.int64())], names=["part", "id", "n_tokens", "ids_crc32"])

    id_type = dict(files.dtypes)["id"]
    crcs = files.select("part", "id", "n_tokens", "ids").mapInArrow(run, f"part int, id {id_type}, n_tokens long, ids_crc32 long")
    own = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("id", "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        crcs.withColumn("own", own).join(F.broadcast(before), "part").select("id", "n_tokens", (F.col("before") + F.col("own")).alias("start"), "ids_crc32")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op6: writes all documents' ids, reads the files back and returns their places and checksums."""
    scratch = Scratch(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("ids"))
    found = digests(read(spark, scratch.path("ids")))
    return scratch.keep(found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"))
