"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text's characters (a space is the mark U+2581; one mark goes before the text) form a lattice: an edge for each
piece of the vocabulary, or byte pieces where no piece is a single character. Forward filtering sums the
probabilities of all segmentations up to each place; backward sampling then draws one from the end, with draws
that depend only on the seed, the row's key and the place in the text. Pieces have a mark only at their beginning,
so the lattice falls apart before each run of marks: each distinct part of a batch is filtered once.

The model holds merge ranks, not probabilities; a piece of rank r has a probability in proportion to 1 / (r + 2),
sharpened by ``alpha``. Literal marks are spelled in bytes, nothing is normalised, so decoding gives the text back.

Null or empty text: no ids. Texts of any length are encoded whole. Equal keys give equal draws, so repeated rows
get equal ids; null keys count as one key. Extra columns are carried if asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, slices

ALPHA = 0.8
SEED = 1
MARK = "▁"
#: Stands for a mark in the text itself; no valid text has a lone surrogate.
_LITERAL = "\ud800"
_PARTS = re.compile(f"{MARK}+[^{MARK}]*")
_CODES = 0x110000
#: Characters filtered at once.
GROUP_CHARS = 1_000_000
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    """The pieces as a trie in arrays: bounded by the model, not by the data."""

    pieces: list[str]
    byte_ids: np.ndarray  # id of each byte's piece
    first: np.ndarray  # node of each first character, or -1
    keys: np.ndarray  # sorted (node << 21 | character)
    nodes: np.ndarray  # the node each key leads to
    piece: np.ndarray  # by node: id of the piece that ends there, or -1
    score: np.ndarray  # by id: log probability
    longest: int

    @property
    def byte_score(self) -> float:
        return float(self.score.min()) - 5.0


@lru_cache(4)
def load(path: str, alpha: float = ALPHA) -> Vocabulary:
    """Reads a model file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    byte_ids = np.full(256, -1, np.int32)
    plain = []
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_ids[int(_BYTE.fullmatch(p)[1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if not re.fullmatch(f"{MARK}*[^{MARK}]*", p):
                raise ValueError(f"a mark inside the piece {p!r}; parts would not be independent")
            plain.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so decoding would not be lossless")
    score = np.full(len(pieces), -np.inf)
    rank = np.arange(len(plain)) + 2.0
    score[plain] = alpha * (-np.log(rank) - np.log((1 / rank).sum()))
    score[~np.isfinite(score)] = score[np.isfinite(score)].min()
    trie: dict[tuple[int, int], int] = {}
    ends: dict[int, int] = {}
    for i in plain:
        node = 0
        for c in pieces[i]:
            node = trie.setdefault((node, ord(c)), len(trie) + 1)
        ends[node] = i
    keys = np.array([a << 21 | c for a, c in trie], np.int64)
    nodes = np.fromiter(trie.values(), np.int32)
    order = np.argsort(keys)
    first = np.full(_CODES, -1, np.int32)
    for (a, c), node in trie.items():
        if not a:
            first[c] = node
    piece = np.full(len(trie) + 1, -1, np.int32)
    piece[list(ends)] = list(ends.values())
    return Vocabulary(pieces, byte_ids, first, keys[order], nodes[order], piece, score, max(len(pieces[i]) for i in plain))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Lattice:
    """Edges of distinct parts, sorted by the place they end at, with exact cumulative weights for drawing."""

    start: np.ndarray  # by edge: the place it starts at
    label: np.ndarray  # by edge: piece id, or -1 - character for byte pieces
    low: np.ndarray  # by place: its first edge
    before: np.ndarray  # by place: the sum of all weights of edges of earlier places
    total: np.ndarray  # by place: the sum of its edges' weights
    weight: np.ndarray  # running sums over edges
    begin: np.ndarray  # by part: its first place
    end: np.ndarray  # by part: its last place


def lattice(parts: list[str], v: Vocabulary) -> Lattice:
    """Forward filtering of all parts together. A part of n characters has n + 1 places."""
    sizes = np.array([len(p) for p in parts], np.int64)
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    offset = np.cumsum(sizes) - sizes
    part = np.repeat(np.arange(len(parts)), sizes)
    within = np.arange(len(points)) - offset[part]
    room = sizes[part] - within  # characters from here to the part's end
    place = np.arange(len(points)) + part  # of each character
    starts, lengths, labels = [], [], []
    node = v.first[points]
    single = (node >= 0) & (v.piece[np.maximum(node, 0)] >= 0)
    spelled = np.nonzero(~single)[0]
    starts.append(spelled), lengths.append(np.ones(len(spelled), np.int64)), labels.append(-1 - points[spelled])
    at = np.nonzero(node >= 0)[0]
    node = node[at]
    for length in range(1, v.longest + 1):
        found = v.piece[node]
        hit = found >= 0
        starts.append(at[hit]), lengths.append(np.full(int(hit.sum()), length)), labels.append(found[hit].astype(np.int64))
        more = room[at] > length
        at, node = at[more], node[more]
        if not len(at):
            break
        key = node.astype(np.int64) << 21 | points[at + length]
        slot = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        ok = v.keys[slot] == key
        at, node = at[ok], v.nodes[slot[ok]]
    start, length, label = np.concatenate(starts), np.concatenate(lengths), np.concatenate(labels)
    end_within = within[start] + length
    goal = place[start] + length
    order = np.lexsort((length, goal, end_within))
    start, label, goal, end_within = place[start[order]], label[order], goal[order], end_within[order]
    n_bytes = np.where(label < 0, 1, 0)
    cost = np.where(label >= 0, v.score[np.maximum(label, 0)], 0.0)
    spelled = label < 0
    if spelled.any():
        c = -1 - label[spelled]
        c = np.where(c == ord(_LITERAL), ord(MARK), c)
        n_bytes[spelled] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        cost[spelled] = n_bytes[spelled] * v.byte_score
    places = len(points) + len(parts)
    forward = np.full(places, -np.inf)
    begin = offset + np.arange(len(parts))
    forward[begin] = 0.0
    reach = np.empty(len(start))
    steps = np.searchsorted(end_within, np.arange(1, int(sizes.max(initial=0)) + 2))
    for a, b in zip(steps[:-1], steps[1:]):
        if a == b:
            continue
        value = forward[start[a:b]] + cost[a:b]
        reach[a:b] = value
        ends = goal[a:b]
        cuts = np.concatenate(([0], np.nonzero(ends[1:] != ends[:-1])[0] + 1))
        forward[ends[cuts]] = np.logaddexp.reduceat(value, cuts)
    order = np.argsort(goal, kind="stable")
    start, label, goal, reach = start[order], label[order], goal[order], reach[order]
    weight = np.rint(np.exp(reach - forward[goal]) * (1 << 31)).astype(np.int64)
    low = np.searchsorted(goal, np.arange(places + 1))
    running = np.concatenate(([0], np.cumsum(weight)))
    before = running[low[:-1]]
    return Lattice(start, label, low[:-1], before, running[low[1:]] - before, running[1:], begin, begin + sizes)


def sample(lat: Lattice, part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backward sampling of parts (by number) with a key each: labels in text order, and how many each has."""
    at, live = lat.end[part], np.arange(len(part))
    begin = lat.begin[part]
    taken, owners, steps = [], [], 0
    while len(live):
        with np.errstate(over="ignore"):
            draw = _mix(key[live] + np.uint64((steps + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(33)
        goal = lat.before[at] + ((draw.astype(np.int64) * lat.total[at]) >> 31)
        edge = np.searchsorted(lat.weight, goal, side="right")
        taken.append(lat.label[edge]), owners.append(live)
        at = lat.start[edge]
        more = at > begin[live]
        at, live = at[more], live[more]
        steps += 1
    if not taken:
        return np.zeros(0, np.int64), np.zeros(len(part), np.int64)
    owner = np.concatenate(owners)
    count = np.bincount(owner, minlength=len(part))
    last = np.cumsum(count) - 1
    out = np.empty(len(owner), np.int64)
    step = np.repeat(np.arange(len(owners)), [len(o) for o in owners])
    out[last[owner] - step] = np.concatenate(taken)
    return out, count


def _spell(labels: np.ndarray, count: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Byte pieces for the labels that are characters; the counts follow."""
    if not (labels < 0).any():
        return labels.astype(np.int32), count
    owner = np.repeat(np.arange(len(count)), count)
    width = np.ones(len(labels), np.int64)
    spelled = {c: v.byte_ids[list((MARK if c == ord(_LITERAL) else chr(c)).encode("utf-8", "surrogatepass"))] for c in set((-1 - labels[labels < 0]).tolist())}
    at = np.nonzero(labels < 0)[0]
    width[at] = [len(spelled[-1 - x]) for x in labels[at].tolist()]
    out = np.repeat(labels, width).astype(np.int32)
    first = np.cumsum(width) - width
    for i in at.tolist():
        out[first[i] : first[i] + width[i]] = spelled[-1 - int(labels[i])]
    return out, np.bincount(owner, width, minlength=len(count)).astype(np.int64)


def encode(texts: list[str | None], keys: np.ndarray, v: Vocabulary, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has. ``keys`` are unsigned longs, one a text."""
    all_ids, all_counts = [], np.zeros(len(texts), np.int64)
    with np.errstate(over="ignore"):
        seeds = _mix(np.asarray(keys, np.uint64) ^ np.uint64(seed * 0xD1B54A32D192ED03 % 2**64))
    at = 0
    while at < len(texts):
        numbers: dict[str, int] = {}
        codes, per_text, size, until = [], [], 0, at
        while until < len(texts) and (until == at or size + len(texts[until] or "") <= GROUP_CHARS):
            t = texts[until]
            parts = _PARTS.findall(MARK + (t.replace(MARK, _LITERAL) if MARK in t else t).replace(" ", MARK)) if t else []
            codes += [numbers.setdefault(p, len(numbers)) for p in parts]
            per_text.append(len(parts))
            size += len(t or "")
            until += 1
        per_text = np.array(per_text, np.int64)
        if codes:
            lat = lattice(list(numbers), v)
            ordinal = np.arange(len(codes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
            with np.errstate(over="ignore"):
                key = _mix(np.repeat(seeds[at:until], per_text) + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            ids, count = _spell(*sample(lat, np.array(codes, np.int64), key), v)
            owner = np.repeat(np.arange(until - at), per_text)
            all_ids.append(ids)
            all_counts[at:until] = np.bincount(owner, count, minlength=until - at)
        at = until
    return (np.concatenate(all_ids) if all_ids else np.zeros(0, np.int32)), all_counts


@lru_cache(4)
def _bytes(pieces: tuple[str, ...]) -> list[bytes]:
    return [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces]


def decode(ids, table: list[bytes]) -> str:
    """The text that was encoded; ``table`` has the bytes of each id."""
    return b"".join(map(table.__getitem__, ids))[1:].decode("utf-8", "surrogatepass") if len(ids) else ""


def vocabulary_bytes(v: Vocabulary) -> list[bytes]:
    return _bytes(tuple(v.pieces))


def encoded(df: DataFrame, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ("doc_id",), model: str | None = None,
            alpha: float = ALPHA, seed: int = SEED, names: tuple[str, str, str] = ("ids", "n_ids", "lossless")) -> DataFrame:
    """The carried columns, the ids of a sampled segmentation, their number, and whether they decode to the text."""
    spark: SparkSession = bounded_batches(df.sparkSession)
    shared = spark.sparkContext.broadcast(load(model or default_model(), alpha))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    source = df.select(*kept, F.xxhash64(F.col(f"`{key}`").cast("string")).alias("row_key"), F.col(f"`{text}`").cast("string").alias("text"))
    own = [f"k{i}" for i in range(len(carry))]
    fields = [f.simpleString().replace(":", " ", 1) for f in source.select(*own).schema.fields]

    def run(batches):
        v = shared.value
        table = vocabulary_bytes(v)
        for batch, texts in slices(batches, "text"):
            keys = batch.column(len(own)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ids, count = encode(texts, keys, v, seed)
            ends = np.concatenate(([0], np.cumsum(count)))
            as_list = ids.tolist()
            whole = [decode(as_list[a:b], table) == (t or "") for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), lists, pa.array(count), pa.array(whole)], names=[*own, "c_ids", "c_n", "c_ok"])

    out = source.mapInArrow(run, ", ".join([*fields, "c_ids array<int>, c_n long, c_ok boolean"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(carry)} | dict(zip(("c_ids", "c_n", "c_ok"), names)))


def decoded(df: DataFrame, ids: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """All columns and the text of the ids; null ids give a null text, no ids an empty one."""
    shared = df.sparkSession.sparkContext.broadcast(load(model or default_model()))
    schema = ", ".join([f.simpleString().replace(":", " ", 1) for f in df.schema.fields] + [f"`{out}` string"])

    def run(batches):
        table = vocabulary_bytes(shared.value)
        for batch in batches:
            texts = [None if x is None else decode(x, table) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: sampled ids of all documents, checked by decoding."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
