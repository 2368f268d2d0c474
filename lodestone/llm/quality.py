"""Quality rules: distribution divergence from language references, with base counts of repetition.

Each document's histogram of character classes and its histogram of common words are compared with the
references of its language by Jensen-Shannon distance. The references are the sums over all documents of that
language. Documents below a minimum length are not judged by divergence.

Null or empty text: all counts 0, base_failed true. Null lang: the nearest reference of all counts. Extra
columns are carried by :func:`judge`, whatever their names; repeated rows are judged alike.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm.common import Scratch, free_name, slices

#: Common words by language, compared without case and outer punctuation.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou mais comme on nous leur sa elle cette ont deux fait tout".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también".split(),
}
WORDS = {w: i + 1 for i, w in enumerate(sorted({w for ws in COMMON_WORDS.values() for w in ws}))}
#: Classes of characters, in the order of their histogram.
CLASSES = ("lower", "upper", "letter", "digit", "space", "sentence", "bracket", "symbol", "mark", "other")
#: A document is judged by divergence from so many characters (words) on.
MIN_CHARS, MIN_WORDS = 200, 40
#: Jensen-Shannon distance (base 2, 0 to 1) of the classes above which a document is rejected; that of the words is
#: a share of the distance that a text without any common word has, and holds where so many common words are expected.
MAX_CLASS_DISTANCE, MAX_WORD_SHARE, EXPECTED_WORDS = 0.25, 0.90, 8
#: Rejected too if both distances pass these. Shorter documents than so many words stray by chance: for them, the
#: limits grow with the square root of what they lack.
BOTH_CLASS_DISTANCE, BOTH_WORD_DISTANCE, BOTH_WORDS = 0.145, 0.27, 100
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
_BASE_SCHEMA = ", ".join(f"{c} long" for c in BASE)


def _class(c: str) -> int:
    kind = unicodedata.category(c)
    if c in " \t\n\r\x0b\x0c" or kind.startswith("Z"):
        return 4
    if kind[0] == "L":
        return {"Ll": 0, "Lu": 1}.get(kind, 2)
    if kind[0] == "N":
        return 3
    if c in ".,;:!?'\"-…¿¡’“”–—":
        return 5
    if c in "()[]{}":
        return 6
    if kind[0] in "SP":
        return 7
    return 8 if kind[0] == "M" else 9


#: Planes 0 to 3 hold all letters; code points beyond count as "other".
_TABLE_SIZE = 0x34000


@lru_cache(1)
def class_table() -> np.ndarray:
    return np.array([*(_class(chr(i)) for i in range(_TABLE_SIZE - 1)), len(CLASSES) - 1], dtype=np.uint8)


#: Texts with more words than this are looked through in arrays: a tuple for each word would need a few hundred bytes.
MANY_WORDS = 50_000


def repeat_words(words: list[bytes]) -> int:
    """Words in 5-word windows that are found twice or more in the text, the first one included."""
    if len(words) > MANY_WORDS:
        return _repeat_words_in_arrays(words)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    total, until = 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            total += i + 5 - max(i, until)
            until = i + 5
    return total


def _repeat_words_in_arrays(words: list[bytes]) -> int:
    """The same by numbers of words and of windows, 5 steps of pairing neighbours."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    windows = codes
    for k in range(1, 5):
        windows = np.unique(windows[: len(codes) - k] << 32 | codes[k:], return_inverse=True)[1]
    twice = np.bincount(windows)[windows] > 1
    change = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(change, at, 1)
    np.add.at(change, at + 5, -1)
    return int(np.count_nonzero(np.cumsum(change)[:-1]))


def features(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Base counts, character-class counts, common-word counts (the first is of all other words)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = np.bincount(class_table()[np.minimum(points, _TABLE_SIZE - 1)], minlength=len(CLASSES))
    blanks = int(np.count_nonzero((points == 32) | ((points >= 9) & (points <= 13))))
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip())
        else:
            seen.add(line)
    common = np.zeros(len(WORDS) + 1, np.int64)
    common[0] = len(words)
    for w, n in Counter(words).items():
        if i := WORDS.get(w.decode("utf-8", "replace").lower().strip(".,;:!?'\"()[]*#$%&|<>-")):
            common[i] += n
            common[0] -= n
    symbols = sum(text.count(c) for c in SYMBOLS)
    return [len(words), len(text) - blanks, symbols, dup, repeat_words(words)], classes, common


def with_features(df: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``carry``, lang, the base counts and both histograms (``classes``, ``words``)."""
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)]
    source = df.select(*kept, F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    names = [f"k{i}" for i in range(len(carry))] + ["lang"]
    schema = StructType([*source.select(*names).schema.fields, *StructType.fromDDL(f"{_BASE_SCHEMA}, classes array<int>, words array<int>").fields])

    def measure(batches):
        for batch, texts in slices(batches, "text"):
            rows = [features(t) for t in texts]
            counts = np.array([r[0] for r in rows], np.int64).reshape(len(rows), len(BASE))
            lists = [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(c) for c in counts.T] + lists,
                names=[*names, *BASE, "classes", "words"],
            )

    return source.mapInArrow(measure, schema)


def references(measured: DataFrame, min_words: int = MIN_WORDS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language, the distributions of character classes and common words over all documents of it.

    Each document counts by its shares, so a very long one does not decide. The driver gets one row per
    language and histogram place: bounded by the languages, not by the documents.
    """
    kinds = {"classes": len(CLASSES), "words": len(WORDS) + 1}
    long = measured.where(F.col("lang").isNotNull() & (F.col("n_words") >= min_words))
    exploded = long.select("lang", *[F.col(c) for c in kinds])
    out = {}
    for c, n in kinds.items():
        total = F.greatest(F.lit(1), F.aggregate(c, F.lit(0), lambda x, y: x + y))
        rows = (
            exploded.select("lang", F.posexplode(c).alias("place", "n"), total.alias("total"))
            .where("n > 0")
            .groupBy("lang", "place")
            .agg(F.round(F.sum(F.col("n") / F.col("total")), 6).alias("share"))
            .collect()
        )
        for r in rows:
            out.setdefault(r["lang"], {k: np.zeros(m) for k, m in kinds.items()})[c][r["place"]] = r["share"]
    return {k: tuple(x / max(x.sum(), 1e-12) for x in v.values()) for k, v in sorted(out.items())}


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (square root of the divergence, base 2) of rows of counts from a distribution."""
    p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.sqrt(np.clip(d / 2, 0, 1))


def word_limits(words: np.ndarray, n_words, limits: dict):
    """The word distance from the reference ``words`` that documents of ``n_words`` must not pass; 1 where nothing can be said."""
    none = np.zeros((1, len(words)))
    none[0, 0] = 1
    return np.where(n_words * (1 - words[0]) >= limits["expected_words"], limits["max_word"] * distances(none, words)[0], 1.0)


def diverges(class_distance, word_distance, word_limit, n_words, limits: dict):
    """Whether distances, single or arrays, are over the limits."""
    wider = np.sqrt(np.maximum(1, limits["both_words"] / np.maximum(n_words, 1)))
    both = (class_distance > limits["both_class"] * wider) & (word_distance > limits["both_word"] * wider)
    return (class_distance > limits["max_class"]) | (word_distance > word_limit) | both


#: What callers may set, and the production values.
LIMITS = {
    "min_chars": MIN_CHARS, "min_words": MIN_WORDS, "max_class": MAX_CLASS_DISTANCE, "max_word": MAX_WORD_SHARE,
    "expected_words": EXPECTED_WORDS, "both_class": BOTH_CLASS_DISTANCE, "both_word": BOTH_WORD_DISTANCE, "both_words": BOTH_WORDS,
}


def score(measured: DataFrame, refs: dict, **limits) -> DataFrame:
    """Adds class_distance, word_distance (null where not judged), base_failed and kept; drops the histograms."""
    limits = LIMITS | limits
    names = [c for c in measured.columns if c not in ("classes", "words")]
    schema = StructType([*measured.select(*names).schema.fields, *StructType.fromDDL("class_distance double, word_distance double, base_failed boolean, kept boolean").fields])

    def judge_batches(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n_words, chars, repeats = (col[c].to_numpy(zero_copy_only=False) for c in ("n_words", "word_chars", "n_repeat_words"))
            hist = [np.stack(col[c].to_numpy(zero_copy_only=False)).astype(float) for c in ("classes", "words")]
            langs = np.array(col["lang"].to_pylist(), dtype=object)
            dist, word_limit = np.full((2, batch.num_rows), np.nan), np.ones(batch.num_rows)
            for k in range(2):
                every = np.array([distances(hist[k], r[k]) for r in refs.values()]) if refs else np.full((1, batch.num_rows), np.nan)
                dist[k] = every.min(axis=0)
                for i, lang in enumerate(refs):
                    dist[k, langs == lang] = every[i, langs == lang]
            if refs:
                # ``every`` is that of the words by now; without a known language the nearest reference counts
                own = every.argmin(axis=0)
                for i, lang in enumerate(refs):
                    own[langs == lang] = i
                word_limit = np.array([word_limits(r[1], n_words, limits) for r in refs.values()])[own, np.arange(batch.num_rows)]
            judged = (n_words >= limits["min_words"]) & (chars >= limits["min_chars"]) & bool(refs)
            failed = (n_words < 10) | (100 * repeats > 20 * n_words)
            with np.errstate(invalid="ignore"):
                kept = ~failed & ~(judged & diverges(dist[0], dist[1], word_limit, n_words, limits))
            yield pa.RecordBatch.from_arrays(
                [col[n] for n in names] + [pa.array(d, mask=~judged) for d in dist] + [pa.array(failed), pa.array(kept)],
                names=[*names, "class_distance", "word_distance", "base_failed", "kept"],
            )

    return measured.mapInArrow(judge_batches, schema)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",), **limits) -> DataFrame:
    """Measures every whole text once into the shared folder, sums the references, then judges every row.

    Returns the carried columns, lang, base counts, distances, base_failed and kept. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "quality")
    measured = scratch.put(with_features(df, text, lang, carry), "measured")
    out = score(measured, references(measured), **limits)
    return scratch.keep(out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(carry)}))


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", **limits) -> DataFrame:
    """The rows that are kept, with all their columns.

    Each text is measured once; its row is written beside the histograms, so that equal rows stay as often as they
    came and no key is needed.
    """
    scratch = Scratch(df.sparkSession, "quality")
    names = df.columns
    row = free_name(df, "row")
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    measured = scratch.put(with_features(wide, carry=(row,)), "measured", compression="zstd")
    kept = score(measured, references(measured), **limits).where("kept")
    return scratch.keep(kept.select(*[F.col("k0").getField(c).alias(c) for c in names]))


def verdict(text: str | None, lang: str | None, refs: dict, limits: dict = LIMITS) -> bool:
    """Whether one document is kept."""
    (n_words, chars, _, _, repeats), *hist = features(text)
    if n_words < 10 or 100 * repeats > 20 * n_words:
        return False
    if n_words < limits["min_words"] or chars < limits["min_chars"] or not refs:
        return True
    near = [refs[lang]] if lang in refs else list(refs.values())
    found = [[distances(h[None, :].astype(float), r[k])[0] for r in near] for k, h in enumerate(hist)]
    own = near[int(np.argmin(found[1]))]
    return not diverges(min(found[0]), min(found[1]), word_limits(own[1], n_words, limits), n_words, limits)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: base counts and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept", "class_distance", "word_distance")
