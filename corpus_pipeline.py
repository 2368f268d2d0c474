"""From raw documents to token ids: five stages, each written as Parquet and read by the next.

``run`` takes the table ``documents`` through STAGES. No stage drops a row but the first two, whose work it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, pieces, pii, quality, simhash
from lodestone.llm.common import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return simhash.dedup(docs, without_id=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is the new length."""
    return pii.redact(docs, n_chars="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, written in its order: every document once or more, so that the shares are the targets."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of all documents of the mix."""
    return pieces.encoded(docs, carry=("doc_id", "source"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("pii", personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", sentence_pieces),
]

#: Divergences, fingerprints and sampled pieces are not for SQL; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
