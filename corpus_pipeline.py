"""From raw documents to packed sequences: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of its input, whatever their names. Defined cases:

* language ID drops null and empty texts, texts without a letter and texts that no learned language's model compresses;
  with no labelled rows every document goes; very long texts are scored whole;
* exact dedup keeps one row of equal texts, the one with the largest doc_id (one without an id only where no other
  has one), and one of repeated rows;
* near dedup keeps the smallest doc_id of a component, and every row without an id;
* mixing takes null languages and sources as a leaf of their own and repeats documents of scarce leaves, up to four times;
* packing gives a row for each piece of each row; rows with one doc_id are packed each on its own.

Ties go by doc_id. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestine.llm import exact_dedup, lang_ppm, minhash_dedup, mixing, packing, storage
from attestine.llm.queries import MIX, tokenizer_file

#: SQL can't express the language model, the sketches or the packing; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those with no letter go."""
    storage.free_driver(spark)
    return lang_ppm.keep_recognised(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    storage.free_driver(spark)
    return exact_dedup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity of 0.8 or more."""
    storage.free_driver(spark)
    return minhash_dedup.deduplicate(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, mixed to the target weights; a leaf gives each document up to four times."""
    storage.free_driver(spark)
    return mixing.take(docs, 1.0, MIX, domain=mixing.source_domain(), max_epochs=4, seed=7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 2048 tokens."""
    storage.free_driver(spark)
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
