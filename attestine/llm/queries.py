"""The queries opN_ over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestine.llm import compact_windows, ctw, exact_dedup, lang_ppm, license_scan, minhash_dedup, mixing, packing, spotsigs, storage, suffix_dedup

TOKENIZER = "word_bpe_49k.json"
MIX = mixing.Weights({("d0",): 2.0, ("*", "en"): 3.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 1.0})


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(documents(spark, sf_dir), width=2, percent=80)


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(documents(spark, sf_dir))


def op5_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(documents(spark, sf_dir).select("doc_id", "text"), ~lang_ppm.held_out(7, 2))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = documents(spark, sf_dir).select("doc_id", "lang", "source", mixing.word_count().alias("n_tokens"))
    counted = storage.materialize(counted, "word-counts")
    mixed = mixing.mix(counted, 1.0, MIX, domain=mixing.source_domain(), tokens=F.col("n_tokens"), max_epochs=4, seed=7)
    return mixed.select("doc_id", F.col("leaf.domain").alias("domain"), F.col("leaf.lang").alias("lang"), F.col("leaf.source").alias("source"), "epoch", "n_tokens", "leaf_budget")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op8_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    out = lang_ppm.held_out(4, 2)
    model = lang_ppm.train(docs.filter(~out))
    return lang_ppm.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


QUERIES = (
    op1_sum_of_squares_packing, op2_exact_dedup, op3_minhash_near_dedup, op4_compact_windows, op5_context_tree_scores, op6_mixing, op7_suffix_dedup, op8_ppm_language_id,
    op9_spot_signatures, op10_license_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL}
