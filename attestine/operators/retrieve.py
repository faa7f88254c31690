"""Retrieval of candidate spans by embeddings, and how well it does."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestine.functions.spans import candidate_spans
from attestine.functions.tokens import squeeze, word_tokens
from attestine.operators.gate import cite_gate
from attestine.operators.ranking import cosine_topk


def hashed_words(text: Column, dim: int = 256, digest: str = "blake2b") -> Column:
    """array<double>: counts of tokens in buckets of an 8-byte hash (blake2b, or the first half of md5), to length 1; all zeros without tokens."""
    if dim < 1:
        raise ValueError("dim must be positive")
    if digest not in ("blake2b", "md5"):
        raise ValueError("digest must be blake2b or md5")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(tokens: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def bucket(word: str) -> int:
            if word not in known:
                raw = hashlib.blake2b(word.encode(), digest_size=8).digest() if digest == "blake2b" else hashlib.md5(word.encode()).digest()[:8]
                known[word] = int.from_bytes(raw, "big") % dim
            return known[word]

        out = []
        for words in tokens:
            v = np.bincount([bucket(w) for w in words] if words is not None and len(words) else [], minlength=dim).astype(float) if words is not None and len(words) else np.zeros(dim)
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return embed(word_tokens(text))


def retrieve(claims: DataFrame, candidates: DataFrame, k: int = 5, *, ok_only: bool = True) -> DataFrame:
    """claims (claim_id, vector) with their k nearest candidates (item_id, vector, verdict); sources that may not be cited are left out first."""
    pool = cite_gate(candidates) if ok_only else candidates
    return cosine_topk(claims.withColumnRenamed("claim_id", "query_id"), pool, max(k, 0)).withColumnRenamed("query_id", "claim_id")


def retrieve_spans(claims: DataFrame, sources: DataFrame, k: int = 5, *, dim: int = 256, digest: str = "blake2b") -> DataFrame:
    """claim_id, span_text, rank: the k candidate spans of all sources that may be cited nearest to each claim (claim_id, claim) by hashed words.

    sources: source_id, text, verdict. Ties go to the smaller source_id, then to the earlier span. Vectors of spans are
    made where the texts are and never shuffled; texts are read a second time for the few spans that were chosen.
    """
    found = cite_gate(sources).select("source_id", "verdict", F.posexplode(candidate_spans(F.coalesce("text", F.lit("")))).alias("at", "span"))
    pool = found.select((F.shiftleft("source_id", 32) + F.col("at")).alias("item_id"), hashed_words(F.col("span.text"), dim, digest).alias("vector"), "verdict")
    asked = claims.select("claim_id", hashed_words(F.col("claim"), dim, digest).alias("vector"))
    top = retrieve(asked, pool, k).select("claim_id", F.shiftright("item_id", 32).alias("source_id"), F.col("item_id").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("at"), "rank")
    texts = sources.select("source_id", F.coalesce("text", F.lit("")).alias("text")).join(top, "source_id")
    return texts.select("claim_id", F.get(candidate_spans(F.col("text")), F.col("at"))["text"].alias("span_text"), F.col("rank").cast("long").alias("rank"))


def is_hit(spans: Column, gold: Column) -> Column:
    """Any span is the gold span, holds it or is held by it, but for case and white space; a blank gold span is never hit."""
    want = squeeze(gold)
    return F.when(want == "", F.lit(False)).otherwise(F.exists(spans, lambda s: F.contains(want, squeeze(s)) | F.contains(squeeze(s), want)))


def with_gold(retrieved: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """claim_id, span_text, rank: retrieved spans, headed by the gold span where they lack it, k at most."""
    if k <= 0:
        return retrieved.select("claim_id", "span_text", "rank").limit(0)
    lists = retrieved.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "span_text"))).alias("all"))
    both = gold.select("claim_id", "gold_span").join(lists, "claim_id", "left")
    spans = F.coalesce(F.transform("all", lambda x: x["span_text"]), F.array().cast("array<string>"))
    blank = F.coalesce(F.trim("gold_span"), F.lit("")) == ""
    full = F.when(blank | is_hit(spans, F.col("gold_span")), spans).otherwise(F.concat(F.array("gold_span"), spans))
    return both.select("claim_id", F.posexplode(F.slice(full, 1, k)).alias("rank", "span_text")).select("claim_id", "span_text", (F.col("rank") + 1).alias("rank"))


def hit_rate(retrieved: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: n (claims with a gold span), hits, rate."""
    spans = retrieved.groupBy("claim_id").agg(F.collect_list("span_text").alias("spans"))
    judged = gold.join(spans, "claim_id", "left").select(is_hit(F.coalesce("spans", F.array().cast("array<string>")), F.col("gold_span")).alias("hit"))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0)).alias("rate"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
