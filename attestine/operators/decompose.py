"""Drafts into atomic claims, without those that drift from what the draft says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.functions.spans import naive_sentences
from attestine.functions.symbolic import contradiction_messages
from attestine.operators.binder import Scorer, lexical_score

REPLY = "struct<claims:array<struct<atomic:string,source_sentence:string>>>"


def split_sentences(drafts: DataFrame) -> DataFrame:
    """draft_id, draft, index, text, source_sentence: each sentence is a claim of its own."""
    rows = drafts.select("draft_id", "draft", F.posexplode(naive_sentences(F.col("draft"))).alias("index", "text"))
    return rows.withColumn("source_sentence", F.col("text"))


def scripted_claims(drafts: DataFrame, script: DataFrame) -> DataFrame:
    """draft_id, draft, index, text, source_sentence: the claims that script (draft, claims: array of text) gives for a draft, else its sentences."""
    known = script.select(F.col("draft").alias("_draft"), F.col("claims").alias("_claims")).dropDuplicates(["_draft"])
    joined = drafts.select("draft_id", "draft").join(known, F.col("draft") == F.col("_draft"), "left")
    rows = joined.select("draft_id", "draft", F.posexplode(F.coalesce("_claims", naive_sentences(F.col("draft")))).alias("index", "text"))
    return rows.withColumn("source_sentence", F.col("text"))


def parse_reply(replies: DataFrame) -> DataFrame:
    """draft_id, index, text, source_sentence, malformed from JSON replies (draft_id, reply).

    Blank or misshaped claims go, the rest is numbered without gaps; a reply that is no JSON object with a list of
    claims gives one row with malformed = true and nulls.
    """
    parsed = replies.withColumn("claims", F.from_json("reply", REPLY)["claims"])
    good = F.filter("claims", lambda c: c["atomic"].isNotNull() & (F.trim(c["atomic"]) != ""))
    rows = parsed.filter(F.col("claims").isNotNull()).select("draft_id", F.posexplode(good).alias("index", "c"))
    ok = rows.select("draft_id", "index", F.trim("c.atomic").alias("text"), F.coalesce("c.source_sentence", F.lit("")).alias("source_sentence"), F.lit(False).alias("malformed"))
    bad = parsed.filter(F.col("claims").isNull()).select("draft_id", F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source_sentence"), F.lit(True).alias("malformed"))
    return ok.unionByName(bad)


def reject_minicheck(arbiter: object) -> None:
    """The model that binds claims may not also judge their faithfulness."""
    if "MiniCheck" in type(arbiter).__name__ or "MiniCheck" in getattr(arbiter, "__name__", ""):
        raise ValueError("the arbiter must differ from the model that binds")


def is_faithful(score: Column, messages: Column, tau: float = 0.7) -> Column:
    return (score >= tau) & (F.size(messages) == 0)


def filter_faithful(atomics: DataFrame, tau: float = 0.7, scorer: Scorer = lexical_score) -> DataFrame:
    """atomics (draft_id, draft, text, source_sentence, ...) with score against the draft and kept."""
    reject_minicheck(scorer)
    judged = atomics.withColumn("messages", contradiction_messages(F.col("text"), F.col("source_sentence"))).withColumn("score", scorer(F.col("text"), F.col("draft")))
    return judged.withColumn("kept", is_faithful(F.col("score"), F.col("messages"), tau)).drop("messages")


def drift_rate(judged: DataFrame, drafts: DataFrame) -> DataFrame:
    """draft_id, n_kept, n_dropped, drift_rate for every draft; 0 where there are no claims."""
    n = judged.groupBy("draft_id").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))
    all_ = drafts.select("draft_id").join(n, "draft_id", "left").fillna(0, ["n_kept", "n_dropped"])
    return all_.withColumn("drift_rate", F.coalesce(F.try_divide(F.col("n_dropped"), F.col("n_kept") + F.col("n_dropped")), F.lit(0.0)))
