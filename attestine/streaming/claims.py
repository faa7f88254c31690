"""Claims as a stream against a table of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestine.functions.tokens import squeeze


def distinct_claims(claims: DataFrame, event_time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """A stream of claims (claim, event time) without those said before within the delay; late ones go."""
    keyed = claims.withColumn("claim_key", F.sha2(squeeze(F.col("claim")).cast("binary"), 256)).withWatermark(event_time, delay)
    return keyed.dropDuplicatesWithinWatermark(["claim_key"])


def claim_counts(claims: DataFrame, event_time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Claims and distinct speakers of each window, once it is closed; claims: ts, status."""
    return claims.withWatermark(event_time, delay).groupBy(F.window(event_time, window), "status").agg(F.count(F.lit(1)).alias("n"))
