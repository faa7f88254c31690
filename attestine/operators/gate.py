"""Which sources may be cited, and why the others may not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_ok(verdict: Column) -> Column:
    """Only the verdict OK may be cited; any other, an unknown one and null may not."""
    return F.coalesce(verdict == "OK", F.lit(False))


def cite_gate(rows: DataFrame) -> DataFrame:
    """The filter stands on the plain column, so that it reaches the scan."""
    return rows.filter(F.col("verdict") == "OK")


def should_escalate(verdict: Column) -> Column:
    return F.coalesce(verdict == "EMPTY_SHELL", F.lit(False))


def acquire(fetches: DataFrame, rendered: DataFrame, key: str = "url") -> DataFrame:
    """fetches (url, verdict, body, tactic) with empty shells replaced by their rendering (verdict, body), where there is one.

    `key` tells which rendering is whose. Every fetch stays one row: of several renderings of a key the least by verdict and body is taken.
    """
    found = rendered.groupBy(key).agg(F.min(F.struct("verdict", "body")).alias("_least")).select(key, F.struct("_least.verdict", "_least.body", F.lit("rendered").alias("tactic")).alias("again"))
    shells = fetches.filter(should_escalate(F.col("verdict"))).join(found, key, "left")
    tried = shells.withColumns({c: F.coalesce(F.col(f"again.{c}"), F.col(c)) for c in ("verdict", "body", "tactic")}).drop("again")
    return fetches.filter(~should_escalate(F.col("verdict"))).unionByName(tried)


def source_status(verdict: Column, extracted: Column, error: Column | None = None) -> Column:
    """fetch_error, excluded, no_content or ok."""
    status = F.when(~is_ok(verdict), "excluded").when(extracted.isNull() | (extracted == ""), "no_content").otherwise("ok")
    return status if error is None else F.when(error.isNotNull(), "fetch_error").otherwise(status)


def source_pool(candidates: DataFrame, k: int) -> DataFrame:
    """The first max(k, number of pasted urls) candidates of each question; candidates: question_id, rank, n_urls."""
    return candidates.filter(F.col("rank") < F.greatest(F.lit(k), F.coalesce("n_urls", F.lit(0))))


def location_header(headers: Column) -> Column:
    """The value of the first header named Location, however it is spelled."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == "location"), F.lit(0))["value"]


def is_sentinel(draft: Column, sentinel: str) -> Column:
    """The draft is the sentence that says nothing was found, with or without its full stop."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return bare(F.regexp_replace(bare(draft), r"\.+$", "")) == F.lit(sentinel.strip().rstrip(".").strip())
