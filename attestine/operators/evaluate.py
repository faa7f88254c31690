"""How well a binder does on labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.functions.bounds import bound
from attestine.operators.gate import is_ok


def rate(x: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0))


def is_correct() -> Column:
    """Cited, entailed, from a source that may be cited, with a span that isn't blank."""
    return F.col("cited") & F.col("entailed") & (F.coalesce(F.trim("cited_span"), F.lit("")) != "") & is_ok(F.col("verdict"))


def check_outputs(outputs: DataFrame) -> DataFrame:
    """outputs, with an error at run time for a row that is both or neither of cited and abstained, or cites nothing."""
    whole = (F.coalesce(F.trim("cited_span"), F.lit("")) != "") & (F.coalesce(F.trim("source_url"), F.lit("")) != "")
    sound = (F.col("cited") != F.col("abstained")) & (~F.col("cited") | whole)
    return outputs.filter(F.assert_true(sound, F.lit("a row must either cite a span of a source or abstain")).isNull())


def report(outputs: DataFrame, alpha: float = 0.10, false_ok_alpha: float = 0.05) -> DataFrame:
    """A row for each bucket and one for all ('pooled'): counts, precision, recall, bounds, violations.

    Both levels come from one rollup; only its few rows meet the UDF that solves the bounds.
    """
    counted = outputs.rollup("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cited").alias("cited"), F.count_if(is_correct()).alias("correct"), F.count_if("answerable").alias("answerable"),
        F.count_if(F.col("answerable") & is_correct()).alias("answerable_correct"), F.count_if("abstained").alias("abstained"), F.count_if(F.col("cited") & ~is_ok(F.col("verdict"))).alias("violations"),
        F.grouping_id().alias("level"),
    )
    return counted.select(
        F.when(F.col("level") == 1, "pooled").otherwise(F.col("bucket")).alias("bucket"), "n", "cited", "correct", "answerable", "answerable_correct", "abstained", "violations",
        rate(F.col("correct"), F.col("cited")).alias("precision"), rate(F.col("answerable_correct"), F.col("answerable")).alias("recall"), rate(F.col("violations"), F.col("cited")).alias("false_ok_rate"),
        bound(F.col("correct"), F.col("cited"), alpha).alias("precision_lower"), bound(F.col("violations"), F.col("cited"), false_ok_alpha, upper=True).alias("false_ok_upper"),
    )


def ledger(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: cited, unverified, excluded, from claims (status) and sources (status)."""
    c = claims.agg(F.count_if(F.col("status") == "cited").alias("cited"), F.count_if(F.col("status") != "cited").alias("unverified"))
    s = sources.agg(F.count_if(F.col("status") != "ok").alias("excluded"))
    return c.join(s)  # one row each


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two boolean labels: n, observed, expected, kappa."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    m = labels.filter(x.isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("observed"), F.avg(x).alias("px"), F.avg(y).alias("py"))
    expected = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return m.select("n", "observed", expected.alias("expected"), F.try_divide(F.col("observed") - expected, 1 - expected).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa of ratings (item, category), as many for each item: n items, raters, observed, expected, kappa."""
    each = ratings.groupBy("item", "category").agg(F.count(F.lit(1)).alias("k"))
    items = each.groupBy("item").agg(F.sum("k").alias("raters"), F.sum(F.col("k") * (F.col("k") - 1)).alias("agreeing"))
    of_items = items.agg(F.count(F.lit(1)).alias("n"), F.max("raters").alias("raters"), F.avg(F.try_divide("agreeing", F.col("raters") * (F.col("raters") - 1))).alias("observed"))
    shares = each.groupBy("category").agg(F.sum("k").alias("k")).agg(F.try_divide(F.sum(F.col("k") * F.col("k")).cast("double"), F.pow(F.sum("k"), F.lit(2.0))).alias("expected"))
    return of_items.join(shares).withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))  # one row each
