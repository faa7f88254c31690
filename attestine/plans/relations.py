"""The engine's relations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestine.functions.spans import sentence_claims
from attestine.operators.gate import cite_gate


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in WORKED_ON else rows


#: Tables whose rows take much work each.
WORKED_ON = ("documents", "pages")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a table of one row group is one task, however much work each row takes."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, url, text, verdict: documents judged by their labels; without a label a source is unverified."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    judged = read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    verdict = F.when(F.col("toxic").isNull(), "UNVERIFIED").when(F.col("toxic") == 1, "BLOCKED").when(F.col("quality") == 0, "SOFT_404").otherwise("OK")
    return judged.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("doc://"), "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text"), verdict.alias("verdict"))


def ok_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the gate on the labels' side of the join, where it reaches the scan."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality")).filter("toxic = 0 AND quality <> 0")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left_semi")
    return docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("doc://"), "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text"), F.lit("OK").alias("verdict"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, item_id, claim: sentences of benchmark items."""
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sentence_claims(F.col("text"))).alias("k", "s"))
    return rows.select((F.col("item_id") * 1000 + F.col("k")).alias("claim_id"), "item_id", F.col("s.text").alias("claim"))


def search_hits(spark: SparkSession, sf_dir: str, depth: int = 20) -> DataFrame:
    """Two ranked lists of sources for each benchmark item: by shared words, and the same by address.

    question_id, question, list_id, rank, title, url, snippet.
    """
    from attestine.operators.ranking import top_sources

    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text", "source", "n_chars")
    near = top_sources(items, docs, depth).join(docs, "source_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.when(F.col("source_id") % 7 == 0, F.lit(".youtube.com/")).otherwise(F.lit(".example.co.uk/")), F.col("source_id"))
    shown = near.select(
        F.col("claim_id").alias("question_id"), "source_rank", "source_id", "n_chars", F.substring("text", 1, 40).alias("title"), url.alias("url"), F.substring("text", 41, 160).alias("snippet")
    )
    from pyspark.sql.window import Window

    per = Window.partitionBy("question_id")
    first = shown.withColumn("list_id", F.lit(0)).withColumn("rank", (F.col("source_rank") - 1).cast("long"))
    second = shown.withColumn("list_id", F.lit(1)).withColumn("rank", F.row_number().over(per.orderBy(F.desc("n_chars"), "source_id")).cast("long") - 1)
    both = first.unionByName(second).join(items.select(F.col("claim_id").alias("question_id"), F.col("claim").alias("question")), "question_id")
    return both.select("question_id", "question", "list_id", "rank", "title", "url", "snippet")


#: Parts of the generated pairs; which one a row takes is told by its number.
HEDGES = ("", "about ", "more than ", "~", "up to ", "no fewer than ")
SHIFTS = (0, 1, 7, 30)
ACTS = ("reduces pain", "does not reduce pain", "fails to reduce pain", "is unable to reduce pain", "reduced the pain of patients", "did not really reduce pain", "never treats viral disease", "reduces pain, but not fever")
MOVES = ("exports rose", "exports fell", "imports rose sharply", "exports increased output", "export fell", "exports dropped output again", "exports climbed, then fell", "the volume of exports fell slightly")
AMOUNTS = ("all studies agreed", "some studies agreed", "most of the studies agreed", "few studies agreed", "no study agreed", "several studies agreed, while few studies agreed", "most studies agreed, all of the studies agreed", "none of the other votes agreed")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, kind, claim, span: statements on orders, and spans that state the same or something else.

    kind 0: numbers, dates and references; 1: negation; 2: direction; 3: quantifiers.
    """
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_quantity").cast("int").alias("q"), F.year("l_shipdate").alias("y"), F.date_format("l_shipdate", "MMMM").alias("month"),
        F.dayofmonth("l_shipdate").alias("d"), (F.col("l_discount") * 100).cast("int").alias("p"),
    )
    rows = spread(rows)
    variant = lambda step, n: F.pmod(F.floor(F.col("fact_id") / step), F.lit(n)).cast("int")
    pick = lambda some, step: F.element_at(F.array(*[F.lit(x) for x in some]), variant(step, len(some)) + 1)
    s = lambda c: c.cast("string")
    q, y, d, p, order = F.col("q"), F.col("y"), F.col("d"), F.col("p"), F.concat(F.lit("Order "), s(F.col("fact_id")))
    claim = F.concat(order, F.lit(" shipped "), pick(HEDGES, 7), s(q), F.lit(" units in "), s(y), F.lit(", on "), "month", F.lit(" "), s(d), F.lit(", at "), s(p), F.lit("%, see table "), s(p), F.lit("."))
    day = F.when(variant(3, 2) == 0, F.concat("month", F.lit(" "), s(d))).otherwise(F.concat(s(F.pmod(d + pick(SHIFTS, 11), F.lit(28)) + 1), F.lit(" "), "month"))
    span = F.concat(
        order, F.lit(" shipped "), pick(HEDGES, 5), s(q + pick(SHIFTS, 13)), pick((" units in ", " units of ", " units, in a set of "), 17), s(y + pick(SHIFTS, 19)), F.lit(", on "), day, F.lit(", at "),
        pick(HEDGES, 23), s(p + pick(SHIFTS, 29)), pick((".0", ".4", ""), 31), pick(("%", " percent", " points"), 37), F.lit(", see "), pick(("table ", "page "), 41), s(p + pick(SHIFTS, 43)), F.lit("."),
    )
    told = lambda some, step: F.concat(order, F.lit(": "), pick(some, step), F.lit("."))
    kind = F.pmod("fact_id", F.lit(4)).cast("int")
    by_kind = lambda first, step: F.when(kind == 0, first).when(kind == 1, told(ACTS, step)).when(kind == 2, told(MOVES, step)).otherwise(told(AMOUNTS, step))
    return rows.select("fact_id", kind.alias("kind"), by_kind(claim, 4).alias("claim"), by_kind(span, 32).alias("span"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs: every claim with its three nearest sources of any verdict.

    entailed: the source holds the claim word for word; answerable: and may be cited; bucket by what is asked.
    """
    from attestine.operators.ranking import top_sources

    c, s = claims(spark, sf_dir), sources(spark, sf_dir)
    near = top_sources(c, s, 3).join(s, "source_id").join(c, "claim_id")
    entailed = F.contains("text", F.col("claim"))
    bucket = F.when(entailed & (F.col("verdict") == "OK"), "clean_entailed").when(entailed, "answerable_hard").when(F.col("matched") > 10, "near_miss_paraphrase").otherwise("clean_not_entailed")
    return near.select(
        (F.col("claim_id") * 10 + F.col("source_rank")).alias("pair_id"), "claim", F.col("url").alias("source_url"), F.col("text").alias("source_text"), "verdict", bucket.alias("bucket"),
        entailed.alias("entailed"), (entailed & (F.col("verdict") == "OK")).alias("answerable"),
    )


__all__ = ["cite_gate", "claims", "facts", "labelled", "ok_sources", "read", "search_hits", "sources", "spread"]
