"""Snapshots by content: sinks and checked reads; labelled pairs; receipts and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIRS = "struct<pairs:array<struct<id:string,bucket:string,fold:string,claim:string,source_url:string,source_text:string,verdict:string,gold_span:string,entailed:boolean,answerable:boolean,annotator2_entailed:boolean,notes:string>>>"


def digest(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256)


def snapshots(pages: DataFrame, tool: str = "raw-fetch") -> DataFrame:
    """url, body, sha256, artifact_key, tool for pages (url, body): the key is what the content hashes to."""
    hashed = pages.withColumn("sha256", digest(F.col("body")))
    return hashed.select("url", "body", "sha256", F.concat(F.left("sha256", F.lit(16)), F.lit(".html")).alias("artifact_key"), F.lit(tool).alias("tool"))


def write_snapshots(rows: DataFrame, path: str) -> None:
    """One body for each digest, in folders by its first two digits."""
    once = rows.groupBy("sha256").agg(F.min("body").alias("body")).withColumn("part", F.left("sha256", F.lit(2)))
    once.repartition("part").write.mode("append").partitionBy("part").parquet(path)


def read_checked(artifacts: DataFrame, bodies: DataFrame, strict: bool = True) -> DataFrame:
    """artifacts (url, sha256) with body and valid; strict: a missing or changed body is an error at run time."""
    joined = artifacts.join(bodies.select("sha256", "body"), "sha256", "left").withColumn("valid", F.col("body").isNotNull() & (digest(F.col("body")) == F.col("sha256")))
    return joined.filter(F.assert_true("valid", F.lit("artifact is missing or was changed")).isNull()) if strict else joined


def parse_pairs(files: DataFrame) -> DataFrame:
    """Pairs of JSON texts {"pairs": [...]} (value), in the order of the text (seq); duplicate ids are an error at run time."""
    rows = files.select(F.posexplode(F.from_json("value", PAIRS)["pairs"]).alias("seq", "p")).select("seq", "p.*")
    same = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return rows.withColumn("_same", same).filter(F.assert_true(F.col("_same") == 1, F.lit("duplicate pair id")).isNull()).drop("_same")


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a JSON file."""
    return parse_pairs(spark.read.text(path, wholetext=True))


def receipts(rows: DataFrame, cap: int = 500) -> DataFrame:
    """receipt_id, seq, html: the newest `cap` receipts of rows (seq, url, quote, html); the id is what url and quote hash to, its last receipt counts."""
    keyed = rows.withColumn("receipt_id", F.left(F.sha2(F.concat_ws("\n", "url", "quote").cast("binary"), 256), F.lit(16)))
    last = keyed.groupBy("receipt_id").agg(F.max(F.struct("seq", "html")).alias("r")).select("receipt_id", "r.*")
    return last.orderBy(F.desc("seq")).limit(cap)


#: What a run tells while it goes on, and at its end.
EVENTS = ("progress", "draft", "result", "error")


def event_lines(events: DataFrame) -> DataFrame:
    """seq, value: one JSON line for each event (seq, type, data); a type that no client knows is an error at run time. Readers order by seq."""
    known = events.filter(F.assert_true(F.col("type").isin(*EVENTS), F.lit("unknown event type")).isNull())
    return known.select("seq", F.to_json(F.struct("type", "data")).alias("value"))
