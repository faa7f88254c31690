"""Exact deduplication against a persistent digest index, with DataFrame operations only.

The index is a table (digest, keep_id, group_size, keep_copies), bucketed and sorted by digest. A batch of documents is
aggregated to one row per digest before anything is joined, anti-joined with the index by sort-merge (the index side
needs no exchange), and what is new is appended; of digests that the index holds, a row without keep_id is appended
that adds the batch's copies to the group. `rows` gives one row per digest, summed within the buckets.

Within one batch the row with the largest doc_id of a group stays; a digest that is already in the index keeps the
document that the index names, and all new rows with it go. `exact_groups` loads a table in batches of falling
doc_id, so that the row with the largest doc_id of all stays.

Defined cases: a null text counts as empty, so that all of these are one group; a null doc_id stays only if its
group has no other; repeated rows (the same doc_id and text) form one group of which `deduplicate` keeps one row;
extra columns pass through `deduplicate`; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestine.llm import storage

HOT_SHARE = 1000  # a digest with over 1/1000 of all rows (and over HOT_ROWS) is hot: at most 1000 of these exist
HOT_ROWS = 500


def text_digest(text: str = "text") -> Column:
    """SHA-256 of the UTF-8 text in lower-case hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """A bucketed, sorted digest table in the session's warehouse."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int = 32) -> None:
        self.spark, self.buckets = spark, buckets
        self.table = table or f"digest_index_{uuid.uuid4().hex}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def rows(self) -> DataFrame:
        """digest, keep_id, group_size, keep_copies: one row per digest; needs no exchange."""
        return self.spark.table(self.table).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.max("keep_copies").alias("keep_copies"))

    def append(self, docs: DataFrame) -> None:
        """Add the digests of docs (doc_id, text) that the index doesn't hold, and the copies of those it does."""
        batch = (
            docs.select("doc_id", text_digest().alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("digest").agg(
                F.max("doc_id").alias("keep_id"),
                F.sum("copies").alias("group_size"),
                F.max(F.struct("doc_id", "copies"))["copies"].alias("keep_copies"),
            )
        )
        if self.exists():
            batch = storage.materialize(batch, "digest-batch")
            held = self.spark.table(self.table).select("digest").hint("merge")
            new = batch.join(held, "digest", "left_anti")
            id_type = dict(batch.dtypes)["keep_id"]
            more = batch.join(held, "digest", "left_semi").select("digest", F.lit(None).cast(id_type).alias("keep_id"), "group_size", F.lit(None).cast("long").alias("keep_copies"))
            new = new.select("digest", "keep_id", "group_size", "keep_copies").union(more).repartition(self.buckets, "digest")
        else:
            new = batch.repartition(self.buckets, "digest")
        new.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def label(self, docs: DataFrame) -> DataFrame:
        """Each row of docs with digest, keep_id and group_size.

        A digest with a large share of all rows would meet in one task of the sort-merge join, so these digests,
        of which there are at most HOT_SHARE by the definition of hot, are broadcast, and their rows go to
        partitions of their own choice, where they match nothing.
        """
        index = self.rows().select("digest", "keep_id", "group_size")
        total = index.agg(F.sum("group_size")).first()[0] or 0
        hot = index.filter(F.col("group_size") > max(HOT_ROWS, total // HOT_SHARE)).select("digest", F.struct("keep_id", "group_size").alias("hot"))
        named = docs.withColumn("digest", text_digest()).join(F.broadcast(hot), "digest", "left")
        key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.monotonically_increasing_id().cast("string")))
        cold = index.select(F.col("digest").alias("join_key"), F.struct("keep_id", "group_size").alias("cold"))
        joined = named.withColumn("join_key", key).join(cold.hint("merge"), "join_key", "left")
        found = F.coalesce("hot", "cold")
        return joined.withColumn("keep_id", found["keep_id"]).withColumn("group_size", found["group_size"]).drop("hot", "cold", "join_key")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Without an index, docs are loaded into one of their own in `batches` ranges of falling doc_id, each deduplicated
    against those before; it is dropped at the end.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    if own and batches > 1:
        cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(batches - 1, 0, -1)])).first()[0] or []
        above = None
        for low in [*dict.fromkeys(cuts), None]:
            upper = F.lit(True) if above is None else F.coalesce(F.col("doc_id") < above, F.lit(True))
            index.append(docs.filter(upper & (F.coalesce(F.col("doc_id") >= low, F.lit(False)) if low is not None else F.lit(True))))
            above = low
    else:
        index.append(docs)
    labelled = index.label(docs.select("doc_id", "text"))
    out = labelled.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256")
    )
    if own:
        out = storage.materialize(out, "exact-groups")
        index.drop()
    return out


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns. Without an index, one is made and dropped.

    Rows are matched with the index by digest and doc_id together, which no group of copies makes uneven.
    """
    if index is None:
        index = DigestIndex(docs.sparkSession)
        out = storage.materialize(deduplicate(docs, index), "exact-kept")
        index.drop()
        return out
    index.append(docs)
    digest, keep = "__digest", "__keep_id"
    # a null doc_id can't be a join key; -1 with the digest tells whether a group has one
    stays = index.rows().select(F.col("digest").alias(digest), F.coalesce("keep_id", F.lit(-1)).alias(keep), F.col("keep_id").isNull().alias("__null"), "keep_copies")
    keyed = docs.withColumn(digest, text_digest()).withColumn(keep, F.coalesce("doc_id", F.lit(-1))).withColumn("__null", F.col("doc_id").isNull())
    on = [digest, keep, "__null"]
    once = keyed.join(stays.drop("keep_copies"), on, "left_semi")
    repeated = stays.filter(F.col("keep_copies") > 1)
    if repeated.isEmpty():
        return once.drop(*on)
    several = keyed.join(repeated.drop("keep_copies"), on, "left_semi").dropDuplicates(on)
    return once.join(repeated.drop("keep_copies"), on, "left_anti").unionByName(several).drop(*on)
