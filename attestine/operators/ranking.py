"""Ranking, fusion and diversification of candidates."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestine.functions import lexicon
from attestine.functions.tokens import content_words, let, token_set


def idf_weights(words: Column, pool: Column) -> Column:
    """ln(1 + n / (1 + df)) for each of `words`, df counted over the word sets in the array `pool`."""
    return F.transform(words, lambda w: F.log(1 + F.size(pool) / (1 + F.size(F.filter(pool, lambda s: F.array_contains(s, w))))))


def idf_scores(words: Column, pool: Column) -> Column:
    """For each set in pool the weight of the words it shares with `words`, to six decimals (sums have no fixed order)."""

    def score(weights: Column) -> Column:
        zipped = F.arrays_zip(words.alias("w"), weights.alias("x"))
        return let(zipped, lambda pairs: F.transform(pool, lambda s: F.round(F.aggregate(pairs, F.lit(0.0), lambda acc, z: acc + F.when(F.array_contains(s, z["w"]), z["x"]).otherwise(0.0)), 6)))

    return let(idf_weights(words, pool), score)


def idf_overlap(pool: DataFrame, query: str = "query_words", words: str = "words") -> DataFrame:
    """Relational form: pool (pool_id, doc_idx, query words, words) with idf_score; for pools that don't fit a row."""
    n = F.count(F.lit(1)).over(Window.partitionBy("pool_id"))
    sized = pool.withColumn("pool_size", n)
    shared = sized.select("pool_id", "doc_idx", "pool_size", F.explode(F.array_intersect(query, words)).alias("word"))
    df = F.count(F.lit(1)).over(Window.partitionBy("pool_id", "word"))
    weighed = shared.withColumn("weight", F.log(1 + F.col("pool_size") / (1 + df)))
    scores = weighed.groupBy("pool_id", "doc_idx").agg(F.round(F.sum("weight"), 6).alias("idf_score"))
    return pool.join(scores, ["pool_id", "doc_idx"], "left").withColumn("idf_score", F.coalesce("idf_score", F.lit(0.0)))


def prefilter(claim_words: Column, texts: Column, k: int = 48) -> Column:
    """Indices of the candidates worth scoring, best first: all in order if they are k or fewer, else the k best by IDF overlap."""
    places = F.sequence(F.lit(0), F.size(texts) - 1)

    def best(asked: Column, sets: Column) -> Column:
        keyed = F.zip_with(idf_scores(asked, sets), places, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
        return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["i"])

    ranked = let(claim_words, lambda asked: let(F.transform(texts, lambda t: content_words(t)), lambda sets: best(asked, sets)))
    few = (F.size(texts) <= k) | F.lit(k <= 0)
    return F.when(F.size(texts) == 0, F.array().cast("array<int>")).when(few, places).when(F.size(claim_words) == 0, F.slice(places, 1, max(k, 1))).otherwise(ranked)


def top_sources(claims: DataFrame, sources: DataFrame, k: int = 3, least: int = 4) -> DataFrame:
    """claim_id, source_id, matched, source_rank: for each claim the k sources that hold most of its words.

    The rarer half of a claim's words finds k sources; the words that these hold are a bound that the k best reach. Of
    the n - bound + `least` rarest of a claim's n words, a source that reaches the bound holds `least` or more, so
    only sources that do are counted out. Common words are joined only for claims that no source is near to. Sources
    with no word in common are left out; they can't support anything. Ties go to the smaller source_id.
    """
    # one exchange each, read by every use below
    asked = claims.select("claim_id", token_set(F.col("claim")).alias("asked")).repartition("claim_id")
    held = sources.select("source_id", token_set(F.col("text")).alias("held")).repartition("source_id")
    # words as hashes: a clash lets a candidate more pass, which is then counted by its words. Sizes of what explodes are underestimated, so Spark would broadcast these
    hashed = lambda words: F.explode(F.transform(words, lambda w: F.xxhash64(w))).alias("word")
    postings = held.select("source_id", hashed("held")).hint("merge")
    wanted = asked.select("claim_id", hashed("asked"))
    frequency = postings.join(wanted.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    per = Window.partitionBy("claim_id")
    ranked = wanted.join(frequency, "word").withColumn("place", F.row_number().over(per.orderBy("df", "word"))).withColumn("n", F.count(F.lit(1)).over(per))

    def counted(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked, "claim_id").join(held.hint("merge"), "source_id")
        return both.select("claim_id", "source_id", F.size(F.array_intersect("asked", "held")).cast("long").alias("matched"))

    shared = F.count(F.lit(1)).alias("shared")
    near = ranked.filter(F.col("place") <= F.greatest(F.lit(least), F.col("n") / 2)).join(postings, "word").groupBy("claim_id", "source_id").agg(shared)
    near = near.withColumn("r", F.row_number().over(per.orderBy(F.desc("shared"), "source_id"))).filter(F.col("r") <= k)
    bound = counted(near.select("claim_id", "source_id")).groupBy("claim_id").agg(F.when(F.count(F.lit(1)) == k, F.min("matched")).otherwise(0).alias("bound"))
    rare = ranked.join(bound, "claim_id").withColumn("taken", F.least(F.col("n"), F.col("n") - F.col("bound") + least)).filter(F.col("place") <= F.col("taken"))
    needed = F.greatest(F.col("bound") - (F.col("n") - F.col("taken")), F.lit(1))
    candidates = rare.select("claim_id", "word", needed.alias("needed")).join(postings, "word").groupBy("claim_id", "source_id", "needed").agg(shared).filter("shared >= needed").select("claim_id", "source_id")
    rank = F.row_number().over(per.orderBy(F.desc("matched"), "source_id"))
    return counted(candidates).withColumn("source_rank", rank).filter(F.col("source_rank") <= k)


def rrf_fuse(hits: DataFrame, constant: int = 60) -> DataFrame:
    """question_id, url, title, snippet, score, fused_rank from hits (question_id, list_id, rank from 0, title, url, snippet)."""
    first = F.struct("list_id", "rank")
    fused = hits.groupBy("question_id", "url").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank") + 1)), 12).alias("score"), F.min(first).alias("first"), F.min_by(F.struct("title", "snippet"), first).alias("shown")
    )
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "first")) - 1
    return fused.select("question_id", "url", "shown.title", "shown.snippet", "score", rank.alias("fused_rank"))


def relevance_rerank(results: DataFrame, rank: str, out: str = "relevance_rank") -> DataFrame:
    """results (question_id, question, title, snippet, rank) with a new rank by IDF overlap of question and result."""
    pool = results.withColumns({"pool_id": F.col("question_id"), "doc_idx": F.col(rank), "query_words": content_words(F.col("question")), "words": content_words(F.concat_ws(" ", "title", "snippet"))})
    scored = idf_overlap(pool).drop("pool_id", "doc_idx", "query_words", "words")
    order = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("idf_score"), rank)) - 1
    return scored.withColumn(out, order)


def registrable_domain(url: Column) -> Column:
    """The part of the host that one registers; the host itself where there is nothing to cut."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    is_address = host.rlike(r"^[0-9.]+$")
    return F.when((F.size(labels) < 3) | is_address, host).when(two.isin(*lexicon.TWO_PART_SUFFIXES), three).otherwise(two)


def diversify(results: DataFrame, rank: str, k: int = 6, per_domain: int = 2) -> DataFrame:
    """Platforms after all others, junk dropped, at most per_domain results of a domain, the first k: final_rank from 0."""
    domain = F.col("domain")
    kept = results.withColumn("domain", registrable_domain(F.col("url"))).filter(~domain.isin(*lexicon.DROPPED_DOMAINS))
    kept = kept.withColumn("demoted", domain.isin(*lexicon.DEMOTED_DOMAINS))
    own = F.row_number().over(Window.partitionBy("question_id", "domain").orderBy("demoted", rank))
    capped = kept.withColumn("in_domain", own).filter(F.col("in_domain") <= per_domain)
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("demoted", rank)) - 1
    return capped.withColumn("final_rank", order).filter(F.col("final_rank") < k).drop("in_domain")


def entity_phrases(question: Column) -> Column:
    """Runs of capitalised words, without leading question words and titles; numbers end a run."""
    words = F.regexp_extract_all(question, F.lit(r"[A-Za-z][A-Za-z'’.-]*|\d+"), F.lit(0))
    lead = [*lexicon.QUESTION_WORDS, *lexicon.HONORIFICS]
    joined = F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[A-Z]"), w).otherwise(F.lit("\u0001"))), " ")
    runs = F.transform(F.split(joined, "\u0001"), lambda r: F.trim(r))
    bare = F.transform(runs, lambda r: F.regexp_replace(r, r"(?i)^(?:(?:" + "|".join(lead) + r")\.?(?: |$))+", ""))
    return F.filter(bare, lambda r: r != "")


def query_variants(question: Column) -> Column:
    """The longest entity phrase, the first of equals, then the question unless it is the same but for case."""
    phrases = entity_phrases(question)
    longest = F.aggregate(phrases, F.lit(""), lambda best, p: F.when(F.length(p) > F.length(best), p).otherwise(best))
    return F.when(longest == "", F.array(question)).when(F.lower(longest) == F.lower(question), F.array(longest)).otherwise(F.array(longest, question))


def fifo_cap(rows: DataFrame, sequence: str, cap: int = 500) -> DataFrame:
    """The newest `cap` rows by sequence: a sort of cap rows in each task, not of all."""
    return rows.orderBy(F.desc(sequence)).limit(cap)


def cosine_topk(queries: DataFrame, items: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, item_id, cosine, rank: the k nearest items, ties to the smaller id; a zero vector has cosine 0 to all.

    queries (query_id, vector) are a stated set that meets all items (item_id, vector), a block of queries at a time:
    `block` vectors are broadcast, each task multiplies them with its items and gives k candidates a query and batch.
    Vectors are of one length; a null vector counts as zero.
    """
    spark = items.sparkSession
    n = queries.count()
    keyed = queries.select("query_id", "vector", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // block)))).alias("block"))
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id {dict(items.dtypes)['item_id']}, cosine double"
    found = [items.select("item_id", "vector").mapInArrow(_nearest_in(spark.sparkContext.broadcast(_block(keyed.filter(F.col("block") == b))), k), schema) for b in range(max(1, -(-n // block)))]
    scored = reduce(DataFrame.union, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of length 1, or 0 for zero vectors and nulls."""
    rows = column.to_pylist() if column.null_count else None
    if rows is not None:
        width = max((len(r) for r in rows if r is not None), default=0)
        out = np.array([r if r is not None else [0.0] * width for r in rows], np.float64).reshape(len(rows), -1)
    else:
        flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
        out = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _block(queries: DataFrame) -> tuple[pa.Array, np.ndarray]:
    table = queries.select("query_id", "vector").toArrow().combine_chunks()
    return table["query_id"].combine_chunks(), _units(table["vector"])


def _nearest_in(block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = block.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            order = np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")  # ties to the smaller id
            batch = batch.take(pa.array(order))
            cosine = np.round(asked @ _units(batch.column(1)).T, 9) + 0.0
            best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(ids)), best.shape[1])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), batch.column(0).take(pa.array(best.ravel())), pa.array(cosine[rows, best.ravel()])], ["query_id", "item_id", "cosine"])

    return run


def prune(cited: DataFrame, tau: float = 0.7) -> DataFrame:
    """The least set of spans that still supports each claim; cited: claim_id, pos, span_text, source_url, score.

    Leaving out spans one by one, lowest (score, text, url, position) first, while the rest still reaches tau, ends in
    closed form: nothing goes if no span reaches tau, else exactly the greatest stays.
    """
    every = Window.partitionBy("claim_id")
    order = F.row_number().over(every.orderBy(F.desc("score"), F.desc("span_text"), F.desc("source_url"), F.desc("pos")))
    return cited.withColumn("top", F.max("score").over(every)).withColumn("place", order).filter((F.col("top") < tau) | (F.col("place") == 1)).drop("top", "place")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
