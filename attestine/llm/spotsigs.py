"""Document fingerprints by spot signatures, with DataFrame operations only.

Words are maximal runs of letters and digits in lower case. Runs of common words (ANCHORS, four languages) are
spots; a spot's signature is a hash of its last anchor and the chain of the `chain` content words that follow,
across later spots where one holds fewer. A document's fingerprint is the sorted set of its signatures; likeness of
two fingerprints is the Jaccard similarity of the sets. A text without a complete chain has one signature, of all its
words; a text without words has none, and two such fingerprints are alike (1) with each other, 0 with any other.

`similar_pairs` compares all documents: equal fingerprints are one class, classes are partitioned by set length so
that only sets whose lengths allow the threshold meet, and only through their rarest signatures, before the exact
likeness is taken.

Defined cases: null text counts as empty; equal texts have equal fingerprints; repeated doc_ids follow one another
in the order of their texts; a null doc_id comes before all others; extra columns are ignored; an empty table gives
no rows; a single document is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: the common words that anchor signatures, in English, German, French and Spanish
ANCHORS = (
    "a an and are as at be by for from he in is it not of on or that the this to was with "
    "das dem den der des die ein eine im ist mit nicht sich und von zu "
    "au dans du elle en est et la le les ne pas pour que qui sur un une "
    "al como con de del el las los no para por se su una y"
).split()
BUCKET_ROWS = 2000
MOST_BUCKETS = 65536
_LEAST = -(1 << 63)


def signatures(text: Column, chain: int = 2) -> Column:
    """Sorted distinct 32-bit signatures of a text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    # U+0001 before each anchor and U+0002 after it, which the words can't hold; a space after every other word
    marked = F.transform(F.split(plain, " "), lambda w: F.when(w.isin(*ANCHORS), F.concat(F.lit("\u0001"), w, F.lit("\u0002"))).otherwise(F.concat(w, F.lit(" "))))
    # what stands before the first anchor is no spot; of a run of anchors the last one has content after it
    spots = F.filter(F.slice(F.split(F.array_join(marked, ""), "\u0001"), 2, 1 << 30), lambda s: ~F.endswith(s, F.lit("\u0002")))

    def signature(spots: Column, spot: Column, at: Column) -> Column:
        content = F.substring_index(spot, "\u0002", -1)
        for k in range(1, chain):  # a spot has one content word at least
            content = F.concat(content, F.substring_index(F.coalesce(F.get(spots, at + k), F.lit("")), "\u0002", -1))
        links = F.substring_index(content, " ", chain)
        return F.when(F.length(links) < F.length(content), F.hash(F.substring_index(spot, "\u0002", 1), links))

    all_words = F.when(plain == "", F.array().cast("array<int>")).otherwise(F.array(F.hash(F.lit("all"), plain)))
    # the lambda's one variable keeps the split array from being evaluated for every spot
    found = F.flatten(F.transform(F.array(spots), lambda s: F.filter(F.transform(s, lambda spot, at: signature(s, spot, at)), lambda x: x.isNotNull())))
    return F.flatten(F.transform(F.array(F.array_sort(F.array_distinct(found))), lambda x: F.when(F.size(x) > 0, x).otherwise(all_words)))


def fingerprint(sigs: Column) -> Column:
    """The signature set as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; 0 without a comparison where their lengths rule out `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * F.lit(float(least))), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (id, text) with key order made explicit: each row and the text of the next one; the last is followed by the first.

    Rows are dealt into ranges of ids that start at ids found in the table; the first row of a range is also a guest at
    the end of the range before. So one exchange is enough, and no task needs more than its own range.
    """
    keyed = docs.select(id_col, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("key"))
    rows = keyed.count()
    n = max(1, min(MOST_BUCKETS, rows // BUCKET_ROWS))
    low, cuts = keyed.agg(F.min("key"), F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], max(10_000, 20 * n))).first()
    bounds = sorted({low, *(cuts or [])} if n > 1 else {low}) if rows else [0]
    n = len(bounds)
    side = max(1, int(n**0.5))
    groups = [bounds[k : k + side] for k in range(0, n, side)]
    key = F.col("key")
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    coarse = F.size(F.filter(longs([g[0] for g in groups]), lambda b: b <= key)) - 1
    fine = F.size(F.filter(F.get(F.array(*[longs(g) for g in groups]), F.col("coarse")), lambda b: b <= key)) - 1
    placed = keyed.withColumn("coarse", coarse).withColumn("bucket", F.col("coarse") * side + fine)
    starts = F.array_contains(F.get(F.array(*[longs(g) for g in groups]), F.col("coarse")), key)
    home = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    away = F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("bucket"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("seat", F.explode(F.when(starts, F.array(home, away)).otherwise(F.array(home)))).select(id_col, "text", "key", "seat.*")
    return dealt.repartition("bucket")


def fingerprints(docs: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document.
    """
    dealt = with_next(docs).withColumn("sigs", signatures(F.col("text"), chain))
    order = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    both = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sigs", F.lead("sigs").over(order)).filter("guest = 0")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = both.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.left(F.col("text"), n - quarter), F.left(F.col("next_text"), quarter)).alias("edited"))
    done = edited.withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8, chain: int = 2) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): doc_id with class_id, the least doc_id with its fingerprint; and pairs a < b of classes with their likeness.

    Lengths l lie in parts floor(log l / log(1 / threshold)); sets at the threshold are in the same part or in
    neighbouring ones. A set meets others through its prefix: its l - ceil(threshold * l) + 1 signatures that the
    fewest classes have; two sets at the threshold share one of these.
    """
    sigs = docs.select("doc_id", signatures(F.col("text"), chain).alias("sigs")).withColumn("print", F.xxhash64("sigs"))
    classes = sigs.filter(F.size("sigs") > 0).groupBy("print", "sigs").agg(F.min("doc_id").alias("class_id"))
    membership = sigs.join(classes.select("print", F.col("class_id")), "print", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    spread = classes.select("class_id", "sigs", F.size("sigs").alias("l"))
    part = F.floor(F.log(F.col("l").cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    each = spread.withColumn("part", part).select("class_id", "l", "part", F.explode("sigs").alias("sig"))
    freq = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sig"))
    prefix = each.join(freq, "sig").withColumn("rank", rank).filter(F.col("rank") <= F.col("l") - F.ceil(F.col("l") * threshold - 1e-9) + 1)
    left = prefix.select(F.col("class_id").alias("a"), F.col("l").alias("la"), "sig", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("l").alias("lb"), "sig", "part")
    near = left.join(right, ["sig", "part"]).filter((F.col("a") < F.col("b")) & (F.least("la", "lb") >= F.greatest("la", "lb") * threshold - 1e-9)).select("a", "b").distinct()
    full = near.join(spread.select(F.col("class_id").alias("a"), F.col("sigs").alias("sa")), "a").join(spread.select(F.col("class_id").alias("b"), F.col("sigs").alias("sb")), "b")
    return membership, full.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)
