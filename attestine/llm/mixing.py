"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, lang, source). A budget of tokens goes down a tree of weights; where a branch can't supply its
share (its tokens times `max_epochs`), the rest goes to its siblings by weight, and only what a whole family can't
supply goes up to the level above. Each leaf is then taken in seeded epochs: every epoch is a permutation of the
leaf by a hash of seed, epoch and document; whole epochs are taken as long as they fit the leaf's budget, and of the
next one the prefix of documents whose tokens before them are under what is left.

Only per-leaf totals reach the driver: they are as many as leaves, and the water-filling runs on those. The prefix
of a leaf is found from sums over slices of the hash range, so that no leaf, however large, meets in one task.

Defined cases: null domain, language or source is the leaf part '' (empty); over MOST_LEAVES leaves are an error; a null or empty text has no tokens and
is taken with the epoch it falls into; the last document of a leaf may go over its budget; rows with one doc_id are taken together; a leaf
without a weight counts with weight 1; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestine.llm import storage

SLICE_ROWS = 20_000  # rows of a slice of a leaf, on average
MOST_LEAVES = 200_000  # totals that the driver fills and broadcasts; more leaves are an error, as weights by host name would make


@dataclass(frozen=True)
class Weights:
    """Weights by path: ('d0',), ('d0', 'en'), ('d0', 'en', 'src1'); missing ones are `default`. A shorter key ('*', 'en') holds for all parents."""

    by_path: Mapping[tuple[str, ...], float] = field(default_factory=dict)
    default: float = 1.0

    def of(self, path: tuple[str, ...]) -> float:
        value = self.by_path.get(path, self.by_path.get(("*", path[-1]), self.default))
        if not value >= 0:
            raise ValueError(f"weight of {path} must not be negative")
        return value


def _fill(budget: float, nodes: list[tuple[float, float]]) -> list[float]:
    """Shares of budget in proportion to weights, none over its capacity; (weight, capacity) for each node."""
    given = [0.0] * len(nodes)
    open_ = [k for k, (w, c) in enumerate(nodes) if w > 0 and c > 0]
    while open_ and budget > 1e-9:
        weight = sum(nodes[k][0] for k in open_)
        short = [k for k in open_ if nodes[k][1] <= budget * nodes[k][0] / weight]
        if not short:
            for k in open_:
                given[k] = budget * nodes[k][0] / weight
            break
        for k in short:
            given[k] = nodes[k][1]
        budget -= sum(nodes[k][1] for k in short)
        open_ = [k for k in open_ if k not in set(short)]
    return given


def budgets(supply: Mapping[tuple[str, ...], int], total: float, weights: Weights, max_epochs: float) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. A node's capacity is the sum of what its leaves can supply, so shortages settle among siblings first."""
    able: dict[tuple[str, ...], float] = {}
    for path, tokens in supply.items():
        for k in range(len(path) + 1):
            able[path[:k]] = able.get(path[:k], 0) + (tokens * max_epochs if all(weights.of(path[:j]) > 0 for j in range(1, len(path) + 1)) else 0)
    children: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for path in able:
        if path:
            children.setdefault(path[:-1], []).append(path)
    out: dict[tuple[str, ...], int] = {}

    def down(node: tuple[str, ...], budget: float) -> None:
        if node not in children:
            out[node] = int(budget + 1e-6)
            return
        own = sorted(children[node])
        for child, share in zip(own, _fill(budget, [(weights.of(c), able[c]) for c in own]), strict=True):
            down(child, share)

    if supply:
        down((), min(total, able[()]))
    return out


def word_count(text: str = "text") -> Column:
    """Tokens: maximal runs of characters other than space and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_domain(source: str = "source", domains: int = 4) -> Column:
    """A domain from the number in a source's name, for tables without one."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})", 1)
    return F.concat(F.lit("d"), (F.coalesce(F.when(number != "", number.cast("long")), F.lit(0)) % domains).cast("string"))


def mix(docs: DataFrame, total_tokens: int | float, weights: Weights, **options) -> DataFrame:
    """docs in their mixed amounts: a row for each taken document and epoch, with leaf, epoch and leaf_budget.

    total_tokens: an int is tokens; a float is a share of all there are. Options: domain and tokens (columns of docs),
    max_epochs, seed. Columns of docs that are named like the new ones are replaced.
    """
    new = ("leaf", "epoch", "leaf_budget")
    return _mixed(docs, total_tokens, weights, **options).select(*[f"_row.{c}" for c in docs.columns if c not in new], *new)


def take(docs: DataFrame, total_tokens: int | float, weights: Weights, **options) -> DataFrame:
    """The same rows with the columns of docs alone."""
    return _mixed(docs, total_tokens, weights, **options).select("_row.*")


def _mixed(docs: DataFrame, total_tokens: int | float, weights: Weights, *, domain: Column | None = None, tokens: Column | None = None, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """_row (the columns of docs), leaf, epoch, leaf_budget.

    Texts are read once to be counted. Where a leaf's last epoch ends is found on the narrow table of counts, as the
    last hash that is taken; the documents are then chosen by comparing their own hash with it, so they are neither
    shuffled nor sorted.
    """
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    leaf = F.struct(blank(domain if domain is not None else F.lit("")).alias("domain"), blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"))
    counted = storage.materialize(docs.select("doc_id", leaf.alias("leaf"), (tokens if tokens is not None else word_count()).alias("n_tokens")), "mix-counts")
    per = counted.groupBy("leaf").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).limit(MOST_LEAVES + 1).collect()  # as many rows as leaves
    if len(per) > MOST_LEAVES:
        raise ValueError(f"over {MOST_LEAVES} leaves: mix by a coarser source")
    supply = {tuple(r["leaf"]): r["tokens"] for r in per}
    if isinstance(total_tokens, float):
        total_tokens = total_tokens * sum(supply.values())
    plan = budgets(supply, total_tokens, weights, max_epochs)
    whole = {path: plan[path] // n if n else 0 for path, n in supply.items()}
    rows = [(tuple(r["leaf"]), plan[tuple(r["leaf"])], whole[tuple(r["leaf"])], plan[tuple(r["leaf"])] - whole[tuple(r["leaf"])] * r["tokens"], max(1, -(-r["n"] // SLICE_ROWS))) for r in per]
    kinds = T.StructType().add("leaf", counted.schema["leaf"].dataType).add("leaf_budget", "long").add("whole", T.IntegerType()).add("left", "long").add("slices", T.IntegerType())
    leaves = spark.createDataFrame(rows, kinds)

    def placed(rows: DataFrame) -> DataFrame:
        """Where a document stands in its leaf's last epoch."""
        return rows.join(F.broadcast(leaves), "leaf").withColumn("place", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id")))  # as many rows as leaves

    # a slice is a range of the hash, so slices in order and places within a slice are places in order
    share = F.col("place").cast("double") / F.lit(float(1 << 64)) + F.lit(0.5)
    last = placed(counted).filter("left > 0").withColumn("slice", F.least(F.floor(share * F.col("slices")).cast("int"), F.col("slices") - 1))
    sums = last.groupBy("leaf", "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("slice_before", F.coalesce(F.sum("slice_tokens").over(upto("leaf").orderBy("slice")), F.lit(0))).drop("slice_tokens")
    # documents of a hash come together, so repeated rows of a document do
    by_place = last.groupBy("leaf", "slice", "place", "left").agg(F.sum("n_tokens").alias("n_tokens"))
    running = F.col("slice_before") + F.coalesce(F.sum("n_tokens").over(upto("leaf", "slice").orderBy("place")), F.lit(0))
    begun = by_place.join(before, ["leaf", "slice"]).filter(F.col("slice_before") < F.col("left")).withColumn("before", running).filter(F.col("before") < F.col("left"))
    ends = {tuple(r["leaf"]): r["end"] for r in begun.groupBy("leaf").agg(F.max("place").alias("end")).collect()}  # as many rows as leaves
    final = spark.createDataFrame([(*r, ends.get(r[0])) for r in rows], T.StructType(list(kinds)).add("end", "long"))
    joined = docs.select(F.struct(*docs.columns).alias("_row"), leaf.alias("leaf"), "doc_id").join(F.broadcast(final), "leaf").withColumn("place", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id")))
    full = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    more = F.when(F.col("place") <= F.col("end"), F.array("whole")).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("epoch", F.explode(F.concat(full, more))).select("_row", "leaf", "epoch", "leaf_budget")
