"""Near-duplicate groups by MinHash bands, odd sketches and exact verification.

Each document's set of word shingles gets `bands * rows` MinHash samples. Bands of `rows` samples retrieve candidates;
the samples folded into a parity bitmap (an odd sketch) estimate the similarity of a candidate pair from the population
count of the XOR, precisely where similarity is high, and pairs far below the threshold go; the rest is confirmed on
full shingle sets. With 36 bands of 5, a pair at 0.8 is missed with probability (1 - 0.8^5)^36 < 1e-6; the sketch's
slack is over six standard deviations.

No bucket is ever expanded into all pairs. Equal sets are one representative from the start. Then

1. every bucket has a hub, the member that shares most buckets with others, and each member meets the hubs of its
   buckets only: once for each hub, however many buckets they share. What links there is confirmed on the texts;
2. with a hub h, |x xor y| = |(x xor h) xor (y xor h)|: members of one hub are compared by what differs from the hub,
   a few dozen shingles for an edited copy. Members that are linked with the hub are in one component and need no
   comparison; the rest (a copy with so many edits that it is only like some other copies) meets the hub's other
   members in blocks of up to BLOCK members and BLOCK_SHINGLES shingles, by classes of sizes that can reach the
   threshold. A block gives out links only, one for a member and a component at most.

So every two members of a bucket are in one component or have been compared, and no link is lost to a cap. The rows
made are those of (hub, member) and, for members not linked with their hub, one for each block of its group.

Defined cases: null or empty text, or one without words, has an empty set, is linked with nothing and is its own
component; with fewer words than a shingle the whole sequence is the one shingle; a row with a null doc_id is a
document of its own, linked with nothing, and stays; rows with one doc_id are one component, whatever their texts, so
that they stay or go together; ties and repeated rows change nothing, as sets and smallest ids decide; extra columns
pass through `deduplicate`, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestine.llm import kernels, storage
from attestine.llm.components import connected_components

BANDS, ROWS = 36, 5
SKETCH_BITS = 1024
SKETCH_SLACK = 0.3
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
SETS = "doc_id long, n_shingles long, set_hi long, set_lo long, sketch binary, bands array<long>"


def _samples(hashes: np.ndarray, begin: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples [document, count]; documents without shingles must have been left out."""
    cache = kernels.worker_cache()
    name = f"minhash{count}"
    if not hasattr(cache, name):
        setattr(cache, name, kernels.mix(np.arange(1, 2 * count + 1, dtype=np.uint64)) | np.uint64(1))
    factors = getattr(cache, name)
    high = (hashes >> np.uint64(32)) ^ (hashes << np.uint64(32))
    out = np.empty((len(begin) - 1, count), np.uint64)
    for k in range(count):
        # multiply, fold and compare the high half: the low bits of a product know only the low bits of its factor
        out[:, k] = np.minimum.reduceat((hashes * factors[k]) ^ ((high * factors[count + k]) >> np.uint64(17)), begin[:-1])
    return out


def _sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps: each (sample index, sample) flips one bit."""
    at = kernels.mix(samples + np.arange(samples.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    flips = np.bincount((np.arange(len(samples), dtype=np.int64)[:, None] * bits + at.astype(np.int64)).ravel(), minlength=len(samples) * bits)
    return np.packbits((flips & 1).astype(bool).reshape(len(samples), bits), axis=1)


def distinct_shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and the first of each."""
    hashes, begin = kernels.shingle_hashes(*kernels.word_hashes(data, offs), width)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(begin)))


def shingle_sets(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, size and 128-bit hash of the shingle set, odd sketch and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in kernels.chunks(batch.column(1)):
                hashes, begin = distinct_shingles(data, offs, width)
                size = np.diff(begin)
                some = np.flatnonzero(size)
                high, low = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                sketch: list[bytes | None] = [None] * len(size)
                keys: list[np.ndarray | None] = [None] * len(size)
                if len(some):
                    at = begin[some]
                    high[some], low[some] = np.add.reduceat(kernels.mix(hashes + np.uint64(11)), at), np.add.reduceat(kernels.mix(hashes ^ np.uint64(0x5DEECE66D)), at)
                    samples = _samples(hashes, np.append(at, len(hashes)), bands * rows)
                    folded = samples.reshape(len(some), bands, rows)
                    key = np.broadcast_to(kernels.mix(np.arange(bands, dtype=np.uint64)), (len(some), bands))
                    for r in range(rows):
                        key = kernels.mix(key * np.uint64(0x100000001B3) + folded[:, :, r])
                    for k, bitmap, row in zip(some, _sketches(samples, bits), key.view(np.int64), strict=True):
                        sketch[k], keys[k] = bitmap.tobytes(), row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], pa.array(size, pa.int64()), kernels.as_long(high), kernels.as_long(low), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_hi", "set_lo", "sketch", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SETS)


def odd_sketch_similarity(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """Jaccard estimates from rows of two packed bitmap matrices."""
    bits = a.shape[1] * 8
    odd = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * odd / bits, 1e-12))


def _close(pairs: DataFrame, sketches: DataFrame, samples: int, floor: float) -> DataFrame:
    """pairs (hub, doc_id, ...) with `close`, whether their odd sketches estimate a similarity of at least floor, and the member's sketch."""
    of_hub = sketches.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("hub_sketch"))
    both = pairs.join(sketches.select("doc_id", "sketch"), "doc_id").join(of_hub, "hub").select("hub", "doc_id", "others", "sketch", "hub_sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_bitmaps(batch.column(k)) for k in (3, 4))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(odd_sketch_similarity(a, b, samples) >= floor)], ["hub", "doc_id", "others", "sketch", "close"])

    return both.mapInArrow(run, "hub long, doc_id long, others long, sketch binary, close boolean")


def _bitmaps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _reaches(a: np.ndarray, b: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """100 * |intersection| >= percent * |union| of sets of sizes a and b, `apart` the size of their symmetric difference."""
    return 100 * (a + b - apart) >= percent * (a + b + apart)


MET = "hub long, doc_id long, size long, hub_size long, linked boolean, sketch binary, residue array<long>"


def _meet(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs (hub, doc_id, ...) with the sizes, whether they are linked by their full shingle sets and the shingles that only one of them has."""
    text = docs.select("doc_id", "text")
    both = pairs.join(text, "doc_id").join(text.select(F.col("doc_id").alias("hub"), F.col("text").alias("hub_text")), "hub").select("hub", "doc_id", "others", "sketch", "text", "hub_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for (da, oa), (db, ob) in zip(_aligned(batch, 4), _aligned(batch, 5), strict=True):
                rows = len(oa) - 1
                ha, ba = distinct_shingles(da, oa, width)
                hb, bb = distinct_shingles(db, ob, width)
                pair = np.concatenate([np.repeat(np.arange(rows), np.diff(x)) for x in (ba, bb)])
                every = np.concatenate([ha, hb])
                order = np.lexsort((every, pair))
                every, pair = every[order], pair[order]
                twice = np.zeros(len(every) + 1, bool)
                twice[1:-1] = (every[1:] == every[:-1]) & (pair[1:] == pair[:-1])
                only = ~(twice[1:] | twice[:-1])
                apart = np.bincount(pair[only], minlength=rows)
                size, hub_size = np.diff(ba), np.diff(bb)
                linked = _reaches(size, hub_size, apart, percent)
                # a hub's only member has no one else to meet
                alone = batch.column(2)[at : at + rows].to_numpy() < 2
                keep = only & ~alone[pair]
                ends = np.zeros(rows + 1, np.int32)
                np.cumsum(np.bincount(pair[keep], minlength=rows), out=ends[1:])
                residue = pa.ListArray.from_arrays(pa.array(ends), kernels.as_long(every[keep]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + rows], batch.column(1)[at : at + rows], pa.array(size, pa.int64()), pa.array(hub_size, pa.int64()), pa.array(linked), batch.column(3)[at : at + rows], residue],
                    ["hub", "doc_id", "size", "hub_size", "linked", "sketch", "residue"],
                )
                at += rows
            kernels.trim()

    return both.mapInArrow(run, MET)


def _aligned(batch: pa.RecordBatch, column: int, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        data, offs = kernels.utf8(batch.column(column)[at : at + rows])
        yield data[offs[0] : offs[-1]], offs - offs[0]


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), n)


def shared_counts(x: np.ndarray, of_x: np.ndarray, n_x: int, y: np.ndarray, of_y: np.ndarray, n_y: int, columns: int = 4096) -> np.ndarray:
    """Matrix of the numbers of values that sets of x and of y share."""
    values = np.intersect1d(x, y)
    out = np.zeros((n_x, n_y), np.float64)
    places = []
    for v, of in ((x, of_x), (y, of_y)):
        at = np.searchsorted(values, v)
        ok = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == v) if len(values) else np.zeros(len(v), bool)
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], of[ok][order]))
    for first in range(0, len(values), columns):
        both = []
        for (at, of), n in zip(places, (n_x, n_y), strict=True):
            lo, hi = np.searchsorted(at, [first, first + columns])
            dense = np.zeros((n, columns), np.float32)
            dense[of[lo:hi], at[lo:hi] - first] = 1
            both.append(dense)
        out += both[0] @ both[1].T
    return out


def _compare(percent: int, samples: int, floor: float):
    """Of one block, links (a, b) between its rows that look for partners and those of other components, by sketches first."""

    def run(block: pa.Table) -> pa.Table:
        kernels.trim()
        block = block.combine_chunks()
        seeks = block["seeks"].to_numpy(zero_copy_only=False).astype(bool)
        sides = [block.filter(pa.array(m)).combine_chunks() for m in (seeks, ~seeks)]
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not all(side.num_rows for side in sides):
            return none
        bits = [_bitmaps(side["sketch"]).view(np.uint64) for side in sides]
        limit = (1 - np.exp((floor - 1) * 4 * samples / (bits[0].shape[1] * 64))) / 2 * (bits[0].shape[1] * 64)
        odd = np.zeros((len(bits[0]), len(bits[1])), np.int64)
        for k in range(bits[0].shape[1]):
            odd += np.bitwise_count(bits[0][:, k, None] ^ bits[1][None, :, k])
        own, other = (side["component"].to_numpy() for side in sides)
        maybe = (odd <= limit) & (own[:, None] != other[None, :])
        rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
        if not len(rows):
            return none
        x, y = sides[0].take(pa.array(rows)), sides[1].take(pa.array(columns))
        (vx, of_x), (vy, of_y) = _lists(x["residue"]), _lists(y["residue"])
        nx, ny = np.bincount(of_x, minlength=len(rows)), np.bincount(of_y, minlength=len(columns))
        apart = nx[:, None] + ny[None, :] - 2 * shared_counts(vx, of_x, len(rows), vy, of_y, len(columns)).astype(np.int64)
        ok = maybe[np.ix_(rows, columns)] & _reaches(x["size"].to_numpy()[:, None], y["size"].to_numpy()[None, :], apart, percent)
        i, k = np.nonzero(ok)
        _, one = np.unique(np.stack([i, other[columns][k]], axis=1), axis=0, return_index=True)  # a second link to a component says nothing new
        ids_x, ids_y = x["doc_id"].to_numpy(), y["doc_id"].to_numpy()
        return pa.table({"a": pa.array(ids_x[i[one]]), "b": pa.array(ids_y[k[one]])})

    return run


def _hub_pairs(reps: DataFrame, percent: int) -> DataFrame:
    """hub, doc_id for each document and the hubs of its buckets, others: how many the hub has."""
    members = reps.select(F.explode("bands").alias("bucket"), "doc_id")
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = storage.materialize(members.join(several, "bucket"), "buckets")
    # who shares most buckets with others is nearest to most of them, as an original is to its copies
    order = sized.groupBy("doc_id").agg((-F.sum("n")).alias("order"))
    placed = storage.materialize(sized.drop("n").join(order, "doc_id"), "buckets")
    hubs = placed.groupBy("bucket").agg(F.min(F.struct("order", "doc_id"))["doc_id"].alias("hub"))
    met = placed.join(hubs, "bucket").filter("doc_id <> hub").select("hub", "doc_id").distinct()
    met = storage.materialize(met, "hub-pairs")
    return met.join(met.groupBy("hub").agg(F.count(F.lit(1)).alias("others")), "hub")


def _block_links(met: DataFrame, comps: DataFrame, percent: int, samples: int, floor: float) -> DataFrame:
    """Links between members of one hub that are in different components."""
    component = comps.withColumnRenamed("node", "doc_id")
    of_hub = comps.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    named = met.join(component, "doc_id", "left").join(of_hub, "hub", "left")
    named = named.withColumn("component", F.coalesce("component", "doc_id")).withColumn("hub_component", F.coalesce("hub_component", "hub"))
    mixed = named.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("hub")
    # sets whose sizes differ by a class or more apart than one can't reach the threshold
    size_class = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = named.join(mixed, "hub", "left_semi").select("hub", "doc_id", "size", "sketch", "residue", "component", (F.col("component") != F.col("hub_component")).alias("seeks"), size_class.alias("class"))
    rows = storage.materialize(rows, "open-members")
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")
    shingles = F.size("residue")
    counts = rows.groupBy("hub", "class").agg(
        blocks(F.count(F.lit(1)), F.sum(shingles)).alias("all_blocks"), blocks(F.count_if("seeks"), F.coalesce(F.sum(F.when(F.col("seeks"), shingles)), F.lit(0))).alias("seek_blocks"), F.count_if("seeks").alias("seekers")
    )
    near_classes = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    place = F.struct("hub", "of_class", "of_block", "with_class", "with_block")
    rest = ["doc_id", "size", "sketch", "residue", "component", "seeks"]
    own_all, own_seek = F.pmod(F.xxhash64("doc_id"), "all_blocks").cast("int"), F.pmod(F.xxhash64("doc_id"), "seek_blocks").cast("int")
    mine = rows.join(counts, ["hub", "class"])
    partner = counts.select("hub", F.col("class").alias("near"), F.col("all_blocks").alias("near_all"), F.col("seek_blocks").alias("near_seek"), F.col("seekers").alias("near_seekers"))
    by_class = mine.withColumn("near", near_classes).join(partner, ["hub", "near"])
    asks = by_class.filter("seeks").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("near_all") - 1)))
    asks = asks.select("hub", F.col("class").alias("of_class"), own_seek.alias("of_block"), F.col("near").alias("with_class"), F.col("k").alias("with_block"), *rest)
    meets = by_class.filter("near_seekers > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("near_seek") - 1)))
    meets = meets.withColumn("seeks", F.lit(False)).select("hub", F.col("near").alias("of_class"), F.col("k").alias("of_block"), F.col("class").alias("with_class"), own_all.alias("with_block"), *rest)
    dealt = asks.union(meets).select(place.alias("place"), *rest)
    return dealt.groupBy("place").applyInArrow(_compare(percent, samples, floor), "a long, b long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document: components of links with Jaccard >= percent / 100."""
    samples, floor = bands * rows, percent / 100 - SKETCH_SLACK
    sets = storage.materialize(shingle_sets(docs, width, bands, rows), "shingle-sets")
    # equal sets: linked, and the same to all others
    key = ["set_hi", "set_lo", "n_shingles"]
    some = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = storage.materialize(some.groupBy(*key).agg(F.min("doc_id").alias("rep")), "equal-sets")
    reps = sets.join(same.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    reps = reps.select("doc_id", "n_shingles", "sketch", "bands")
    pairs = _hub_pairs(reps, percent)
    sketches = reps.select("doc_id", "sketch")
    judged = storage.materialize(_close(pairs, sketches, samples, floor).filter("close OR others > 1"), "judged")
    named = docs.select("doc_id", "text")
    met = storage.materialize(_meet(judged, named, width, percent), "met")
    # rows of one doc_id are one document, whatever their texts
    several = some.groupBy("doc_id").agg(F.min(F.xxhash64(*key)).alias("lo"), F.max(F.xxhash64(*key)).alias("hi")).filter("lo < hi").select("doc_id")
    doubled = some.join(several, "doc_id", "left_semi").join(same, key).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = storage.materialize(met.filter("linked").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(doubled), "links")
    comps = storage.materialize(connected_components(links), "components")
    more = storage.materialize(_block_links(met, comps, percent, samples, floor), "links")
    if not more.isEmpty():
        comps = storage.materialize(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components")

    of_rep = same.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("rep_component"))
    out = sets.select("doc_id", *key).join(of_rep, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document, the smallest doc_id, of each component, and rows without a doc_id."""
    kept = near_groups(docs, width, percent).filter("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.filter("doc_id IS NULL"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
