"""Removal of repeated byte strings: bundles of windows by minimizers, then pairs of half-window fingerprints.

Every byte that a string of `length` bytes covers which also starts earlier (smaller doc_id, or earlier in the same
document) is removed. This replaces prefix doubling, whose rounds of rank pairs over positions don't fit the limits of
disk (figures are in the README); there are no growing offsets and no rounds here.

Positions are grouped first, without loss: a window of `length` bytes belongs to its least k-gram (its minimizer), and
consecutive windows with one minimizer are a bundle. Equal windows have equal minimizers at the same place. So

1. bundles are counted by minimizer; those whose minimizer is unique hold no repeated window and go;
2. bundles that are equal as a whole (the common case) are told by hash: all but the first are removed;
3. only of the first of each class of equal bundles, and only where another, different bundle has its minimizer, are
   the positions compared one by one, by a pair of 64-bit fingerprints of the window's halves, a share of the
   fingerprints after the other.

Runs of one byte and short periods would make a bundle of every window or two; there, a window that the same text holds
earlier is removed at once, and only the first of each remains.

Groups are never gathered: classes are found by partial aggregation, and their members by a join that Spark may split
where it is skewed. Bit maps of a fixed size, made from the counts of step 1, spare later steps most bundles with
unique minimizers; where the maps are full they merely spare less.

A position is one number: a document's place in the order of documents, times 2^28, and the place within the document.
doc_ids serve as the document's place where they are distinct and from 0 to 2^35 and no text has 2^28 bytes; else
documents are numbered first, each taking as many numbers as its length needs. Texts are worked on in pieces of a few
megabytes that overlap in length - 1 bytes.

Defined cases: null text is empty; texts shorter than `length` lose nothing; rows with the same doc_id come in the order
of their texts, so that of repeated rows the later ones are removed; a null doc_id comes first; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestine.llm import kernels, storage

LENGTH = 100
GRAM = 50
MAP_BITS = 27
BUNDLES_A_FILE = 1 << 15
SHARES = 4  # of the windows compared one by one, each on its own
PIECE = 1 << 16  # bytes worked on at once: arrays that stay in the processor's cache
PLACE_BITS = 28  # of a position within its document
DENSE, DENSE_RUN = 8, 16  # this many bundles in a row of so few windows: a short period


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """min of x[i : i + width] for each i where that is whole."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def pieces(column: pa.Array | pa.ChunkedArray, length: int, most: int = PIECE):
    """rows, where each begins in its text, bytes, offsets: whole texts of about `most` bytes together, longer ones in pieces that overlap in length - 1 bytes."""
    for first, last, data, offs in kernels.chunks(column, most):
        if last == first + 1 and len(data) > 2 * most:
            for begin in range(0, len(data) - length + 1, most):
                part = data[begin : begin + most + length - 1]
                yield np.array([first]), np.array([begin]), part, np.array([0, len(part)])
        else:
            yield np.arange(first, last), np.zeros(last - first, np.int64), data, offs


def bundles(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """doc, first window, number of windows, minimizer's hash of each bundle, windows that repeat within a dense stretch, prefix hashes; windows are positions in data."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.view(np.uint64), none, np.zeros(1, np.uint64)
    prefix = kernels.prefix_hash(data)
    hashes = kernels.gram_hashes(prefix, gram)
    # the high half orders k-grams, positions break ties to the left
    order = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = (_sliding_least(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # a window begins where its text goes on for `length` bytes
    whole = np.ones(len(least), bool)
    for end in offs[1:-1]:
        whole[max(end - length + 1, 0) : end] = False
    window = np.flatnonzero(whole)

    def bundled(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = least[window]
        new = np.ones(len(window), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
        first = np.flatnonzero(new)
        return first, np.diff(np.append(first, len(window)))

    first, count = bundled(window)
    again = _dense_repeats(offs, window, first, count, prefix, length)
    repeats = window[again]
    if len(again):
        keep = np.ones(len(window), bool)
        keep[again] = False
        window = window[keep]
        first, count = bundled(window)
    start = window[first]
    return np.searchsorted(offs, start, "right") - 1, start, count, hashes[least[start]], repeats, prefix


def _dense_repeats(offs: np.ndarray, window: np.ndarray, first: np.ndarray, count: np.ndarray, prefix: np.ndarray, length: int) -> np.ndarray:
    """Indices of windows in stretches of small bundles that the same text has earlier in such a stretch."""
    small = np.concatenate([[False], count <= DENSE, [False]])
    edge = np.flatnonzero(small[1:] != small[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] >= DENSE_RUN]
    if not len(edge):
        return np.zeros(0, np.int64)
    ends = np.append(first, len(window))
    at = np.concatenate([np.arange(ends[x], ends[y]) for x, y in edge])
    start = window[at]
    doc = np.searchsorted(offs, start, "right")
    # `prefix` alone would do but for clashes; the second hash is of other bytes of the window
    one = kernels.span_hash(prefix, start, start + length)
    two = kernels.span_hash(prefix, start + length // 3, start + length)
    order = np.lexsort((at, two, one, doc))
    d, o, t = doc[order], one[order], two[order]
    return at[order[1:][(d[1:] == d[:-1]) & (o[1:] == o[:-1]) & (t[1:] == t[:-1])]]


def _based(docs: DataFrame, place_bits: int) -> DataFrame:
    """doc_id, text and base, the position of a document's first byte: distinct, in the order of documents."""
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, ids, low, high, most = plain.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    if rows == ids and (rows == 0 or (low >= 0 and high < 1 << (63 - place_bits) and most < 1 << place_bits)):
        return plain.withColumn("base", F.call_function("shiftleft", F.col("doc_id").cast("long"), F.lit(place_bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a document takes as many numbers as its length needs; numbers rise within the partition
        number = 0
        for batch in batches:
            takes = (batch.column(2).to_numpy().astype(np.int64) >> place_bits) + 1
            ends = number + np.cumsum(takes)
            number = int(ends[-1]) if len(ends) else number
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends - takes), pa.array(ends), batch.column(3)], ["doc_id", "text", "number", "next", "part"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = plain.orderBy(F.asc_nulls_first("doc_id"), "text").select("doc_id", "text", F.octet_length("text").cast("long").alias("bytes"), F.spark_partition_id().cast("long").alias("part"))
    numbered = storage.materialize(ordered.mapInArrow(run, f"doc_id {kind}, text string, number long, next long, part long"), "numbered")
    # as many rows as partitions are needed to close the gaps
    counts = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.max("next").alias("n")).collect())
    begin, total = [], 0
    for part, n in counts:
        begin.append((part, total))
        total += n
    begins = F.broadcast(spark.createDataFrame(begin, "part long, begin long"))
    return numbered.join(begins, "part").select("doc_id", "text", F.call_function("shiftleft", F.col("begin") + F.col("number"), F.lit(place_bits)).alias("base"))


def _minimizer_counts(keyed: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """minimizer with n > 1 and whether its bundles differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, data, offs in pieces(batch.column(0), length, most):
                _, start, count, least, _, prefix = bundles(data, offs, length, gram)
                found.append((least, kernels.span_hash(prefix, start, start + count + length - 1)))
            least, whole = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64) for k in (0, 1))
            order = np.argsort(least)
            least, whole = least[order], whole[order].view(np.int64)
            if len(least):
                first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [kernels.as_long(least[first]), pa.array(np.diff(np.append(first, len(least)))), pa.array(np.minimum.reduceat(whole, first)), pa.array(np.maximum.reduceat(whole, first))],
                    ["m", "n", "lo", "hi"],
                )

    counted = keyed.select("text").mapInArrow(run, "m long, n long, lo long, hi long").groupBy("m").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return counted.filter("n > 1").select("m", (F.col("lo") != F.col("hi")).alias("differ"))


def _bit_maps(minimizers: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit maps over the low bits of repeated minimizers, and of those whose bundles differ; 2 ** (bits - 6) words each at most."""
    place = F.col("m").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = minimizers.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("any"), F.bit_or(F.when(F.col("differ"), bit).otherwise(F.lit(0).cast("long"))).alias("differ")).toArrow()
    out = []
    for name in ("any", "differ"):
        filled = np.zeros(1 << (bits - 6), np.int64)
        filled[words["word"].to_numpy()] = words[name].to_numpy()
        out.append(filled.view(np.uint8))
    return out[0], out[1]


def _within(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and number of consecutive windows."""
    windows = np.sort(windows)
    first = np.flatnonzero(np.append(True, windows[1:] != windows[:-1] + 1)) if len(windows) else np.zeros(0, np.int64)
    return windows[first], np.diff(np.append(first, len(windows)))


def _repeated_bundles(keyed: DataFrame, maps, bits: int, length: int, gram: int, most: int) -> DataFrame:
    """Bundles whose minimizer may be repeated, with two hashes, and whether bundles of this minimizer may differ; known: windows that the same text has earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, differ = maps.value
        for batch in batches:
            bases = batch.column(0).to_numpy()
            for rows, begin, data, offs in pieces(batch.column(1), length, most):
                doc, start, count, least, repeats, prefix = bundles(data, offs, length, gram)
                keep = np.flatnonzero(_within(some, least, bits))
                doc, start, count, least = doc[keep], start[keep], count[keep], least[keep]
                end = start + count + length - 1
                one = kernels.span_hash(prefix, start, end)
                two = kernels.span_hash(kernels.prefix_hash(data, 1), start, end, 1)
                first, again = _runs(repeats)
                of = np.concatenate([doc, np.searchsorted(offs, first, "right") - 1]).astype(np.int64)
                at = (bases[rows] + begin - offs[:-1])[of] + np.concatenate([start, first])
                known = np.arange(len(at)) >= len(start)
                none = np.zeros(len(first), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.concatenate([count, again]).astype(np.int32)), kernels.as_long(np.concatenate([one, none])), kernels.as_long(np.concatenate([two, none])), pa.array(np.append(_within(differ, least, bits), np.zeros(len(first), bool))), pa.array(known)],
                    ["at", "n", "h1", "h2", "differ", "known"],
                )

    return keyed.select("base", "text").mapInArrow(run, "at long, n int, h1 long, h2 long, differ boolean, known boolean")


def _spread(at: np.ndarray) -> np.ndarray:
    return (at ^ (at >> 19)).view(np.uint64)


def _bundle_bytes(keyed: DataFrame, maps, bits: int, length: int, gram: int, place_bits: int, most: int) -> DataFrame:
    """at, n, bytes of the bundles in the first bit map; the second holds the numbers of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, texts = maps.value
        for batch in batches:
            bases = batch.column(0).to_numpy()
            some = _within(texts, (bases >> place_bits).view(np.uint64), bits) | (pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) >> place_bits > 0)
            batch = batch.filter(pa.array(some))
            bases = bases[some]
            for rows, begin, data, offs in pieces(batch.column(1), length, most):
                doc, start, count, _, _, _ = bundles(data, offs, length, gram)
                at = (bases[rows] + begin - offs[:-1])[doc] + start
                keep = np.flatnonzero(_within(firsts, _spread(at), bits))
                start, count = start[keep], count[keep]
                size = count + length - 1
                offsets = np.zeros(len(size) + 1, np.int32)
                np.cumsum(size, out=offsets[1:])
                take = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
                text = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[take]))])
                yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(count.astype(np.int32)), text], ["at", "n", "bytes"])

    return keyed.select("base", "text").mapInArrow(run, "at long, n int, bytes binary")


def _rank_pairs(rows: DataFrame, length: int, bits: int, part: int = 0, parts: int = 1, seen=None) -> DataFrame:
    """For every window of the bundles, the ranks of its first half and of the rest at that offset; of `parts` shares by the first rank the one numbered `part`; those in the bit map `seen`, if there is one."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in kernels.chunks(batch.column(2), 1 << 19):
                count, begin = batch.column(1)[first:last].to_numpy(), batch.column(0)[first:last].to_numpy()
                row = np.repeat(np.arange(last - first), count)
                step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = offs[row] + step
                a = kernels.span_hash(kernels.prefix_hash(data), at, at + half)
                b = kernels.span_hash(kernels.prefix_hash(data, 1), at + half, at + length, 1)
                where = begin[row] + step
                if parts > 1:
                    keep = (a >> np.uint64(32)) % np.uint64(parts) == part
                    a, b, where = a[keep], b[keep], where[keep]
                if seen is not None:
                    keep = _within(seen.value, a ^ b, bits)
                    a, b, where = a[keep], b[keep], where[keep]
                yield pa.RecordBatch.from_arrays([pa.array(where), kernels.as_long(a), kernels.as_long(b)], ["at", "r1", "r2"])

    return rows.select("at", "n", "bytes").mapInArrow(run, "at long, r1 long, r2 long")


def _classes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and first of each class with members at different positions."""
    return rows.groupBy(*keys).agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, map_bits: int = MAP_BITS, place_bits: int = PLACE_BITS, most: int = PIECE) -> DataFrame:
    """base, spans: an array of (start, end) of covered bytes, not merged yet; documents without any don't appear. keyed: base, text."""
    if not 0 < gram <= length // 2:
        raise ValueError("gram must be from 1 to half the length")
    spark = keyed.sparkSession
    minimizers = storage.materialize(_minimizer_counts(keyed, length, gram, most), "minimizers")
    maps = spark.sparkContext.broadcast(_bit_maps(minimizers, map_bits))
    storage.discard(minimizers)
    some = storage.materialize(_repeated_bundles(keyed, maps, map_bits, length, gram, most), "bundles")
    maps.unpersist()
    storage.free_shuffles(spark)
    narrow = some.filter("NOT known").select("at", "n", "h1", "h2")
    later = narrow.join(_classes(narrow, ["h1", "h2"]), ["h1", "h2"]).filter("at > first").select("at", "n")
    whole = storage.materialize(later, "later-bundles")
    known = storage.materialize(some.filter("known").select("at", "n"), "known")
    storage.free_shuffles(spark)
    # a later one of equal bundles has nothing that the first hasn't; a bit map of the firsts lets few others pass, which do no harm
    alone = some.filter("differ").select("at").join(whole.select("at"), "at", "left_anti")
    alone = storage.materialize(alone, "first-bundles")
    storage.discard(some)
    marks = [F.col("at").bitwiseXOR(F.shiftright("at", 19)), F.shiftright("at", place_bits)]
    firsts = spark.sparkContext.broadcast(tuple(_bit_maps(alone.select(m.alias("m"), F.lit(False).alias("differ")), map_bits)[0] for m in marks))
    # each row becomes dozens of windows, so these files have to be small
    found = _bundle_bytes(keyed, firsts, map_bits, length, gram, place_bits, most).repartition(1 + alone.count() // BUNDLES_A_FILE)
    ambiguous = storage.materialize(found, "bundle-bytes")
    firsts.unpersist()
    storage.free_shuffles(spark)
    # equal windows have equal ranks, so that shares by rank are apart: only one share's pairs are on disk at a time
    singles = []
    for part in range(SHARES):
        classes = storage.materialize(_classes(_rank_pairs(ambiguous, length, map_bits, part, SHARES), ["r1", "r2"]), "window-classes")
        storage.free_shuffles(spark)
        either = classes.select(F.col("r1").bitwiseXOR(F.col("r2")).alias("m"), F.lit(False).alias("differ"))
        seen = spark.sparkContext.broadcast(_bit_maps(either, map_bits)[0])
        repeated = _rank_pairs(ambiguous, length, map_bits, part, SHARES, seen).join(classes, ["r1", "r2"]).filter("at > first").select("at", F.lit(1).alias("n"))
        singles.append(storage.materialize(repeated, "later-windows"))
        seen.unpersist()
        storage.discard(classes)
        storage.free_shuffles(spark)
    storage.discard(ambiguous)
    single = functools.reduce(DataFrame.union, singles)
    # of a text that takes several numbers, each has spans of its own
    longer = keyed.select("base", F.shiftright(F.octet_length("text"), place_bits).alias("more")).filter("more > 0")
    parts = longer.select("base", F.explode(F.sequence(F.lit(0), "more")).alias("k")).select("base", (F.col("base") + F.call_function("shiftleft", F.col("k").cast("long"), F.lit(place_bits))).alias("part"))
    spans = whole.union(single).union(known).withColumn("part", F.col("at").bitwiseAND(F.lit(-(1 << place_bits)))).join(parts, "part", "left").withColumn("base", F.coalesce("base", "part"))
    start = (F.col("at") - F.col("base")).cast("int")
    spans = spans.select("base", F.struct(start.alias("start"), (start + F.col("n") + (length - 1)).alias("end")).alias("span"))
    out = storage.materialize(spans.groupBy("base").agg(F.collect_list("span").alias("spans")), "spans")  # bounded by a document's length
    for table in (whole, known, alone, *singles):
        storage.discard(table)
    storage.free_shuffles(spark)
    return out


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, keep_text: bool = False, place_bits: int = PLACE_BITS, most: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep_text, kept (binary) for every row of docs."""
    keyed = _based(docs, place_bits)
    spans = repeated_spans(keyed.select("base", "text"), length, place_bits=place_bits, most=most)
    joined = keyed.join(spans, "base", "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = kernels.utf8(batch.column(1))
            out: list[tuple] = []
            for k in range(batch.num_rows):
                text = memoryview(data[offs[k] : offs[k + 1]])
                starts = batch.column(2)[k]
                if starts.is_valid and len(starts):
                    s, e = _merged(starts.values.to_numpy(), batch.column(3)[k].values.to_numpy())
                    kept = b"".join(text[a:b] for a, b in zip(np.append(0, e), np.append(s, len(text)), strict=True))
                    out.append((len(text), int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
                else:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), *([bytes(text)] if keep_text else [])))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * (4 + keep_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 1 + len(columns)])

    return joined.mapInArrow(run, fields)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
