"""Language-model scores by context-tree weighting over binary-decomposed bytes, and a word-count base score.

Counts. Every byte of the corpus, with its `depth` predecessors, is one gram; grams are counted in a distributed
aggregation over whole texts, with how often they stand in training rows. Shorter contexts and the 255 binary nodes
of a byte are sums of these counts. A node with a zeros and b ones has the Krichevsky-Trofimov block probability
Pe(a, b); its weighted probability is Pe at the deepest context, and (Pe + product over the longer contexts) / 2
elsewhere. With counts frozen, a bit's probability is the mixture, from the shallowest context down, of KT estimates
(a + 1/2) / (a + b + 1): each context keeps the posterior share Pe / (2 Pw) and passes the rest to the next longer
one. A byte's probability is the product over its eight bits.

The tree. No context is dropped or merged. Contexts of three bytes and more are worked out in tasks that read grams
sorted along the tree, whole subtrees of the nearest three bytes at a time (256 ** (depth - 2) grams at most, whatever
the input). What lies above is made of sums for each nearest pair of bytes and node, 2 ** 24 rows at most, which the
driver gathers and broadcasts. The result is a table of every gram's code length; grams that only unlearned rows hold
have no training count, and the mixture ends at the contexts that have one.

Scores. Frequent grams, `heavy_grams` at most, are broadcast with their code lengths; the others meet the table in a
shuffle by gram. Which way a gram takes doesn't change a score. The base score needs the count of every word of the
corpus: the `heavy_words` most frequent ones are broadcast, the rest meets the counts in a shuffle by word.

Defined cases: null or empty text has no words, one end token and log probability 0 under the tree; with no training
rows every count is 0 and every byte costs 8 bits; repeated rows are scored alike, each on its own; very long texts
are worked on in pieces that see the bytes before them; words are compared by 64-bit hashes; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.llm import kernels, storage

DEPTH = 5
HEAVY_GRAMS = 1 << 21
HEAVY_WORDS = 1 << 18
END = 0x0E4D0F0E4D0F  # stands for the end token among word hashes
_PIECE = 1 << 18
_COUNTED = 1 << 22
_RARE = 1 << 16
_BLOCK = 1 << 16
_TOP = 2  # contexts up to so many bytes are mixed by the driver


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series, eight places up."""
    y = x + 8.0
    inv = 1.0 / y
    sq = inv * inv
    series = inv * (1 / 12 - sq * (1 / 360 - sq * (1 / 1260 - sq / 1680)))
    up = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(up)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def path_grams(data: np.ndarray, offs: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """For each place in lo..hi its byte (lowest) and the `depth` bytes before it, the nearest one highest; line ends stand before a text."""
    first, last = np.searchsorted(offs, [lo, hi - 1], "right") - 1
    begins = offs[first : last + 2]
    since = np.arange(lo, hi) - np.repeat(begins[:-1], np.diff(np.clip(begins, lo, hi)))
    ahead = min(lo, depth)
    near = np.concatenate([np.full(depth - ahead, kernels.START, np.uint8), data[lo - ahead : hi]])
    gram = data[lo:hi].astype(np.int64)
    for j in range(1, depth + 1):
        before = np.where(since >= j, near[depth - j : depth - j + hi - lo], np.uint8(kernels.START))
        gram |= before.astype(np.int64) << (8 * (depth + 1 - j))
    return gram


class Level:
    """Nodes of the contexts of one length, sorted by context * 256 + node."""

    def __init__(self, ids: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> None:
        own = kt_block(zeros, ones)
        self.ids, self.zeros, self.ones = ids, zeros, ones
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)  # ln Pw
        self.stop = np.ones(len(ids)) if below is None else np.exp(own - np.log(2) - self.weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1)

    def parent(self) -> Level:
        """The nodes of the contexts that are one byte shorter."""
        ids, inverse = np.unique(shorter(self.ids), return_inverse=True)
        return Level(ids, *(np.bincount(inverse, weights=w, minlength=len(ids)) for w in (self.zeros, self.ones, self.weighted)))


def shorter(ids: np.ndarray) -> np.ndarray:
    """The same node in the context without its farthest byte."""
    return ids >> 16 << 8 | ids & 255


def subtrees(gram: np.ndarray, times: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, list[tuple[Level, np.ndarray]]]:
    """Of whole subtrees: [gram, 8] nodes that a gram's byte passes, its bits there, and from contexts of `depth` bytes down to three the nodes and where the grams' are."""
    byte = (gram & 255)[:, None]
    step = np.arange(8)
    node, bit = 1 << step | byte >> 8 - step, byte >> 7 - step & 1
    ids = gram[:, None] >> 8 << 8 | node
    kinds, inverse = np.unique(ids.ravel(), return_inverse=True)
    each = np.repeat(times, 8).astype(np.float64)
    ones = np.bincount(inverse, weights=each * bit.ravel(), minlength=len(kinds))
    level = Level(kinds, np.bincount(inverse, weights=each, minlength=len(kinds)) - ones, ones, None)
    out = [(level, inverse.reshape(ids.shape))]
    while len(out) < depth - _TOP:
        ids, level = shorter(ids), level.parent()
        out.append((level, np.searchsorted(level.ids, ids)))
    return ids, bit, out


def mixed(top: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, and what contexts of no to `_TOP` bytes add to the probability of a one there, and the share they leave to longer ones."""
    levels = [top]
    for _ in range(_TOP):
        levels.append(levels[-1].parent())
    one, left = np.zeros(len(top.ids)), np.ones(len(top.ids))
    at = [top.ids]
    for _ in range(_TOP):
        at.append(shorter(at[-1]))
    for level, ids in zip(reversed(levels), reversed(at), strict=True):
        k = np.searchsorted(level.ids, ids)
        one, left = one + left * level.stop[k] * level.one[k], left * (1 - level.stop[k])
    return top.ids, one, left


def code_lengths(gram: np.ndarray, times: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    """Bits of each gram's byte after its context; whole subtrees."""
    ids, bit, levels = subtrees(gram, times, depth)
    k = np.searchsorted(top[0], shorter(ids))
    one, left = top[1][k], top[2][k]
    for level, at in reversed(levels):
        one, left = one + left * level.stop[at] * level.one[at], left * (1 - level.stop[at])
    return -np.log2(np.where(bit == 1, one, 1 - one)).sum(axis=1)


def whole_subtrees(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, times) of whole subtrees of three bytes, many small ones together, from batches in the order of grams."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    size, at = 0, -1  # rows in parts, the subtree of the last one
    for batch in batches:
        gram, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if not len(gram):
            continue
        subtree = gram >> 8 * (depth - _TOP)
        cut = int(np.searchsorted(subtree, subtree[-1]))
        if (cut or subtree[0] != at) and size + cut >= _BLOCK:
            parts.append((gram[:cut], times[:cut]))
            yield np.concatenate([g for g, _ in parts]), np.concatenate([t for _, t in parts])
            parts, size, gram, times = [], 0, gram[cut:], times[cut:]
        parts.append((gram, times))
        size, at = size + len(gram), subtree[-1]
    if parts:
        yield np.concatenate([g for g, _ in parts]), np.concatenate([t for _, t in parts])


def _gram_counts(docs: DataFrame, depth: int) -> DataFrame:
    """gram, n (times in training rows), m (times in all) from docs (text, learn)."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        code, times = np.unique(np.concatenate(parts), return_counts=True)
        learn = code & 1
        return pa.RecordBatch.from_arrays([pa.array(code >> 1), pa.array(times * learn, pa.int64()), pa.array(times, pa.int64())], ["gram", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        size = 0
        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, last, data, offs in kernels.chunks(batch.column(0)):
                data = kernels.lower_ascii(data)
                for lo in range(0, len(data), _PIECE):
                    hi = min(lo + _PIECE, len(data))
                    flag = np.repeat(learn[first:last], np.diff(np.clip(offs, lo, hi)))
                    parts.append(path_grams(data, offs, lo, hi, depth) << 1 | flag)
                    size += hi - lo
                    if size >= _COUNTED:
                        yield counted(parts)
                        parts, size = [], 0
        if parts:
            yield counted(parts)

    return docs.select("text", "learn").mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def tree(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, m, cost: the code length of every gram of a table (gram, n, m)."""
    if not _TOP < depth <= 6:
        raise ValueError("depth must be 3 to 6 bytes")
    spark = grams.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    subtree = F.shiftright("gram", 8 * (depth - _TOP))
    along = grams.select("gram", "n", "m").repartition(tasks, subtree).sortWithinPartitions("gram")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, times in whole_subtrees(batches, depth):
            deep = subtrees(gram, times, depth)[2][-1][0]
            ids, inverse = np.unique(shorter(deep.ids), return_inverse=True)
            total = [np.bincount(inverse, weights=w, minlength=len(ids)) for w in (deep.zeros, deep.ones, deep.weighted)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), *map(pa.array, total)], ["id", "zeros", "ones", "below"])

    above = along.select("gram", "n").mapInArrow(sums, "id long, zeros double, ones double, below double")
    rows = above.groupBy("id").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).toArrow()  # 2 ** 24 rows at most
    order = np.argsort(rows["id"].to_numpy())
    shared = spark.sparkContext.broadcast(mixed(Level(*(rows[c].to_numpy()[order] for c in ("id", "zeros", "ones", "below")))))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, times in whole_subtrees(batches, depth):
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(code_lengths(gram, times, shared.value, depth))], ["gram", "cost"])

    return along.select("gram", "n").mapInArrow(costs, "gram long, cost double")


class Lookup:
    """Code lengths of the grams that are broadcast, by a hash table of places with one entry a slot; the rest of them by search."""

    def __init__(self, grams: np.ndarray, cost: np.ndarray) -> None:
        self.grams, self.cost = grams, cost  # sorted
        bits = max(2, int(4 * max(len(grams), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(grams)] = np.arange(len(grams), dtype=np.int32)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs, 0 where not found, and which were found."""
        if not len(self.grams):
            return np.zeros(len(gram)), np.zeros(len(gram), bool)
        at = self.slots[self._slot(gram)]
        hit = self.grams[at] == gram
        miss = np.flatnonzero(~hit)
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.grams, gram[miss]), len(self.grams) - 1)
            hit[miss] = self.grams[at[miss]] == gram[miss]
        return np.where(hit, self.cost[at], 0.0), hit


def _word_counts(train: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [kernels.word_hashes(data, offs)[0] for _, _, data, offs in kernels.chunks(batch.column(0))]
            value, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            end = [END] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([kernels.as_long(value), pa.array(end, pa.int64())]), pa.array([*times.tolist(), *([batch.num_rows] if end else [])], pa.int64())], ["word", "c"])

    return train.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(grams: DataFrame, most: int) -> Column:
    """A condition on (m) that at most so many grams meet, the most frequent ones; classes of counts are kept together."""
    kind = F.floor(F.log2("m") * 16)
    sizes = sorted(grams.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # 1024 rows at most
    least = None
    for row in sizes:
        most -= row.k
        if most < 0:
            break
        least = row.kind
    return F.lit(False) if least is None else kind >= least


def score(docs: DataFrame, training: Column, *, depth: int = DEPTH, heavy_grams: int = HEAVY_GRAMS, heavy_words: int = HEAVY_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs.

    training: a condition on docs that says which rows to learn from.
    """
    spark = docs.sparkSession
    train = docs.filter(training)
    grams = storage.materialize(_gram_counts(docs.select("text", F.coalesce(training, F.lit(False)).alias("learn")), depth), "grams")
    often = frequent(grams, heavy_grams)
    costs = storage.materialize(tree(grams, depth).join(grams.select("gram", often.alias("often")), "gram"), "costs")
    known = costs.filter("often").select("gram", "cost").toArrow()  # heavy_grams rows at most
    by_gram = np.argsort(known["gram"].to_numpy())
    vocabulary = storage.materialize(_word_counts(train), "words")
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = vocabulary.orderBy(F.desc("c"), "word").limit(heavy_words).toArrow()  # heavy_words rows
    word = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    cut = int(top["c"].to_numpy().min()) if top.num_rows == heavy_words else 0
    shared = spark.sparkContext.broadcast((word[order], top["c"].to_numpy()[order], known["gram"].to_numpy()[by_gram], known["cost"].to_numpy()[by_gram]))
    # a text's rare grams beyond _RARE follow in rows of their own, which have no n_tokens
    fields = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, bits double, n_bytes long, rare array<long>, grams array<long>"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kernels.worker_cache()
        if getattr(cache, "ctw_key", None) is not shared._path and getattr(cache, "ctw_key", None) != shared._path:
            heavy, count, gram, cost = shared.value
            cache.ctw_key, cache.ctw = shared._path, (heavy, count, Lookup(gram, cost))
        heavy, count, frozen = cache.ctw
        at_end = np.searchsorted(heavy, np.uint64(END))
        end_known = bool(len(heavy)) and at_end < len(heavy) and heavy[at_end] == np.uint64(END)
        for batch in batches:
            for first, last, data, offs in kernels.chunks(batch.column(3)):
                hashes, begin = kernels.word_hashes(data, offs)
                value, inverse = np.unique(hashes, return_inverse=True)
                near = np.minimum(np.searchsorted(heavy, value), max(len(heavy) - 1, 0))
                hit = heavy[near] == value if len(heavy) else np.zeros(len(value), bool)
                logs = np.where(hit, np.log10(count[near] + 1.0), 0.0) if len(heavy) else np.zeros(len(value))
                doc = np.repeat(np.arange(last - first), np.diff(begin))
                known = np.bincount(doc[hit[inverse]], minlength=last - first)
                sums = np.bincount(doc, weights=logs[inverse], minlength=last - first)
                rare, rare_doc = hashes[~hit[inverse]], doc[~hit[inverse]]
                size = np.diff(begin) + 1
                if end_known:
                    known, sums = known + 1, sums + np.log10(count[at_end] + 1.0)
                    more = np.zeros(last - first, np.int64)
                else:  # the end token is as rare as others
                    more = np.ones(last - first, np.int64)
                    place = np.searchsorted(rare_doc, np.arange(last - first), "right")
                    rare = np.insert(rare, place, np.uint64(END))
                offsets = np.zeros(last - first + 1, np.int32)
                np.cumsum(np.bincount(rare_doc, minlength=last - first) + more, out=offsets[1:])
                bits, uncommon = np.zeros(last - first), []
                lowered = kernels.lower_ascii(data)
                for lo in range(0, len(data), _PIECE):
                    hi = min(lo + _PIECE, len(data))
                    gram = path_grams(lowered, offs, lo, hi, depth)
                    cost, found = frozen.find(gram)
                    own = np.repeat(np.arange(last - first), np.diff(np.clip(offs, lo, hi)))
                    bits += np.bincount(own, weights=cost, minlength=last - first)
                    uncommon.append((own[~found], gram[~found]))
                whose = np.concatenate([w for w, _ in uncommon]) if uncommon else np.zeros(0, np.int64)
                gram = np.concatenate([g for _, g in uncommon]) if uncommon else np.zeros(0, np.int64)
                start = np.searchsorted(whose, np.arange(last - first + 1))
                uid = batch.column(0)[first:last]
                for row in np.flatnonzero(np.diff(start) > _RARE):
                    for lo in range(start[row], start[row + 1], _RARE):
                        part = gram[lo : min(lo + _RARE, start[row + 1])]
                        more = [pa.nulls(1, batch.schema.field(i).type) for i in (1, 2)] + [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([uid[row : row + 1], *more, pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], names)
                few = np.diff(start) <= _RARE
                places = np.zeros(last - first + 1, np.int32)
                np.cumsum(np.where(few, np.diff(start), 0), out=places[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        uid, batch.column(1)[first:last], batch.column(2)[first:last], pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(bits), pa.array(np.diff(offs), pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), kernels.as_long(rare)), pa.ListArray.from_arrays(pa.array(places), pa.array(gram[np.repeat(few, np.diff(start))])),
                    ],
                    names,
                )

    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", (~training).alias("held_out"), "text")
    passed = storage.materialize(keyed.mapInArrow(run, fields), "scored")
    words = vocabulary.filter(F.col("c") <= cut) if cut else vocabulary.limit(0)
    rare = passed.select("uid", F.explode("rare").alias("word")).join(words, "word").groupBy("uid").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"))
    deep = passed.select("uid", F.explode("grams").alias("gram")).join(costs.filter("NOT often").select("gram", "cost"), "gram").groupBy("uid").agg(F.sum("cost").alias("more_bits"))
    out = passed.filter("n_tokens IS NOT NULL").drop("rare", "grams").join(rare, "uid", "left").join(deep, "uid", "left")
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(tokens + kinds + 1)))
    bits = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), (bits * F.lit(-float(np.log10(2)))).alias("score"), F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
