"""Language identification by prediction by partial matching over bytes.

For each language, counts of a byte after its up to three predecessors give a tree of contexts of variable order.
A text's code length in a language is exact under these frozen statistics: a byte is coded in its longest known
context, or escapes (method C: as many escape units as the context has distinct successors, counting only bytes
that the longer contexts exclude not) to the next shorter one, down to a uniform code over all 256 bytes. The
language with the shortest code is predicted.

Since statistics are frozen, the code length of a byte given its predecessors is a table lookup. Bytes that no
training text holds are one symbol of the table, so its size is bounded by the symbols seen, not by the data.

The classifier is fitted on a bounded sample: at most `sample_rows` labelled rows a language, those with the
smallest hash of doc_id, and of those only up to `sample_bytes` bytes a language (whole texts, in that order).
Everything else covers all rows and whole texts.

`keep_recognised` rejects what is `und`, and texts that even the best language's model does not compress: MOST_BITS
bits a byte is the uniform code, and clean texts of a learned language, a few words long or with keys and numbers
among them, stay well below it.

Defined cases: null text, or text without a letter (a character of Unicode category L), is `und` with score 0; with no labelled rows every text is;
rows with null lang are never learned from; ties go to the language first in order; repeated rows are alike; extra
columns pass through `keep_recognised`; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attestine.llm import kernels, storage

SAMPLE_ROWS = 300
SAMPLE_BYTES = 1_000_000
UNKNOWN = "und"
MOST_BITS = 8.0
BROADCAST_ROWS = 1 << 20  # chosen (doc_id, lang) pairs; beyond that (over 3,000 languages) they are joined by a shuffle
MODEL_BYTES = 1 << 30


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, 0 for a byte that no training text holds
    context: np.ndarray  # three symbols -> row of cost, 0 where no language knows the context
    cost: np.ndarray  # [row, symbol, language] bits, for contexts of three known to some language
    shorter: np.ndarray  # [two symbols, symbol, language] bits, for all others




def _costs(counts: list[np.ndarray]) -> np.ndarray:
    """Bits of each symbol in nested contexts, longest first: counts[k] is [row, symbol]."""
    n, a = counts[0].shape
    bits = np.full((n, a), np.nan)
    gone = np.zeros((n, a), bool)  # excluded: known to a longer context
    escape = np.zeros((n, 1))
    for have in counts:
        use = np.where(gone, 0, have)
        total = use.sum(axis=1, keepdims=True)
        kinds = (use > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(use > 0, escape - np.log2(use / (total + kinds)), bits)
            escape = escape + np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0)
        gone |= have > 0
    unseen = 256 - gone.sum(axis=1, keepdims=True)  # symbols for the uniform code; symbol 0 stands for all bytes not in training
    bits = np.where(gone, bits, escape + np.log2(np.maximum(unseen, 1)))
    return bits.astype(np.float32)


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: language -> (four-byte numbers, how often)."""
    languages = sorted(counts)
    seen = np.zeros(256, bool)
    seen[kernels.START] = True
    for gram, _ in counts.values():
        seen[np.unique(gram & 255)] = True
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, seen.sum() + 1)
    a = int(seen.sum()) + 1
    parts = {}
    for lang, (gram, times) in counts.items():
        s = [symbol[(gram >> shift) & 255] for shift in (24, 16, 8, 0)]
        parts[lang] = ((s[0] * a + s[1]) * a + s[2], s[1] * a + s[2], s[2], s[3], times)
    known = np.unique(np.concatenate([p[0] for p in parts.values()])) if parts else np.zeros(0, np.int64)
    size = 4 * (a**3 + (len(known) + 1 + a * a) * a * len(languages))
    if size > MODEL_BYTES:
        raise ValueError(f"the model of {len(languages)} languages takes {size} bytes, over {MODEL_BYTES}: fit it on fewer sample_bytes")
    context = np.zeros(a**3, np.int32)
    context[known] = np.arange(1, len(known) + 1)
    cost = np.empty((len(known) + 1, a, len(languages)), np.float32)
    shorter = np.empty((a * a, a, len(languages)), np.float32)
    for k, lang in enumerate(languages):
        c3, c2, c1, s, times = parts[lang]
        n0, n1, n2, n3 = np.zeros(a), np.zeros((a, a)), np.zeros((a * a, a)), np.zeros((len(known) + 1, a))
        np.add.at(n0, s, times)
        np.add.at(n1, (c1, s), times)
        np.add.at(n2, (c2, s), times)
        np.add.at(n3, (context[c3], s), times)
        one = np.arange(a * a) % a
        for at in range(0, a * a, 4096):
            r = slice(at, min(at + 4096, a * a))
            shorter[r, :, k] = _costs([n2[r], n1[one[r]], np.broadcast_to(n0, (r.stop - r.start, a))])
        two = np.append(0, known % (a * a))
        for at in range(0, len(two), 4096):
            r = slice(at, min(at + 4096, len(two)))
            cost[r, :, k] = _costs([n3[r], n2[two[r]], n1[two[r] % a], np.broadcast_to(n0, (r.stop - r.start, a))])
    return Model(languages, symbol, context, cost, shorter)


def code_lengths(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[document, language] bits."""
    out = np.zeros((len(offs) - 1, len(model.languages)))
    if not len(data):
        return out
    a = model.shorter.shape[1]
    gram = kernels.byte_grams(data, offs)
    s = [model.symbol[(gram >> np.uint32(shift)) & np.uint32(255)] for shift in (24, 16, 8, 0)]
    two = s[1] * a + s[2]
    row = model.context[s[0] * (a * a) + two]
    flat = model.cost.reshape(-1, len(model.languages))
    bits = flat[row * np.int64(a) + s[3]]
    none = np.flatnonzero(row == 0)
    bits[none] = model.shorter.reshape(-1, len(model.languages))[two[none] * a + s[3][none]]
    some = np.flatnonzero(np.diff(offs))
    out[some] = np.add.reduceat(bits.astype(np.float64), offs[some], axis=0)
    return out


def train(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of docs (doc_id, text, lang)."""
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # what is ranked is narrow; WindowGroupLimit leaves sample_rows a language in each task before the exchange
    chosen = labelled.select("doc_id", "lang", F.octet_length("text").alias("bytes")).withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= sample_rows)
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).filter(F.col("before") < sample_bytes).select("doc_id", "lang").distinct()
    chosen = storage.materialize(chosen, "language-sample")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sample = labelled.select("doc_id", "lang", "text").join(few, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, last, data, offs in kernels.chunks(batch.column(1)):
                gram, own = kernels.byte_grams(data, offs), np.repeat(np.arange(last - first), np.diff(offs))
                names = sorted(set(langs[first:last]))
                of = np.array([names.index(x) for x in langs[first:last]])[own]
                for k, lang in enumerate(names):
                    value, times = np.unique(gram[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value, pa.uint32()).cast(pa.int64()), pa.array(times, pa.int64())], ["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    table = counted.to_pandas()
    return build({lang: (part["gram"].to_numpy(np.int64), part["n"].to_numpy(np.int64)) for lang, part in table.groupby("lang")})


def predict(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "bits_per_byte")) -> DataFrame:
    """Every row of docs with lang_pred, score and bits_per_byte; columns of docs with these names are replaced.

    score is the posterior of the prediction, all languages being equally likely beforehand.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.symbol, model.context, model.cost, model.shorter))  # plain arrays: workers need no copy of the package
    fields = T.StructType(list(docs.schema)).add(names[0], "string").add(names[1], "double").add(names[2], "double")
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        frozen = Model(*shared.value)
        word = re.compile(r"[^\W\d_]+")  # holds numbers like ² and Ⅷ, too
        for batch in batches:
            text = batch.column(where)
            best, score, per = [], [], []
            for first, last, data, offs in kernels.chunks(text, 1 << 17):
                size = np.diff(offs)
                if frozen.languages:
                    bits = code_lengths(frozen, data, offs)
                    at = bits.argmin(axis=1)
                    low = bits[np.arange(len(bits)), at]
                    sure = 1 / np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
                for k in range(last - first):
                    value = text[first + k]
                    if not frozen.languages or not value.is_valid or not any(c.isalpha() for m in word.finditer(value.as_py()) for c in m[0]):
                        best.append(UNKNOWN), score.append(0.0), per.append(None)
                    else:
                        best.append(frozen.languages[at[k]]), score.append(float(sure[k])), per.append(float(low[k] / size[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(per, pa.float64())], schema=pa.schema([*batch.schema, (names[0], pa.string()), (names[1], pa.float64()), (names[2], pa.float64())]))

    return docs.mapInArrow(run, fields)


def held_out(parts: int, remainder: int):
    """crc32 of doc_id as text, modulo parts, equals remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == remainder


def keep_recognised(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised and whose code is shorter than the text, with the columns of docs."""
    model = train(docs)
    names = ("__lang_pred", "__score", "__bits_per_byte")
    return predict(docs, model, names).filter((F.col(names[0]) != UNKNOWN) & (F.col(names[2]) < MOST_BITS)).select(*docs.columns)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
