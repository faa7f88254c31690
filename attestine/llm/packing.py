"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document's ids end with `end_id`; only a document longer than `capacity` is cut, into pieces of exactly
`capacity` (the last may be shorter). Pieces are dealt into shards of about `shard_pieces`, largest first
within a shard, and each goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of
open bins with g places left: a bin with gap g >= size, or a new bin. A shard's state is one counter and one
stack per gap, so memory is bounded by the shard; a shard's leftover loss is at most a few bins in thousands.

Defined cases: null or empty text is the single id `end_id`; repeated rows are packed once per row; ties go to
the smallest gap; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestine.llm import kernels, storage

CAPACITY = 2048
SHARD_PIECES = 200_000
CACHE_WORDS = 400_000
PIECES = "doc_id long, row int, piece int, start long, length long, ids_crc32 long"


class _Memo(dict):
    """piece -> encoded ids; two generations of at most `limit` pieces each."""

    def __init__(self, encode, limit: int) -> None:
        self.encode, self.limit, self.old = encode, limit, {}

    def __missing__(self, piece: str) -> bytes:
        value = self.old.get(piece)
        if value is None:
            value = self.encode(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


def _latin_pattern() -> re.Pattern:
    """The word pattern of the tokenizer for characters below U+0250: letters together, digits alone, the rest together."""
    kind = {"L": [], "N": [], "Z": [], "": []}
    for code in range(0x250):
        c = chr(code)
        kind[unicodedata.category(c)[0] if unicodedata.category(c)[0] in "LN" else "Z" if c.isspace() else ""].append(re.escape(c))
    letter, number, rest = ("".join(kind[k]) for k in ("L", "N", ""))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[{rest}]+")


#: Texts with these go to the tokenizer whole: other scripts, odd white space, letters whose lower case is beyond the range, special tokens.
_UNUSUAL = re.compile("[^\\x00-\\x1b\\x20-\\x84\\x86-\\x9f\\xa1-\\u012f\\u0131-\\u0239\\u023b-\\u023d\\u023f-\\u024f]|<\\|")
_ODD_LATIN = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")


def _usual(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _UNUSUAL.search(text) and unicodedata.is_normalized("NFC", text)
    return not any(x in text for x in _ODD_LATIN)


def _byte_letters() -> dict[int, str]:
    """latin-1 code -> the letter that stands for this byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_encoder(tokenizer_file: str, cache_words: int = CACHE_WORDS):
    """text -> little-endian unsigned 32-bit ids, as bytes, equal to the tokenizer's own encoding.

    The tokenizer lower-cases, splits at white space, then words from digits and signs, and encodes each piece by
    itself; so runs without white space, and the pieces of those not met before, are encoded once per worker and
    remembered. Texts outside the Latin range are encoded by the tokenizer as a whole.
    """
    cache = kernels.worker_cache()
    key = f"words:{tokenizer_file}"
    if not hasattr(cache, key):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        model, letters, pattern = tokenizer.model, _byte_letters(), _latin_pattern()

        def whole(text: str) -> bytes:
            return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        def piece(text: str) -> bytes:
            return b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(text.encode().decode("latin-1").translate(letters))])

        pieces = _Memo(piece, cache_words)
        runs = _Memo(lambda run: b"".join([pieces[p] for p in pattern.findall(run)]), cache_words)
        setattr(cache, key, (whole, runs))
    whole, runs = getattr(cache, key)

    def encode(text: str) -> bytes:
        return b"".join(map(runs.__getitem__, text.lower().split())) if _usual(text) else whole(text)

    return encode


def cut_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0, *, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, row, piece, start, length, ids_crc32 and, with keep_ids, ids (binary)."""
    width = 4 * capacity
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(tokenizer_file)
        rows = 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    out.append((doc_id, rows, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
                rows += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "row", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) or [()] * (6 + keep_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + (", ids binary" if keep_ids else ""))


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the given order. Items longer than capacity are an error."""
    sizes = np.asarray(sizes, np.int64)
    if len(sizes) and (sizes.max() > capacity or sizes.min() < 1):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    count = np.zeros(capacity + 1, np.int64)  # gap 0 stays 0: full bins don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, size in enumerate(sizes.tolist()):
        # moving a bin from gap g to gap g - size changes the sum by 2 (N(g - size) - N(g)) + 2, or by 1 - 2 N(g) if it fills up
        change = 2 * (count[: capacity - size + 1] - count[size:]) + 2
        change[0] = 1 - 2 * count[size]
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        change[count[size:] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        if change[best] <= fresh:
            gap = best + size
            at = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, opened
            opened += 1
        bins[k], offsets[k] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            stacks[gap - size].append(at)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, *, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset added; pieces must be a materialised table."""
    total = pieces.count()
    shards = max(1, -(-total // shard_pieces))
    fields = T.StructType(list(pieces.schema)).add("sequence_id", "long").add("offset", "long")
    names = pieces.columns

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        at, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        frame["sequence_id"] = (frame["shard"].to_numpy(np.int64) << 32) + at
        frame["offset"] = offset
        return frame[[*names, "sequence_id", "offset"]]

    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int")
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(run, fields)


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = storage.materialize(cut_pieces(docs, tokenizer_file, capacity, end_id).drop("row"), "pieces")
    return pack(pieces, capacity)


def sequences(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """sequence_id, n_pieces, length, ids (array<int>): the packed token sequences themselves."""
    pieces = storage.materialize(cut_pieces(docs, tokenizer_file, capacity, end_id, keep_ids=True).drop("row"), "pieces-ids")
    placed = pack(pieces.drop("ids"), capacity)
    full = placed.select("doc_id", "piece", "ids_crc32", "sequence_id", "offset").dropDuplicates(["sequence_id", "offset"])
    with_ids = full.join(pieces.select("doc_id", "piece", "ids_crc32", "ids", "length").dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    grouped = with_ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "length"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) for p in batch.column(1)], pa.int32()), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["sequence_id", "n_pieces", "length", "ids"],
            )

    return grouped.mapInArrow(join, "sequence_id long, n_pieces int, length long, ids array<int>")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
