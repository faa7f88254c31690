"""Finding a quote in a page: exactly, but for white space, or nearly."""

from __future__ import annotations

import difflib
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestine.functions.spans import nearest, occurrences
from attestine.functions.tokens import pinned, strip

CONTEXT = 32
LEAST_RATIO = 0.90
FUZZY_CHARS = 2_000_000
LEAST_KEPT = 0.6
FOUND = "struct<start:int,end:int,exact:string,prefix:string,suffix:string,strategy:string,score:double>"


def proportional_near(start: Column, source_len: Column, target_len: Column) -> Column:
    """Where in the target the quote should be, from its place in the source; null if too much was stripped to tell."""
    known = start.isNotNull() & (source_len > 0) & (target_len > 0) & (source_len >= LEAST_KEPT * target_len)
    return F.when(known, F.bround(start / source_len * target_len).cast("int"))


def with_context(target: Column, start: Column, end: Column, strategy: str, score: float = 1.0) -> Column:
    """The anchor with up to 32 characters on both sides."""
    before = F.greatest(start - CONTEXT, F.lit(0))
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(target, start + 1, end - start).alias("exact"), F.substring(target, before + 1, start - before).alias("prefix"),
        F.substring(target, end + 1, F.lit(CONTEXT)).alias("suffix"), F.lit(strategy).alias("strategy"), F.lit(score).alias("score"),
    )


def anchor_exact(quote: Column, target: Column, near: Column) -> Column:
    """The verbatim occurrence nearest to near, the first without it; null if there is none."""
    bare = strip(quote)
    start = nearest(occurrences(bare, target), near)
    return F.when((bare != "") & start.isNotNull(), with_context(target, start, start + F.length(bare), "exact"))


def _normal(text: str) -> tuple[str, np.ndarray]:
    """Without soft hyphens, white space collapsed and trimmed; and where each character was."""
    chars = np.array(list(text), dtype=object)
    keep = [k for k, c in enumerate(chars) if c != "­"]
    blank = [chars[k].isspace() for k in keep]
    use = [i for i in range(len(keep)) if not blank[i] or (i and not blank[i - 1])]
    if use and blank[use[-1]]:
        use.pop()
    if use and blank[use[0]]:
        use.pop(0)
    return "".join(" " if blank[i] else chars[keep[i]] for i in use), np.array([keep[i] for i in use], int)


def _places(quote: str, text: str) -> list[int]:
    out, at = [], text.find(quote)
    while at >= 0:
        out.append(at)
        at = text.find(quote, at + 1)
    return out


def _anchor_loose(quote: str | None, target: str | None, near: float | None) -> tuple | None:
    if not quote or not quote.strip() or not target:
        return None
    text, where = _normal(target)
    want, _ = _normal(quote)
    if not want:
        return None
    near = None if near is None or near != near else int(near)
    places = _places(want, text)
    if places:
        at = places[0] if near is None or len(places) == 1 else min(places, key=lambda p: (abs(p - near), p))
        return int(where[at]), int(where[at + len(want) - 1]) + 1, "normalized", 1.0
    if len(text) > FUZZY_CHARS:
        return None
    same = difflib.SequenceMatcher(None, text, want, autojunk=False).find_longest_match(0, len(text), 0, len(want))
    if not same.size:
        return None
    first = max(0, same.a - same.b)
    last = min(len(text), first + len(want))
    ratio = difflib.SequenceMatcher(None, text[first:last], want, autojunk=False).ratio()
    return (int(where[first]), int(where[last - 1]) + 1, "fuzzy", round(ratio, 4)) if ratio >= LEAST_RATIO else None


def anchor_ladder(rows: DataFrame) -> DataFrame:
    """rows (quote, target, near, ...) with anchor: exact, else but for white space, else near-identical, else null.

    The exact rung is native; only rows that it leaves are sent to the UDF.
    """
    first = pinned(rows.withColumn("anchor", anchor_exact(F.col("quote"), F.col("target"), F.col("near")).cast(FOUND)), "anchor")

    @F.pandas_udf(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("strategy", T.StringType()).add("score", T.DoubleType()))
    def loose(quote: pd.Series, target: pd.Series, near: pd.Series) -> pd.DataFrame:
        found = [_anchor_loose(q, t, n) or (None, None, None, None) for q, t, n in zip(quote, target, near, strict=True)]
        return pd.DataFrame(found, columns=["start", "end", "strategy", "score"]).astype({"start": "Int32", "end": "Int32"})

    rest = first.filter("anchor IS NULL").withColumn("_l", loose("quote", "target", "near"))
    context = with_context(F.col("target"), F.col("_l.start"), F.col("_l.end"), "")
    filled = F.when(F.col("_l.start").isNotNull(), context.withField("strategy", F.col("_l.strategy")).withField("score", F.col("_l.score")).cast(FOUND))
    return first.filter("anchor IS NOT NULL").unionByName(rest.withColumn("anchor", filled).drop("_l"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
