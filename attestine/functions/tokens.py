"""Word tokens and lexical likeness, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.functions.lexicon import CONTENT_STOPLIST


def let(value: Column, use) -> Column:
    """use(value) with value computed once: in a lambda's body an expression is computed for every element."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def pinned(rows: DataFrame, *names: str) -> DataFrame:
    """rows, with these columns computed once: a generator ends the merging of projections, which would copy them into every use."""
    rest = [x for x in rows.columns if x not in names]
    return rows.select(*rest, F.explode(F.array(F.struct(*names))).alias("_pinned")).select(*rest, "_pinned.*")


def words_literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def content_words(text: Column) -> Column:
    """Distinct tokens of over two characters that carry content."""
    return F.array_except(F.filter(word_tokens(text), lambda w: F.length(w) > 2), words_literal(CONTENT_STOPLIST))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def directed_overlap(a: Column, b: Column) -> Column:
    """Share of a's words that b has; 0 if a has none."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def squeeze(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)\s+", " "), "^ | $", "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
