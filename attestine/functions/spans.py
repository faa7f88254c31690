"""Sentence spans that keep their offsets, and what is asked of a span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestine.functions.lexicon import HEADINGS, LEADING_ANAPHORS
from attestine.functions.tokens import let, strip

END, CUT = "\u0001", "\u0002"
BOUNDARY = r"(?U)([.!?]+)((?:\[[^\]]{1,24}\])*\s+)"


def candidate_spans(text: Column) -> Column:
    """array<struct<text, start, end>>: sentences with text[start:end] = text, counted in code points from 0.

    A sentence ends after its punctuation; citation marks and white space after it are skipped. The text is cut at
    inserted marks, and offsets are running sums of piece lengths, so the row needs neither a shuffle nor a UDF.
    """
    clean = F.regexp_replace(text, f"[{END}{CUT}]", "�")
    pieces = F.split(F.regexp_replace(clean, BOUNDARY, f"$1{END}$2{CUT}"), CUT, -1)
    return let(pieces, _spans_of)


def _spans_of(pieces: Column) -> Column:
    sizes = F.transform(pieces, lambda p: F.length(p) - F.when(F.instr(p, END) > 0, 1).otherwise(0))
    offsets = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def span(piece: Column, offset: Column) -> Column:
        raw = F.substring_index(piece, END, 1)
        body = strip(raw)
        start = offset + F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
        return F.struct(body.alias("text"), start.alias("start"), (start + F.length(body)).alias("end"))

    zipped = F.zip_with(pieces, offsets, lambda p, o: F.when(p.isNotNull(), span(p, o)))
    return F.filter(zipped, lambda s: s.isNotNull() & (s["text"] != ""))


def sentence_claims(text: Column, least: int = 25) -> Column:
    """Spans of `least` characters or more."""
    return F.filter(candidate_spans(text), lambda s: F.length(s["text"]) >= least)


def naive_sentences(text: Column) -> Column:
    """Sentences of a text split after punctuation, without offsets."""
    return F.filter(F.split(strip(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def is_citable_prose(text: Column) -> Column:
    """Neither a heading of references and the like, nor a back-reference, nor a table row."""
    first = F.lower(F.regexp_replace(strip(F.substring_index(strip(text), "\n", 1)), ":+$|^:+", ""))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return ~(strip(first).isin(*HEADINGS) | text.rlike(r"^[-* ]*\^") | (bars >= 4))


def has_leading_anaphor(text: Column) -> Column:
    return strip(text).rlike(r"(?iU)^(?:" + "|".join(LEADING_ANAPHORS) + r")\b")


def preceding_context(text: Column, start: Column, chars: int = 320) -> Column:
    """What stands before start, from a sentence's beginning if the window cuts the text."""
    begin = F.greatest(start - chars, F.lit(0))
    window = F.substring(text, begin + 1, start - begin)
    return strip(F.when(begin > 0, F.regexp_replace(window, r"(?sU)^.*?[.!?]\s+(.*)$", "$1")).otherwise(window))


def occurrences(quote: Column, page: Column) -> Column:
    """Starts (from 0) of all occurrences, overlapping ones too, in order.

    The page is cut before every occurrence, so the work is one pass, and starts are running sums of piece lengths.
    """
    literal = F.concat(F.lit("(?=\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    sizes = F.transform(F.split(page, literal, -1), F.length)
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    starts = F.slice(ends, 2, F.greatest(F.size(ends) - 2, F.lit(0)))
    first = F.when(page.startswith(quote), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.when((F.length(quote) == 0) | (F.instr(page, quote) == 0), F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(first, starts)))


def nearest(places: Column, near: Column) -> Column:
    """The place with the least distance to near, the lower one of two; the first without near; null without places."""
    by_distance = F.transform(places, lambda p: F.struct(F.abs(p - near).alias("d"), p.alias("p")))
    return F.when(F.size(places) == 0, F.lit(None)).when(near.isNull(), F.get(places, F.lit(0))).otherwise(F.array_min(by_distance)["p"])


def is_unique_in(quote: Column, page: Column) -> Column:
    """The quote occurs exactly once."""
    first = F.instr(page, quote)
    return (F.length(quote) > 0) & (first > 0) & (F.instr(F.substring(page, first + 1, F.length(page)), quote) == 0)
