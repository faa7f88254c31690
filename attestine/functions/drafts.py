"""Drafts and prompts: cleaning what a writer returns, and choosing what it sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.functions.tokens import directed_overlap, strip, token_set


def strip_reasoning(text: Column) -> Column:
    """Without <think> blocks, closed or not."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")


def strip_markdown(text: Column) -> Column:
    """Plain sentences: no headings, table rows, dividers, list marks, bold marks or backticks."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip)
    bars = lambda s: F.length(s) - F.length(F.replace(s, F.lit("|"), F.lit("")))
    prose = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & ~s.startswith("|") & (bars(s) < 2) & ~s.rlike(r"^[-*_= ]+$"))
    bare = F.transform(prose, lambda s: F.regexp_replace(s, r"(?U)^\s*(?:[-*+]|\d+[.)])\s+", ""))
    joined = F.regexp_replace(F.array_join(bare, "\n"), r"\*\*(.+?)\*\*|__(.+?)__", "$1$2")
    return strip(F.replace(joined, F.lit("`"), F.lit("")))


def focus_source(question: Column, text: Column, budget: int = 4000) -> Column:
    """The paragraphs nearest to the question that fit the budget, in document order; short texts as they are.

    Whether a paragraph fits depends on those taken before it, so the choice is a fold over the ranked paragraphs.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n+"), strip), lambda p: p != "")
    asked = token_set(question)
    ranked = F.array_sort(F.transform(paragraphs, lambda p, i: F.struct((-directed_overlap(asked, token_set(p))).alias("o"), i.alias("i"), p.alias("p"))))
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<i:int,p:string>>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        size = acc["total"] + F.length(x["p"]) + 1
        skip = (acc["total"] >= budget) | ((size > budget) & (F.size(acc["kept"]) > 0))
        return F.struct(F.when(skip, acc["total"]).otherwise(size).alias("total"), F.when(skip, acc["kept"]).otherwise(F.array_append(acc["kept"], F.struct(x["i"].alias("i"), x["p"].alias("p")))).alias("kept"))

    kept = F.array_sort(F.aggregate(ranked, start, take)["kept"])
    focused = F.left(F.array_join(F.transform(kept, lambda k: k["p"]), "\n"), F.lit(budget))
    return F.when(F.length(text) <= budget, text).when(F.size(paragraphs) == 0, F.left(text, F.lit(budget))).otherwise(focused)


def prompt_sources(contexts: DataFrame, chars: int = 4000) -> DataFrame:
    """question_id, prompt: numbered source blocks in order; contexts: question_id, rank, url, text."""
    block = F.concat(F.lit("SOURCE "), (F.col("rank") + 1).cast("string"), F.lit(" ("), F.col("url"), F.lit("):\n"), F.left(F.col("text"), F.lit(chars)))
    blocks = contexts.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return blocks.select("question_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("prompt"))
