"""Binding claims to verbatim spans, or abstaining.

A pair is a claim with one source. Its source is cut into spans, the spans are ranked and scored, and the best one
that passes all gates is cited, all inside the pair's own row: arrays hold the candidates, so binding needs no
shuffle, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestine.functions.spans import candidate_spans, has_leading_anaphor, is_citable_prose, naive_sentences, preceding_context
from attestine.functions.symbolic import with_consistency
from attestine.functions.tokens import content_words, directed_overlap, jaccard, let, pinned, strip, token_set
from attestine.operators.gate import is_ok
from attestine.operators.ranking import prefilter

Scorer = Callable[[Column, Column], Column]


def lexical_score(claim: Column, span: Column) -> Column:
    """Jaccard of the token sets: the stand-in for a model. A model's scorer is a function of two columns, too."""
    return let(token_set(claim), lambda words: let(token_set(span), lambda others: jaccard(words, others)))


def with_scripted(rows: DataFrame, script: DataFrame, out: str, default: Scorer = lexical_score) -> DataFrame:
    """rows (claim, span, ...) with a score: the one that script (claim, span, score) gives for exactly these texts, the highest if it has several, else the default scorer's."""
    known = script.groupBy("claim", "span").agg(F.max("score").alias("_scripted"))
    joined = rows.join(known, ["claim", "span"], "left")
    return joined.withColumn(out, F.coalesce("_scripted", default(F.col("claim"), F.col("span")))).drop("_scripted").select(*rows.columns, out)


def windowed(score: Scorer, words: int = 448, most: int = 24) -> Scorer:
    """A scorer that takes the best score of a claim against each window of `words` words of the span, `most` windows at most (fixed values of the adapter); a short span is one window."""

    def best(claim: Column, span: Column) -> Column:
        tokens = F.split(strip(span), r"(?U)\s+")

        def over(w: Column) -> Column:
            last = F.least(F.size(w), F.lit(words * most))
            windows = F.transform(F.sequence(F.lit(1), last, F.lit(words)), lambda i: F.array_join(F.slice(w, i, words), " "))
            return F.when(F.size(w) <= words, score(claim, span)).otherwise(F.array_max(F.transform(windows, lambda x: score(claim, x))))

        return let(tokens, over)

    return best


def model_scorer(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Scorer:
    """A scorer backed by a model: `load` runs once in each Python worker, so its imports are needed there only, and gives a function of batches of claims and spans."""
    import pandas as pd

    def scored(batches):
        model = load()
        for claims, spans in batches:
            yield pd.Series(model(claims.tolist(), spans.tolist()), dtype="float64")

    udf = F.pandas_udf(scored, "double", F.PandasUDFType.SCALAR_ITER)
    return lambda claim, span: udf(claim, span)


@dataclass(frozen=True)
class BinderConfig:
    """Thresholds: tau of the first score, tau_second of the second; both from 0 to 1."""

    tau: float = 0.7
    tau_second: float = 0.5
    prefilter_k: int = 48
    coref: bool = True
    coref_overlap: float = 0.30
    scorer: Scorer = lexical_score
    second: Scorer | None = None
    symbolic: bool = True

    def __post_init__(self) -> None:
        for name in ("tau", "tau_second"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be in [0, 1]")


def bind(pairs: DataFrame, config: BinderConfig | None = None) -> DataFrame:
    """pairs (pair_id, claim, source_url, source_text, verdict, ...) with cited, abstained, cited_span, cited_start, entailment, symbolic_ok, second_score.

    Exactly one row a pair. An abstaining row carries the score and the consistency of its best candidate.
    """
    c = config or BinderConfig()
    ok = is_ok(F.col("verdict"))
    spans = F.filter(candidate_spans(F.col("source_text")), lambda s: is_citable_prose(s["text"]))
    cut = pairs.withColumn("_spans", F.when(ok & F.col("claim").isNotNull(), spans).otherwise(F.array().cast("array<struct<text:string,start:int,end:int>>")))
    # the default scorer's half that is the same for all spans
    cut = cut.withColumn("_claim_words", content_words(F.col("claim"))).withColumn("_claim_set", token_set(F.col("claim")) if c.scorer is lexical_score else F.lit(None))
    cut = pinned(cut, "_spans", "_claim_words", "_claim_set")
    order = prefilter(F.col("_claim_words"), F.transform("_spans", lambda s: s["text"]), c.prefilter_k)
    ranked = pinned(cut.withColumn("_order", order), "_order")
    ranked = ranked.withColumn("_spans", F.transform("_order", lambda i: F.get(F.col("_spans"), i)))

    def scored_against(text: Column) -> Column:
        return let(token_set(text), lambda others: jaccard(F.col("_claim_set"), others)) if c.scorer is lexical_score else c.scorer(F.col("claim"), text)

    def entailment(span: Column) -> Column:
        score = scored_against(span["text"])
        if not c.coref:
            return score
        context = preceding_context(F.col("source_text"), span["start"])
        gate = (score < c.tau) & (F.size("_claim_words") > 0) & has_leading_anaphor(span["text"]) & (directed_overlap(F.col("_claim_words"), content_words(span["text"])) >= c.coref_overlap)
        return F.when(gate & (context != ""), F.greatest(score, scored_against(F.concat(context, F.lit(" "), span["text"])))).otherwise(score)

    ranked = pinned(ranked, "_spans")
    scored = pinned(ranked.withColumn("_e", F.transform("_spans", entailment)), "_e")
    best = F.array_max("_e")
    # consistency matters for spans over the threshold and for the best one
    asked = let(best, lambda top: F.zip_with("_spans", "_e", lambda s, e: F.when((e >= c.tau) | (e == top), s["text"])))
    if c.symbolic:
        checked = with_consistency(scored.withColumn("_asked", asked), "claim", "_asked", "_ok")
    else:
        checked = scored.withColumn("_ok", F.transform("_e", lambda e: F.lit(True)))
    zipped = F.transform(F.arrays_zip("_e", "_ok", "_spans"), lambda z, i: F.struct((-z["_e"]).alias("e"), i.alias("i"), z["_ok"].alias("ok"), z["_spans"].alias("span")))
    # array_min orders by score, then by rank; the rest of the struct never decides
    checked = pinned(checked.withColumn("_all", zipped), "_all")
    winner = F.array_min(F.filter("_all", lambda z: (-z["e"] >= c.tau) & z["ok"]))
    picked = checked.withColumn("_win", winner).withColumn("_best", F.coalesce("_win", F.array_min("_all")))
    second = F.lit(None).cast("double")
    passes = F.col("_win").isNotNull() & (F.coalesce(strip(F.col("source_url")), F.lit("")) != "")
    if c.second is not None:
        second = F.when(F.col("_win").isNotNull(), c.second(F.col("claim"), F.col("source_text")))
        finite = second.isNotNull() & ~F.isnan(second) & (F.abs(second) != float("inf"))
        passes = passes & finite & (second >= c.tau_second)
    cited = F.coalesce(passes, F.lit(False))
    inner = [x for x in picked.columns if x.startswith("_")]
    return picked.select(
        *[x for x in pairs.columns],
        cited.alias("cited"), (~cited).alias("abstained"), F.when(cited, F.col("_win.span.text")).alias("cited_span"), F.when(cited, F.col("_win.span.start")).alias("cited_start"),
        (-F.col("_best.e")).alias("entailment"), F.col("_best.ok").alias("symbolic_ok"), second.alias("second_score"),
    ).drop(*inner)


def always_abstain(pairs: DataFrame) -> DataFrame:
    """The baseline that never cites."""
    null = F.lit(None)
    return pairs.select("*", F.lit(False).alias("cited"), F.lit(True).alias("abstained"), null.cast("string").alias("cited_span"), null.cast("int").alias("cited_start"), null.cast("double").alias("entailment"), null.cast("boolean").alias("symbolic_ok"), null.cast("double").alias("second_score"))


def lexical_overlap(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The baseline that cites the first best sentence by word overlap, if it reaches the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be in [0, 1]")
    claim = token_set(F.col("claim"))
    scored = F.transform(naive_sentences(F.col("source_text")), lambda s, i: F.struct((-jaccard(claim, token_set(s))).alias("e"), i.alias("i"), s.alias("text")))
    best = F.array_min(F.filter(scored, lambda z: z["e"] < 0))
    picked = pairs.withColumn("_best", F.when(is_ok(F.col("verdict")), best))
    cited = F.coalesce(-F.col("_best.e") >= threshold, F.lit(False))
    return picked.select(
        *pairs.columns, cited.alias("cited"), (~cited).alias("abstained"), F.when(cited, F.col("_best.text")).alias("cited_span"), F.lit(None).cast("int").alias("cited_start"),
        F.when(cited, -F.col("_best.e")).alias("entailment"), F.lit(None).cast("boolean").alias("symbolic_ok"), F.lit(None).cast("double").alias("second_score"),
    )
