"""From questions and fetched pages to cited claims: the pipelines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestine.functions.anchors import anchor_ladder, proportional_near
from attestine.functions.pages import main_text, visible_text
from attestine.functions.spans import sentence_claims
from attestine.functions.tokens import pinned
from attestine.operators.binder import BinderConfig, bind
from attestine.operators.evaluate import ledger
from attestine.operators.gate import is_ok, is_sentinel, source_pool, source_status
from attestine.operators.ranking import diversify, relevance_rerank, rrf_fuse, top_sources
from attestine.sources.artifacts import digest


@dataclass(frozen=True)
class PipelineConfig:
    """What a production run uses."""

    k_sources: int = 5
    sources_per_claim: int = 3
    brain_source_chars: int = 4000
    sentinel: str = "The sources do not answer this question."
    binder: BinderConfig = field(default_factory=lambda: BinderConfig(tau=0.5, tau_second=0.3))


def search(hits: DataFrame, k: int = 6) -> DataFrame:
    """Fuse, rerank, demote and cap: the k results of each question, final_rank from 0."""
    fused = rrf_fuse(hits).join(hits.groupBy("question_id").agg(F.first("question").alias("question")), "question_id")
    return diversify(relevance_rerank(fused, "fused_rank"), "relevance_rank", k)


def bind_nearest(claims: DataFrame, sources: DataFrame, config: BinderConfig | None = None, k: int = 3) -> DataFrame:
    """Every claim with the first of its k nearest citable sources that supports it where it can be shown, or unverified.

    claim_id, claim, status, source_id, url, cited_span, start, end, entailment, strategy; n_tried, best_entailment and
    best_symbolic_ok tell of the sources tried, also of claims that stay unverified. Only the nearest sources are cut
    into spans; text joins the pairs after the ranking, which works on words alone. Where sources have a `target`, the
    text of their snapshot, a cited span counts only if it can be anchored there; else the next source is tried.
    """
    ok = sources.filter(F.col("verdict") == "OK")
    near = top_sources(claims, ok, k)
    pairs = near.join(ok, "source_id").join(claims.select("claim_id", "claim"), "claim_id")
    target = F.col("target") if "target" in sources.columns else F.lit(None).cast("string")
    bound = bind(pairs.select("claim_id", "claim", "source_id", "source_rank", F.col("url").alias("source_url"), F.col("text").alias("source_text"), "verdict", target.alias("target")), config)
    if "target" in sources.columns:
        shown = bound.withColumn("quote", F.col("cited_span")).withColumn("near", proportional_near(F.col("cited_start"), F.length("source_text"), F.length("target")))
        bound = anchor_ladder(pinned(shown, "near")).withColumn("strategy", F.col("anchor.strategy")).withColumn("stands", F.col("cited") & F.col("anchor").isNotNull())
    else:
        bound = bound.withColumn("strategy", F.lit(None).cast("string")).withColumn("stands", F.col("cited"))
    hit = F.struct("source_rank", "source_id", "source_url", "cited_span", "cited_start", "entailment", "strategy")
    best = bound.groupBy("claim_id").agg(
        F.min(F.when(F.col("stands"), hit)).alias("hit"), F.count(F.lit(1)).alias("n_tried"), F.max(F.struct("entailment", (-F.col("source_rank")).alias("r"), "symbolic_ok")).alias("best")
    )
    return claims.join(best, "claim_id", "left").select(
        "claim_id", "claim", F.when(F.col("hit").isNotNull(), "cited").otherwise("unverified").alias("status"), "hit.source_id", F.col("hit.source_url").alias("url"), "hit.cited_span",
        F.col("hit.cited_start").cast("long").alias("start"), (F.col("hit.cited_start") + F.length("hit.cited_span")).cast("long").alias("end"), F.round("hit.entailment", 6).alias("entailment"), "hit.strategy",
        F.coalesce("n_tried", F.lit(0)).cast("long").alias("n_tried"), F.round("best.entailment", 6).alias("best_entailment"), F.col("best.symbolic_ok").alias("best_symbolic_ok"),
    )


def research(questions: DataFrame, candidates: DataFrame, sources: DataFrame, drafts: DataFrame, config: PipelineConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole run: (claims, ledger). questions (question_id), candidates (question_id, rank, n_urls, source_id), drafts (question_id, draft).

    The pool of a question is cut, a draft that only says that nothing was found makes no claims, the sentences of the
    others are bound to sources of the pools, anchored, and counted: cited, unverified, and sources that were excluded.
    """
    c = config or PipelineConfig()
    pool = source_pool(candidates, c.k_sources).select("source_id").distinct()
    judged = sources.join(pool, "source_id", "left_semi")
    told = drafts.join(questions.select("question_id"), "question_id", "left_semi").filter(~is_sentinel(F.col("draft"), c.sentinel))
    claims = told.select("question_id", F.posexplode(sentence_claims(F.col("draft"))).alias("k", "s"))
    claims = claims.select((F.col("question_id") * 1000 + F.col("k")).alias("claim_id"), F.col("s.text").alias("claim"))
    bound = bind_nearest(claims, judged, c.binder, c.sources_per_claim)
    return bound, ledger(bound, judged.select(source_status(F.col("verdict"), F.col("text")).alias("status")))


def spine(requests: DataFrame, pages: DataFrame, config: BinderConfig | None = None) -> DataFrame:
    """One claim against one page: url, claim, stage, reason, quote, sha256, anchor.

    requests (request_id, url, claim), pages (url, body, verdict). Stages: excluded, no_content, abstained,
    unanchored, cited.
    """
    fetched = requests.join(pages, "url", "left").withColumn("extracted", F.when(is_ok(F.col("verdict")), main_text(F.col("body"))))
    bound = bind(fetched.select("request_id", "url", "claim", "body", F.col("verdict"), F.col("url").alias("source_url"), F.coalesce("extracted", F.lit("")).alias("source_text")), config)
    seen = bound.withColumn("target", F.when(F.col("cited"), visible_text(F.col("body")))).withColumn("near", proportional_near(F.col("cited_start"), F.length("source_text"), F.length("target")))
    anchored = anchor_ladder(seen.withColumn("quote", F.col("cited_span")))
    stage = F.when(~is_ok(F.col("verdict")), "excluded").when(F.col("source_text") == "", "no_content").when(~F.col("cited"), "abstained").when(F.col("anchor").isNull(), "unanchored").otherwise("cited")
    return anchored.select("request_id", "url", "claim", stage.alias("stage"), "cited_span", digest(F.col("body")).alias("sha256"), F.col("anchor.start").alias("anchor_start"), F.col("anchor.end").alias("anchor_end"), F.col("anchor.strategy").alias("strategy"))


def research_report(questions: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """question_id, question, n_claims, n_cited, n_unverified, n_excluded and the claims, nested.

    claims (question_id, claim_id, claim, status, url, cited_span), sources (question_id, status).
    """
    nested = claims.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(F.col("status") == "cited").alias("n_cited"), F.array_sort(F.collect_list(F.struct("claim_id", "claim", "status", "url", "cited_span"))).alias("claims")
    )
    excluded = sources.groupBy("question_id").agg(F.count_if(F.col("status") != "ok").alias("n_excluded"))
    out = questions.join(nested, "question_id", "left").join(excluded, "question_id", "left").fillna(0, ["n_claims", "n_cited", "n_excluded"])
    return out.withColumn("n_unverified", F.col("n_claims") - F.col("n_cited"))


def redirect_chains(starts: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """start, url, n_hops, reason: where each start ends. hops (url, location, safe), one of each url; at most `most` redirects.

    reason: null, 'unsafe', 'loop' or 'too many redirects'. Each hop is one join; a finished chain meets nothing.
    """
    at = starts.select(F.col("url").alias("start"), "url", F.array("url").alias("seen"), F.lit(0).alias("n_hops"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("done"))
    known = hops.select(F.col("url").alias("from"), "location", "safe")
    for k in range(most + 1):
        joined = at.join(known, (F.col("url") == F.col("from")) & ~F.col("done"), "left")
        unsafe = F.coalesce(~F.col("safe"), F.lit(False))
        moves = ~F.col("done") & F.col("location").isNotNull() & ~unsafe
        loop = moves & F.array_contains("seen", F.col("location"))
        over = moves & ~loop & F.lit(k == most)
        go = moves & ~loop & ~over
        at = joined.select(
            "start", F.when(go, F.col("location")).otherwise(F.col("url")).alias("url"), F.when(go, F.array_append("seen", F.col("location"))).otherwise(F.col("seen")).alias("seen"),
            (F.col("n_hops") + go.cast("int")).alias("n_hops"), F.when(~F.col("done") & unsafe, "unsafe").when(loop, "loop").when(over, "too many redirects").otherwise(F.col("reason")).alias("reason"), (~go).alias("done"),
        )
    return at.select("start", "url", "n_hops", "reason")
