"""Replies of search services as tables of hits. The services themselves are called elsewhere; here their JSON is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIKIPEDIA = "struct<query:struct<search:array<struct<title:string,snippet:string>>>>"
SEARXNG = "struct<results:array<struct<url:string,title:string,content:string>>>"
DUCKDUCKGO = "array<struct<href:string,url:string,title:string,body:string>>"


def _hits(replies: DataFrame, items, k: int) -> DataFrame:
    return replies.select("question_id", F.posexplode(items).alias("rank", "hit")).filter(F.col("rank") < k)


def wikipedia_hits(replies: DataFrame, k: int = 6, lang: str = "en") -> DataFrame:
    """question_id, rank, title, url, snippet from replies (question_id, reply); hits without a title go."""
    rows = _hits(replies, F.from_json("reply", WIKIPEDIA)["query"]["search"], k)
    title = F.col("hit.title")
    # url_encode is for forms: a space is already an underscore here, and what may stand in a path is put back
    path = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for code, sign in (("+", "%20"), ("%2F", "/"), ("%7E", "~")):
        path = F.replace(path, F.lit(code), F.lit(sign))
    named = rows.filter(F.coalesce(F.trim(title), F.lit("")) != "")
    return named.select("question_id", "rank", title.alias("title"), F.concat(F.lit(f"https://{lang}.wikipedia.org/wiki/"), path).alias("url"), F.regexp_replace(F.coalesce("hit.snippet", F.lit("")), "<[^>]+>", "").alias("snippet"))


def searxng_hits(replies: DataFrame, k: int = 6) -> DataFrame:
    """The first k results, and of these those with a web address."""
    rows = _hits(replies, F.from_json("reply", SEARXNG)["results"], k).filter(F.col("hit.url").startswith("http"))
    return rows.select("question_id", "rank", F.coalesce("hit.title", F.lit("")).alias("title"), "hit.url", F.coalesce("hit.content", F.lit("")).alias("snippet"))


def duckduckgo_hits(replies: DataFrame, k: int = 6) -> DataFrame:
    rows = _hits(replies, F.from_json("reply", DUCKDUCKGO), k).withColumn("url", F.coalesce("hit.href", "hit.url")).filter(F.col("url").startswith("http"))
    return rows.select("question_id", "rank", F.coalesce("hit.title", F.lit("")).alias("title"), "url", F.coalesce("hit.body", F.lit("")).alias("snippet"))


def combined(lists: list[DataFrame]) -> DataFrame:
    """Hits of several services with list_id; a service that failed is an empty table."""
    tagged = [hits.withColumn("list_id", F.lit(k)) for k, hits in enumerate(lists)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out


def pasted_urls(text: Column) -> Column:
    """Addresses of a pasted list, separated by commas or line ends, trimmed; empty ones go."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\n,]+")
    return F.filter(F.transform(parts, lambda u: F.regexp_replace(u, r"(?U)^\s+|\s+$", "")), lambda u: u != "")


def choose_provider(preferred: str | None = None, searxng_url: str | None = None) -> str:
    """wikipedia if asked for, else searxng if there is an instance, else all combined."""
    if preferred == "wikipedia":
        return "wikipedia"
    return "searxng" if searxng_url else "combined"
