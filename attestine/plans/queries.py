"""Every operator as a query over the driver's tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from attestine.functions import anchors, bounds, drafts, pages, receipts, spans, symbolic, tokens
from attestine.functions.lexicon import CONTENT_STOPLIST, DEMOTED_DOMAINS, HEADINGS, LEADING_ANAPHORS, TWO_PART_SUFFIXES
from attestine.operators import binder, decompose, evaluate, gate, ranking, retrieve
from attestine.plans import relations, research, symbolic_sql
from attestine.sources import artifacts, search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL building blocks -----------------------------------------------------------------------------------------

_STOP = "[" + ",".join(f"'{w}'" for w in CONTENT_STOPLIST) + "]"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _content(x: str) -> str:
    return f"list_distinct(list_filter({_tok(x)}, lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)))"


def _jac(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END)"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _spans(name: str, relation: str) -> str:
    """CTEs that end in `name` (id, idx, text, s, e) from `relation` (id, body)."""
    return rf"""
{name}_m AS (SELECT id, string_split(regexp_replace(body, '([.!?]+)((?:\[[^\]]{{1,24}}\])*\s+)', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(2)) AS ps FROM {relation}),
{name}_p AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM {name}_m),
{name}_o AS (SELECT id, pos, string_split(p, chr(1))[1] AS raw,
    coalesce(sum(length(p) - contains(p, chr(1))::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM {name}_p),
{name}_t AS (SELECT id, pos, {_strip('raw')} AS text, o + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS s FROM {name}_o),
{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS idx, text, s::BIGINT AS s, (s + length(text))::BIGINT AS e FROM {name}_t WHERE text <> '')"""


_PROSE = f"""(NOT list_contains([{",".join(f"'{h}'" for h in HEADINGS)}], {_strip("lower(regexp_replace(" + _strip("string_split(text, chr(10))[1]") + ", ':+$|^:+', '', 'g'))")})
    AND NOT regexp_matches(text, '^[-* ]*\\^') AND length(text) - length(replace(text, '|', '')) < 4)"""
_SOURCES = """sources AS (SELECT d.doc_id AS source_id, 'doc://' || d.doc_id AS url, coalesce(d.text, '') AS text,
    CASE WHEN l.toxic IS NULL THEN 'UNVERIFIED' WHEN l.toxic = 1 THEN 'BLOCKED' WHEN l.quality = 0 THEN 'SOFT_404' ELSE 'OK' END AS verdict
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""
_CLAIMS = "bench AS (SELECT item_id AS id, text AS body FROM benchmark)," + _spans("bspan", "bench") + """,
claims AS (SELECT id * 1000 + row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS claim_id, id AS item_id, text AS claim FROM bspan WHERE length(text) >= 25)"""


def _top(name: str, where: str, k: int = 3) -> str:
    """CTEs that end in `name` (claim_id, source_id, matched, source_rank)."""
    return f"""{name}_c AS (SELECT claim_id, unnest(list_distinct({_tok('claim')})) AS word FROM claims),
{name}_s AS (SELECT source_id, unnest(list_distinct({_tok('text')})) AS word FROM sources WHERE {where}),
{name}_n AS (SELECT claim_id, source_id, count(*) AS matched FROM {name}_c JOIN {name}_s USING (word) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY matched DESC, source_id) AS source_rank FROM {name}_n QUALIFY source_rank <= {k})"""


_HITS = f"""items AS (SELECT item_id AS claim_id, text AS claim FROM benchmark),
hw AS (SELECT claim_id, unnest(list_distinct({_tok('claim')})) AS word FROM items),
hd AS (SELECT doc_id AS source_id, unnest(list_distinct({_tok('text')})) AS word FROM documents),
hn AS (SELECT claim_id, source_id, count(*) AS matched FROM hw JOIN hd USING (word) GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY matched DESC, source_id) AS source_rank FROM hn QUALIFY source_rank <= 20),
hs AS (SELECT r.claim_id AS question_id, r.source_rank, r.source_id, d.n_chars, substr(d.text, 1, 40) AS title,
    'https://' || d.source || (CASE WHEN d.doc_id % 7 = 0 THEN '.youtube.com/' ELSE '.example.co.uk/' END) || d.doc_id AS url, substr(d.text, 41, 160) AS snippet
    FROM hr r JOIN documents d ON d.doc_id = r.source_id),
hits AS (SELECT x.*, i.claim AS question FROM (
    SELECT question_id, 0 AS list_id, source_rank - 1 AS rank, title, url, snippet FROM hs
    UNION ALL SELECT question_id, 1, row_number() OVER (PARTITION BY question_id ORDER BY n_chars DESC, source_id) - 1, title, url, snippet FROM hs) x
    JOIN items i ON i.claim_id = x.question_id)"""
_FUSED = """fz AS (SELECT question_id, url, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min(list_id * 1000 + rank) AS first_seen, min(title) AS title, min(snippet) AS snippet, min(question) AS question FROM hits GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, first_seen) - 1 AS fused_rank FROM fz)"""
_RERANKED = f"""rw AS (SELECT question_id, url, fused_rank, {_content('question')} AS q, {_content("title || ' ' || snippet")} AS d, count(*) OVER (PARTITION BY question_id) AS n FROM fused),
rx AS (SELECT question_id, url, n, unnest(list_intersect(q, d)) AS word FROM rw),
ry AS (SELECT question_id, url, ln(1 + n / (1 + count(*) OVER (PARTITION BY question_id, word))) AS w FROM rx),
rs AS (SELECT question_id, url, round(sum(w), 6) AS s FROM ry GROUP BY ALL),
reranked AS (SELECT f.*, coalesce(s, 0) AS idf_score, row_number() OVER (PARTITION BY f.question_id ORDER BY coalesce(s, 0) DESC, f.fused_rank) - 1 AS relevance_rank FROM fused f LEFT JOIN rs USING (question_id, url))"""


def _domain(url: str) -> str:
    host = rf"regexp_extract(lower({url}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"
    labels = f"string_split({host}, '.')"
    two = f"array_to_string({labels}[-2:], '.')"
    suffixes = ",".join(f"'{s}'" for s in TWO_PART_SUFFIXES)
    return f"(CASE WHEN len({labels}) < 3 OR regexp_matches({host}, '^[0-9.]+$') THEN {host} WHEN {two} IN ({suffixes}) THEN array_to_string({labels}[-3:], '.') ELSE {two} END)"


_CAPPED = f"""dm AS (SELECT *, {_domain('url')} AS domain FROM reranked),
dd AS (SELECT *, domain IN ({",".join(f"'{d}'" for d in DEMOTED_DOMAINS)}) AS demoted FROM dm WHERE domain <> 'grokipedia.com'),
dc AS (SELECT *, row_number() OVER (PARTITION BY question_id, domain ORDER BY demoted, relevance_rank) AS own FROM dd QUALIFY own <= 2),
capped AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY demoted, relevance_rank) - 1 AS final_rank FROM dc QUALIFY final_rank < 6)"""


# --- tokens and spans ----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({_tok('text')}) AS n_tokens, md5(array_to_string({_tok('text')}, ' ')) AS digest FROM documents")
def word_tokens(spark, d):
    t = tokens.word_tokens(F.col("text"))
    return relations.read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, array_to_string(list_sort({_content('text')}), ' ') AS words FROM documents")
def content_words(spark, d):
    return relations.read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(tokens.content_words(F.col("text"))), " ").alias("words"))


_LEX = f"WITH {_SOURCES}, {_CLAIMS}, {_top('top', 'TRUE')}, lx AS (SELECT t.claim_id, t.source_id, list_distinct({_tok('c.claim')}) AS a, list_distinct({_tok('s.text')}) AS b FROM top t JOIN claims c USING (claim_id) JOIN sources s USING (source_id)) "


def _nearest(spark, d):
    c, s = relations.claims(spark, d), relations.sources(spark, d)
    return ranking.top_sources(c, s).join(s, "source_id").join(c, "claim_id")


@query(_LEX + f"SELECT claim_id, source_id, round({_jac('a', 'b')}, 6) AS jaccard FROM lx")
def jaccard_claim_source(spark, d):
    return _nearest(spark, d).select("claim_id", "source_id", F.round(tokens.jaccard(tokens.token_set(F.col("claim")), tokens.token_set(F.col("text"))), 6).alias("jaccard"))


@query(_LEX + "SELECT claim_id, source_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 6) AS overlap FROM lx")
def directed_overlap(spark, d):
    return _nearest(spark, d).select("claim_id", "source_id", F.round(tokens.directed_overlap(tokens.token_set(F.col("claim")), tokens.token_set(F.col("text"))), 6).alias("overlap"))


@query(f"WITH {_SOURCES}, {_CLAIMS}, {_top('top', 'TRUE')} SELECT claim_id, source_id, matched, source_rank FROM top")
def top3_sources(spark, d):
    return ranking.top_sources(relations.claims(spark, d), relations.sources(spark, d)).select("claim_id", "source_id", "matched", F.col("source_rank").cast("long").alias("source_rank"))


_DOCS = "docs AS (SELECT doc_id AS id, coalesce(text, '') AS body FROM documents),"


@query(f"WITH {_DOCS} {_spans('sp', 'docs')} SELECT id AS doc_id, idx AS span_idx, text AS span, s AS start, e AS \"end\" FROM sp")
def candidate_spans(spark, d):
    rows = relations.read(spark, d, "documents").select("doc_id", F.posexplode(spans.candidate_spans(F.coalesce("text", F.lit("")))).alias("k", "s"))
    return rows.select("doc_id", F.col("k").cast("long").alias("span_idx"), F.col("s.text").alias("span"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query(f"WITH {_CLAIMS} SELECT claim_id, item_id, claim FROM claims")
def sentence_claims(spark, d):
    return relations.claims(spark, d)


@query(f"WITH {_DOCS} {_spans('sp', 'docs')} SELECT id AS doc_id, count(*) AS n_spans, count_if({_PROSE})::BIGINT AS n_prose FROM sp GROUP BY 1")
def citable_prose(spark, d):
    found = spans.candidate_spans(F.coalesce("text", F.lit("")))
    prose = F.filter(found, lambda s: spans.is_citable_prose(s["text"]))
    return relations.read(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_spans"), F.size(prose).cast("long").alias("n_prose")).filter("n_spans > 0")


@query(f"WITH {_DOCS} {_spans('sp', 'docs')} SELECT id AS doc_id, count_if(regexp_matches(lower(text), '^(?:{'|'.join(LEADING_ANAPHORS)})\\b'))::BIGINT AS n_anaphors FROM sp GROUP BY 1")
def leading_anaphor(spark, d):
    found = spans.candidate_spans(F.coalesce("text", F.lit("")))
    return relations.read(spark, d, "documents").select("doc_id", F.size(found).alias("n"), F.size(F.filter(found, lambda s: spans.has_leading_anaphor(s["text"]))).cast("long").alias("n_anaphors")).filter("n > 0").drop("n")


@query(rf"""WITH {_DOCS} m AS (SELECT id, string_split(regexp_replace({_strip('body')}, '([.!?])(\s+)', '\1' || chr(2), 'g'), chr(2)) AS ps FROM docs)
SELECT id AS doc_id, len(list_filter(ps, lambda x: x <> '')) AS n_sentences, md5(array_to_string(list_filter(ps, lambda x: x <> ''), chr(10))) AS digest FROM m""")
def naive_split(spark, d):
    s = spans.naive_sentences(F.coalesce("text", F.lit("")))
    return relations.read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\n").cast("binary")).alias("digest"))


_CTX = r"CASE WHEN s > 320 THEN regexp_replace(substr(body, s - 319, 320), '(?s)^.*?[.!?]\s+(.*)$', '\1') ELSE substr(body, 1, s) END"


@query(f"WITH {_DOCS} {_spans('sp', 'docs')} SELECT id AS doc_id, idx AS span_idx, md5({_strip(_CTX)}) AS context FROM sp JOIN docs USING (id)")
def preceding_context(spark, d):
    rows = relations.read(spark, d, "documents").select("doc_id", "text", F.posexplode(spans.candidate_spans(F.coalesce("text", F.lit("")))).alias("k", "s"))
    return rows.select("doc_id", F.col("k").cast("long").alias("span_idx"), F.md5(spans.preceding_context(F.col("text"), F.col("s.start")).cast("binary")).alias("context"))


_LOC = f"WITH {_SOURCES}, {_CLAIMS}, {_top('top', 'TRUE')}, lo AS (SELECT t.claim_id, t.source_id, c.claim AS q, s.text AS page, length(s.text) // 2 AS near FROM top t JOIN claims c USING (claim_id) JOIN sources s USING (source_id)) "


def _located(spark, d):
    return _nearest(spark, d).select("claim_id", "source_id", F.col("claim").alias("q"), F.col("text").alias("page"), (F.length("text") / 2).cast("int").alias("near"))


@query(_LOC + """, oc AS (SELECT claim_id, source_id, near, unnest(list_filter(range(0, length(page) - length(q) + 1), lambda i: substr(page, (i + 1)::BIGINT, length(q)) = q)) AS p FROM lo WHERE contains(page, q))
SELECT claim_id, source_id, min_by(p, abs(p - near) * 1000000 + p) AS start FROM oc GROUP BY 1, 2""")
def find_anchor_near(spark, d):
    place = spans.nearest(spans.occurrences(F.col("q"), F.col("page")), F.col("near"))
    return _located(spark, d).select("claim_id", "source_id", place.cast("long").alias("start")).filter("start IS NOT NULL")


@query(_LOC + "SELECT claim_id, source_id, length(q) > 0 AND strpos(page, q) > 0 AND strpos(substr(page, strpos(page, q) + 1), q) = 0 AS is_unique FROM lo")
def unique_locatable(spark, d):
    return _located(spark, d).select("claim_id", "source_id", spans.is_unique_in(F.col("q"), F.col("page")).alias("is_unique"))


# --- gates -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_SOURCES} SELECT source_id, url FROM sources WHERE verdict = 'OK'")
def cite_gate(spark, d):
    return gate.cite_gate(relations.sources(spark, d)).select("source_id", "url")


@query(f"WITH {_SOURCES} SELECT verdict, CASE WHEN verdict <> 'OK' THEN 'excluded' WHEN text = '' THEN 'no_content' ELSE 'ok' END AS status, count(*) AS n FROM sources GROUP BY ALL")
def source_status(spark, d):
    return relations.sources(spark, d).withColumn("status", gate.source_status(F.col("verdict"), F.col("text"))).groupBy("verdict", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT url, CASE WHEN page_id % 5 = 0 AND page_id % 10 = 0 THEN 'OK' WHEN page_id % 5 = 0 THEN 'EMPTY_SHELL' ELSE 'OK' END AS verdict, CASE WHEN page_id % 10 = 0 THEN 'rendered' ELSE 'direct' END AS tactic FROM pages")
def escalate_shells(spark, d):
    p = relations.read(spark, d, "pages")
    fetches = p.select("page_id", "url", F.when(F.col("page_id") % 5 == 0, "EMPTY_SHELL").otherwise("OK").alias("verdict"), F.col("html").alias("body"), F.lit("direct").alias("tactic"))
    rendered = p.filter("page_id % 10 = 0").select("page_id", F.lit("OK").alias("verdict"), F.col("html").alias("body"))
    return gate.acquire(fetches, rendered, "page_id").select("url", "verdict", "tactic")


# --- ranking ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_HITS}, {_FUSED} SELECT question_id, url, fused_rank FROM fused")
def rrf_fuse(spark, d):
    return ranking.rrf_fuse(relations.search_hits(spark, d)).select("question_id", "url", F.col("fused_rank").cast("long").alias("fused_rank"))


def _fused(spark, d):
    hits = relations.search_hits(spark, d)
    return ranking.rrf_fuse(hits).join(hits.select("question_id", "question").distinct(), "question_id")


@query(f"WITH {_HITS}, {_FUSED}, {_RERANKED} SELECT question_id, url, idf_score, relevance_rank FROM reranked")
def relevance_rerank(spark, d):
    return ranking.relevance_rerank(_fused(spark, d), "fused_rank").select("question_id", "url", "idf_score", F.col("relevance_rank").cast("long").alias("relevance_rank"))


@query(f"WITH {_HITS}, {_FUSED}, {_RERANKED} SELECT question_id, url, idf_score FROM reranked")
def idf_overlap(spark, d):
    return ranking.relevance_rerank(_fused(spark, d), "fused_rank").select("question_id", "url", "idf_score")


@query(f"WITH {_HITS}, {_FUSED}, {_RERANKED}, {_CAPPED} SELECT question_id, url, domain, demoted, final_rank FROM capped")
def search_pipeline(spark, d):
    return research.search(relations.search_hits(spark, d)).select("question_id", "url", "domain", "demoted", F.col("final_rank").cast("long").alias("final_rank"))


@query(f"SELECT page_id, {_domain('url')} AS domain FROM pages")
def registrable_domain(spark, d):
    return relations.read(spark, d, "pages").select("page_id", ranking.registrable_domain(F.col("url")).alias("domain"))


@query()
def query_variants(spark, d):
    question = F.concat(F.lit("Who is Dr "), F.initcap(F.substring_index("text", " ", 2)), F.lit(" of the Great Northern Railway?"))
    return relations.read(spark, d, "benchmark").select("item_id", F.posexplode(ranking.query_variants(question)).alias("k", "variant"))


_POOL = f"""WITH {_SOURCES}, {_CLAIMS}, {_top('top', "verdict = 'OK'")}, {{pair}} AS (SELECT t.claim_id * 10 + t.source_rank AS id, s.text AS body FROM top t JOIN sources s USING (source_id)), {_spans('sp', 'pr')},
pool AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS i, text, {_content('text')} AS w, count(*) OVER (PARTITION BY id) AS n FROM sp WHERE {_PROSE}),
cw AS (SELECT t.claim_id * 10 + t.source_rank AS id, {_content('c.claim')} AS q FROM top t JOIN claims c USING (claim_id)),
ex AS (SELECT p.id, p.i, p.n, unnest(list_intersect(q, w)) AS word FROM pool p JOIN cw USING (id)),
wt AS (SELECT id, i, ln(1 + n / (1 + count(*) OVER (PARTITION BY id, word))) AS x FROM ex),
sc AS (SELECT id, i, round(sum(x), 6) AS s FROM wt GROUP BY ALL),
rk AS (SELECT p.id, p.i, CASE WHEN n <= 48 OR len(q) = 0 THEN p.i ELSE row_number() OVER (PARTITION BY p.id ORDER BY coalesce(s, 0) DESC, p.i) - 1 END AS rank FROM pool p JOIN cw USING (id) LEFT JOIN sc ON sc.id = p.id AND sc.i = p.i)
SELECT id AS pair_id, rank, i AS candidate FROM rk WHERE rank < 48""".replace("{pair}", "pr")


@query(_POOL)
def prefilter_topk(spark, d):
    c, s = relations.claims(spark, d), relations.ok_sources(spark, d)
    near = ranking.top_sources(c, s).join(s, "source_id").join(c, "claim_id").select((F.col("claim_id") * 10 + F.col("source_rank")).alias("pair_id"), "claim", "text")
    texts = F.transform(F.filter(spans.candidate_spans(F.col("text")), lambda x: spans.is_citable_prose(x["text"])), lambda x: x["text"])
    rows = tokens.pinned(near.withColumn("texts", texts).withColumn("words", tokens.content_words(F.col("claim"))), "texts", "words").select("pair_id", F.posexplode(ranking.prefilter(F.col("words"), F.col("texts"))).alias("rank", "candidate"))
    return rows.select("pair_id", F.col("rank").cast("long").alias("rank"), F.col("candidate").cast("long").alias("candidate"))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.vec_id AS query_id, e.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS rank
FROM q, embeddings e QUALIFY rank <= 5""")
def cosine_topk(spark, d):
    e = relations.read(spark, d, "embeddings")
    top = ranking.cosine_topk(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")))
    return top.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 500")
def fifo_cap(spark, d):
    return ranking.fifo_cap(relations.read(spark, d, "events").select("event_id", "user_id"), "event_id", 500)


@query(_LEX + f""", sc AS (SELECT claim_id, source_id, round({_jac('a', 'b')}, 6) AS score FROM lx),
pl AS (SELECT *, max(score) OVER (PARTITION BY claim_id) AS top_score, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, source_id DESC) AS place FROM sc)
SELECT claim_id, source_id, score FROM pl WHERE top_score < 0.2 OR place = 1""")
def prune_minimal(spark, d):
    scored = _nearest(spark, d).select("claim_id", "source_id", F.round(tokens.jaccard(tokens.token_set(F.col("claim")), tokens.token_set(F.col("text"))), 6).alias("score"))
    cited = scored.select("claim_id", "source_id", "score", F.col("source_id").alias("pos"), F.lit("").alias("span_text"), F.lit("").alias("source_url"))
    return ranking.prune(cited, 0.2).select("claim_id", "source_id", "score")


# --- symbolic --------------------------------------------------------------------------------------------------------

def _picked(some, step: int) -> str:
    return f"{symbolic_sql.texts(some)}[fact_id // {step} % {len(some)} + 1]" if isinstance(some[0], str) else f"[{', '.join(map(str, some))}][fact_id // {step} % {len(some)} + 1]"


def _told(first: str, step: int) -> str:
    rest = " ".join(f"WHEN {k} THEN 'Order ' || fact_id || ': ' || {_picked(some, step)} || '.'" for k, some in ((1, relations.ACTS), (2, relations.MOVES), (3, relations.AMOUNTS)))
    return f"CASE fact_id % 4 WHEN 0 THEN {first} {rest} END"


_H, _N = relations.HEDGES, relations.SHIFTS
_FACTS = f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS fact_id, l_quantity::INT AS q, year(l_shipdate) AS y, monthname(l_shipdate) AS month, day(l_shipdate) AS d, trunc(l_discount * 100)::INT AS p FROM lineitem),
facts AS (SELECT fact_id, (fact_id % 4)::INT AS kind,
{_told(f"'Order ' || fact_id || ' shipped ' || {_picked(_H, 7)} || q || ' units in ' || y || ', on ' || month || ' ' || d || ', at ' || p || '%, see table ' || p || '.'", 4)} AS claim,
{_told(f"""'Order ' || fact_id || ' shipped ' || {_picked(_H, 5)} || (q + {_picked(_N, 13)}) || {_picked((' units in ', ' units of ', ' units, in a set of '), 17)} || (y + {_picked(_N, 19)}) || ', on '
  || (CASE WHEN fact_id // 3 % 2 = 0 THEN month || ' ' || d ELSE ((d + {_picked(_N, 11)}) % 28 + 1) || ' ' || month END) || ', at ' || {_picked(_H, 23)} || (p + {_picked(_N, 29)}) || {_picked(('.0', '.4', ''), 31)}
  || {_picked(('%', ' percent', ' points'), 37)} || ', see ' || {_picked(('table ', 'page '), 41)} || (p + {_picked(_N, 43)}) || '.'""", 32)} AS span FROM r)"""


def _rule(name: str) -> None:
    """A query for one rule: all pairs, and whether it fires."""

    def run(spark, d):
        f = relations.facts(spark, d)
        return f.select("fact_id", "kind", (F.size(symbolic.contradiction_messages(F.col("claim"), F.col("span"), [name])) > 0).alias("fires"))

    QUERIES[name] = run
    SQL[name] = f"{_FACTS}, {symbolic_sql.judged('facts', 'j', 'fact_id, kind', [name])} SELECT fact_id, kind, {name} AS fires FROM j"


for _name in symbolic.RULES:
    _rule(_name)

_ANY = " OR ".join(symbolic.RULES)


@query(f"{_FACTS}, {symbolic_sql.judged('facts', 'j', 'fact_id, kind')} SELECT fact_id, kind, NOT ({_ANY}) AS consistent FROM j")
def symbolic_consistency(spark, d):
    f = relations.facts(spark, d)
    return f.select("fact_id", "kind", (F.size(symbolic.contradiction_messages(F.col("claim"), F.col("span"))) == 0).alias("consistent"))


_KINDS = {"percentage": "percent_mismatch", "quantity": "unit_mismatch", "year": "year_mismatch", "day of": "date_mismatch", "number of": "index_mismatch", "negation": "negation_flip", "direction": "direction_flip", "quantifier": "quantifier_flip"}


@query(f"{_FACTS}, {symbolic_sql.judged('facts', 'j', 'fact_id')} " + " UNION ".join(f"SELECT fact_id, '{what}' AS what FROM j WHERE {name}" for what, name in _KINDS.items()))
def symbolic_messages(spark, d):
    f = relations.facts(spark, d)
    said = f.select("fact_id", F.explode(symbolic.contradiction_messages(F.col("claim"), F.col("span"))).alias("message"))
    return said.select("fact_id", F.regexp_extract("message", f"^({'|'.join(_KINDS)})", 1).alias("what")).distinct()


# --- binding ---------------------------------------------------------------------------------------------------------

_SECOND = "shipped, studies agreed, and exports or pain are as told."


@query(f"""{_FACTS}, {symbolic_sql.judged('facts', 'j', 'fact_id, claim, span')},
two AS (SELECT fact_id, claim, span AS first_span, NOT ({_ANY}) AS first_ok, 'Order ' || fact_id || ' {_SECOND}' AS span FROM j),
{symbolic_sql.judged('two', 'k', 'fact_id, claim, first_span, first_ok, span')},
e AS (SELECT fact_id, first_span, first_ok, span, NOT ({_ANY}) AS ok, {_jac(f"list_distinct({_tok('claim')})", f"list_distinct({_tok('first_span')})")} AS e1, {_jac(f"list_distinct({_tok('claim')})", f"list_distinct({_tok('span')})")} AS e2 FROM k),
w AS (SELECT *, CASE WHEN first_ok AND e1 >= 0.3 AND (e1 >= e2 OR NOT ok OR e2 < 0.3) THEN 1 WHEN ok AND e2 >= 0.3 THEN 2 ELSE 0 END AS win FROM e)
SELECT fact_id, win > 0 AS cited, CASE win WHEN 1 THEN first_span WHEN 2 THEN span END AS cited_span, round(CASE win WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE greatest(e1, e2) END, 6) AS entailment,
CASE win WHEN 0 THEN (CASE WHEN e1 >= e2 THEN first_ok ELSE ok END) ELSE TRUE END AS symbolic_ok FROM w""")
def bind_contradicted(spark, d):
    """Sources whose nearest sentence often contradicts the claim: the gate decides, and abstaining rows keep its verdict."""
    f = relations.facts(spark, d)
    text = F.concat("span", F.lit(" Order "), F.col("fact_id").cast("string"), F.lit(" " + _SECOND))
    pairs = f.select("fact_id", "claim", F.lit("u").alias("source_url"), text.alias("source_text"), F.lit("OK").alias("verdict"))
    bound = binder.bind(pairs, binder.BinderConfig(tau=0.3, coref=False))
    return bound.select("fact_id", "cited", "cited_span", F.round("entailment", 6).alias("entailment"), "symbolic_ok")


# the oracle leaves out the consistency check: no benchmark sentence and its best span contradict each other
_BIND = _POOL.split("SELECT id AS pair_id")[0].rstrip() + f""",
cand AS (SELECT r.id, r.rank, p.text FROM rk r JOIN pool p ON p.id = r.id AND p.i = r.i WHERE r.rank < 48),
cl AS (SELECT t.claim_id * 10 + t.source_rank AS id, t.claim_id, t.source_rank, t.source_id, c.claim FROM top t JOIN claims c USING (claim_id)),
se AS (SELECT cl.*, cand.rank, cand.text, {_jac(f"list_distinct({_tok('cl.claim')})", f"list_distinct({_tok('cand.text')})")} AS e FROM cl JOIN cand USING (id)),
bp AS (SELECT * FROM se WHERE e >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY e DESC, rank) = 1),
bc AS (SELECT * FROM bp QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY source_rank) = 1)
SELECT c.claim_id, c.claim, CASE WHEN b.claim_id IS NULL THEN 'unverified' ELSE 'cited' END AS status, b.source_id, 'doc://' || b.source_id AS url, b.text AS cited_span, round(b.e, 6) AS entailment
FROM claims c LEFT JOIN bc b USING (claim_id)"""


@query(_BIND)
def bind_claims(spark, d):
    config = binder.BinderConfig(tau=0.5, coref=False)
    bound = research.bind_nearest(relations.claims(spark, d), relations.ok_sources(spark, d), config)
    return bound.select("claim_id", "claim", "status", "source_id", "url", "cited_span", "entailment")


_SHOWN = "CASE WHEN b.source_id % 3 = 0 THEN left(s.text, 1) ELSE s.text END"


@query(_BIND.split("bc AS (")[0] + f"""bs AS (SELECT b.* FROM bp b JOIN sources s USING (source_id) WHERE contains({_SHOWN}, b.text)),
bc AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY source_rank) = 1),
bb AS (SELECT claim_id, max(e) AS best FROM se GROUP BY 1), nt AS (SELECT claim_id, count(*) AS n_tried FROM top GROUP BY 1)
SELECT c.claim_id, CASE WHEN b.claim_id IS NULL THEN 'unverified' ELSE 'cited' END AS status, b.source_id, b.text AS cited_span, CASE WHEN b.claim_id IS NOT NULL THEN 'exact' END AS strategy,
coalesce(n_tried, 0) AS n_tried, round(best, 6) AS best_entailment FROM claims c LEFT JOIN bc b USING (claim_id) LEFT JOIN bb USING (claim_id) LEFT JOIN nt USING (claim_id)""")
def research_run(spark, d):
    """A third of the sources has a snapshot that holds next to nothing: what they support can't be anchored, so the next source is taken."""
    shown = relations.ok_sources(spark, d).withColumn("target", F.when(F.col("source_id") % 3 == 0, F.left("text", F.lit(1))).otherwise(F.col("text")))
    items = relations.read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("draft"))
    pool = shown.select(F.lit(0).alias("question_id"), F.lit(0).alias("rank"), F.lit(1).alias("n_urls"), "source_id")
    config = research.PipelineConfig(binder=binder.BinderConfig(tau=0.5, coref=False))
    bound, _ = research.research(items, pool, shown, items, config)
    return bound.select("claim_id", "status", "source_id", "cited_span", "strategy", "n_tried", "best_entailment")


@query(f"""{_FACTS}, e AS (SELECT fact_id, claim, span, {_jac(f"list_distinct({_tok('claim')})", f"list_distinct({_tok('span')})")} AS j FROM facts),
k AS (SELECT claim, span, max((fact_id % 10) / 10.0) AS s FROM facts WHERE fact_id % 5 = 0 GROUP BY ALL)
SELECT fact_id, round(coalesce(s, j), 6) AS score FROM e LEFT JOIN k USING (claim, span)""")
def scripted_scores(spark, d):
    f = relations.facts(spark, d)
    script = f.filter("fact_id % 5 = 0").select("claim", "span", (F.col("fact_id") % 10 / 10.0).alias("score"))
    return binder.with_scripted(f.select("fact_id", "claim", "span"), script, "score").select("fact_id", F.round("score", 6).alias("score"))


@query(rf"""WITH {_SOURCES}, {_CLAIMS}, {_top('top', "TRUE")}, w AS (SELECT t.claim_id, t.source_id, c.claim, regexp_split_to_array({_strip('s.text')}, '\s+') AS ws, s.text FROM top t JOIN claims c USING (claim_id) JOIN sources s USING (source_id)),
u AS (SELECT claim_id, source_id, claim, unnest(CASE WHEN len(ws) <= 40 THEN [text] ELSE list_transform(range(0, least(len(ws), 960), 40), lambda i: array_to_string(ws[i + 1 : i + 40], ' ')) END) AS x FROM w)
SELECT claim_id, source_id, round(max({_jac(f"list_distinct({_tok('claim')})", f"list_distinct({_tok('x')})")}), 6) AS score FROM u GROUP BY ALL""")
def windowed_scores(spark, d):
    score = binder.windowed(binder.lexical_score, words=40, most=24)
    return _nearest(spark, d).select("claim_id", "source_id", F.round(score(F.col("claim"), F.col("text")), 6).alias("score"))


@query()
def bind_coref_second_signal(spark, d):
    config = binder.BinderConfig(tau=0.5, tau_second=0.02, second=binder.lexical_score)
    return research.bind_nearest(relations.claims(spark, d), relations.ok_sources(spark, d), config)


_LABELLED = f"""WITH {_SOURCES}, {_CLAIMS}, {_top('top', 'TRUE')}, lab AS (SELECT t.claim_id * 10 + t.source_rank AS pair_id, c.claim, s.url AS source_url, s.text AS source_text, s.verdict, contains(s.text, c.claim) AS entailed, t.matched
  FROM top t JOIN claims c USING (claim_id) JOIN sources s USING (source_id)),
pairs AS (SELECT *, entailed AND verdict = 'OK' AS answerable, CASE WHEN entailed AND verdict = 'OK' THEN 'clean_entailed' WHEN entailed THEN 'answerable_hard' WHEN matched > 10 THEN 'near_miss_paraphrase' ELSE 'clean_not_entailed' END AS bucket FROM lab),
sent AS (SELECT pair_id, claim, unnest(string_split(regexp_replace({_strip('source_text')}, '([.!?])(\\s+)', '\\1' || chr(2), 'g'), chr(2))) AS s, generate_subscripts(string_split(regexp_replace({_strip('source_text')}, '([.!?])(\\s+)', '\\1' || chr(2), 'g'), chr(2)), 1) AS i FROM pairs WHERE verdict = 'OK'),
sj AS (SELECT pair_id, s, i, {_jac(f"list_distinct({_tok('claim')})", f"list_distinct({_tok('s')})")} AS j FROM sent WHERE s <> ''),
best AS (SELECT * FROM sj WHERE j >= 0.3 QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY j DESC, i) = 1),
outs AS (SELECT p.*, b.s AS cited_span, b.j IS NOT NULL AS cited FROM pairs p LEFT JOIN best b USING (pair_id)) """


@query(_LABELLED + "SELECT pair_id, cited, NOT cited AS abstained, cited_span FROM outs")
def lexical_overlap_binder(spark, d):
    return evaluate.check_outputs(binder.lexical_overlap(relations.labelled(spark, d), 0.3)).select("pair_id", "cited", "abstained", "cited_span")


@query(_LABELLED + "SELECT pair_id, FALSE AS cited, TRUE AS abstained FROM pairs")
def always_abstain(spark, d):
    return binder.always_abstain(relations.labelled(spark, d)).select("pair_id", "cited", "abstained")


_COUNTS = """count(*) AS n, count_if(cited)::BIGINT AS cited, count_if(cited AND entailed AND verdict = 'OK')::BIGINT AS correct, count_if(answerable)::BIGINT AS answerable,
count_if(answerable AND cited)::BIGINT AS answerable_correct, count_if(NOT cited)::BIGINT AS abstained, count_if(cited AND verdict <> 'OK')::BIGINT AS violations"""


@query(_LABELLED + f""", c AS (SELECT CASE WHEN grouping_id(bucket) = 1 THEN 'pooled' ELSE bucket END AS bucket, {_COUNTS} FROM outs GROUP BY ROLLUP (bucket))
SELECT *, coalesce(round(correct / nullif(cited, 0), 6), 0) AS precision, coalesce(round(answerable_correct / nullif(answerable, 0), 6), 0) AS recall FROM c""")
def bucket_report(spark, d):
    r = evaluate.report(binder.lexical_overlap(relations.labelled(spark, d), 0.3))
    return r.select("bucket", "n", "cited", "correct", "answerable", "answerable_correct", "abstained", "violations", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query()
def report_bounds(spark, d):
    return evaluate.report(binder.lexical_overlap(relations.labelled(spark, d), 0.3)).select("bucket", "precision_lower", "false_ok_upper")


@query("SELECT q AS n, round(pow(0.1, 1.0 / q), 9) AS lower_all, 0.0::DOUBLE AS lower_none, round(1 - pow(0.1, 1.0 / q), 9) AS upper_none FROM (SELECT DISTINCT l_quantity::BIGINT AS q FROM lineitem)")
def clopper_pearson(spark, d):
    n = relations.read(spark, d, "lineitem").select(F.col("l_quantity").cast("long").alias("n")).distinct()
    b = lambda x, upper=False: F.round(bounds.bound(x, F.col("n"), 0.10, upper), 9)
    return n.select("n", b(F.col("n")).alias("lower_all"), b(F.lit(0)).alias("lower_none"), b(F.lit(0), True).alias("upper_none"))


@query(_LABELLED + "SELECT count_if(cited AND verdict <> 'OK')::BIGINT AS violations, count_if(cited)::BIGINT AS cited FROM (SELECT verdict, TRUE AS cited FROM pairs)")
def cite_gate_violations(spark, d):
    adversary = relations.labelled(spark, d).withColumn("cited", F.lit(True))
    return adversary.agg(F.count_if(F.col("cited") & ~gate.is_ok(F.col("verdict"))).alias("violations"), F.count_if("cited").alias("cited"))


@query(_BIND.replace("SELECT c.claim_id, c.claim,", "SELECT count_if(status = 'cited')::BIGINT AS cited, count_if(status <> 'cited')::BIGINT AS unverified, (SELECT count(*) FROM sources WHERE verdict <> 'OK' OR text = '') AS excluded FROM (SELECT c.claim_id, c.claim,", 1) + ")")
def ledger(spark, d):
    s = relations.sources(spark, d).select(gate.source_status(F.col("verdict"), F.col("text")).alias("status"))
    return evaluate.ledger(bind_claims(spark, d), s)


# --- retrieval -------------------------------------------------------------------------------------------------------


def _retrieved(spark, d):
    return retrieve.retrieve_spans(relations.claims(spark, d), relations.ok_sources(spark, d), 5, dim=256, digest="md5")


def _bucket(w: str) -> str:
    return f"('0x' || substr(md5({w}), 15, 2))::INTEGER"


_RETRIEVED = rf"""WITH {_SOURCES}, {_CLAIMS}, okd AS (SELECT source_id AS id, text AS body FROM sources WHERE verdict = 'OK'), {_spans('osp', 'okd')},
qb AS (SELECT claim_id, {_bucket('w')} AS b, count(*) AS n FROM (SELECT claim_id, unnest({_tok('claim')}) AS w FROM claims) GROUP BY ALL),
ib AS (SELECT id, idx, {_bucket('w')} AS b, count(*) AS n FROM (SELECT id, idx, unnest({_tok('text')}) AS w FROM osp) GROUP BY ALL),
ql AS (SELECT claim_id, sqrt(sum(n * n)) AS l FROM qb GROUP BY ALL),
il AS (SELECT id, idx, sqrt(sum(n * n)) AS l FROM ib GROUP BY ALL),
dt AS (SELECT claim_id, id, idx, sum(qb.n * ib.n) AS p FROM qb JOIN ib USING (b) GROUP BY ALL),
cs AS (SELECT c.claim_id, o.id, o.idx, o.text, coalesce(round(p / (ql.l * il.l), 9), 0) AS cosine FROM claims c CROSS JOIN osp o
  LEFT JOIN dt ON dt.claim_id = c.claim_id AND dt.id = o.id AND dt.idx = o.idx LEFT JOIN ql ON ql.claim_id = c.claim_id LEFT JOIN il ON il.id = o.id AND il.idx = o.idx),
tk AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY cosine DESC, id, idx) AS rank FROM cs QUALIFY rank <= 5),
rt AS (SELECT claim_id, list(text ORDER BY rank) AS ss FROM tk GROUP BY ALL),
hit AS (SELECT c.claim_id, c.claim, coalesce(r.ss, []) AS ss, len(list_filter(coalesce(r.ss, []), lambda x: contains(lower(regexp_replace(c.claim, '\s+', ' ', 'g')), trim(lower(regexp_replace(x, '\s+', ' ', 'g')))) OR contains(trim(lower(regexp_replace(x, '\s+', ' ', 'g'))), lower(regexp_replace(c.claim, '\s+', ' ', 'g'))))) > 0 AS is_hit
  FROM claims c LEFT JOIN rt r USING (claim_id)) """


@query(_RETRIEVED + "SELECT count(*) AS n, count_if(is_hit)::BIGINT AS hits, round(count_if(is_hit) / count(*), 6) AS rate FROM hit")
def retrieval_hit_rate(spark, d):
    gold = relations.claims(spark, d).select("claim_id", F.col("claim").alias("gold_span"))
    return retrieve.hit_rate(_retrieved(spark, d), gold).withColumn("rate", F.round("rate", 6))


@query(_RETRIEVED + ", g AS (SELECT claim_id, (CASE WHEN is_hit THEN ss ELSE list_concat([claim], ss) END)[1:5] AS l FROM hit) SELECT claim_id, unnest(l) AS span_text, generate_subscripts(l, 1) AS rank FROM g")
def oracle_retrieval(spark, d):
    gold = relations.claims(spark, d).select("claim_id", F.col("claim").alias("gold_span"))
    return retrieve.with_gold(_retrieved(spark, d), gold).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_SOURCES}, q AS (SELECT vec_id AS claim_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
i AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS w FROM embeddings JOIN sources ON source_id = vec_id WHERE verdict = 'OK')
SELECT claim_id, item_id, row_number() OVER (PARTITION BY claim_id ORDER BY round(list_cosine_similarity(v, w), 9) DESC, item_id) AS rank FROM q, i QUALIFY rank <= 5""")
def retrieve_citable(spark, d):
    e = relations.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    verdicts = relations.sources(spark, d).select(F.col("source_id").alias("vec_id"), "verdict")
    pool = e.join(verdicts, "vec_id").select(F.col("vec_id").alias("item_id"), "vector", "verdict")
    top = retrieve.retrieve(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("claim_id"), "vector"), pool)
    return top.select("claim_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query()
def hashed_words(spark, d):
    return relations.claims(spark, d).select("claim_id", F.transform(retrieve.hashed_words(F.col("claim")), lambda x: F.round(x, 9)).alias("vector"))


_SETS = [f"list_distinct({_tok(x)})" for x in ("claim", "span")]

# --- drafts ----------------------------------------------------------------------------------------------------------

_DRAFTS = "drafts AS (SELECT conv_id * 1000 + turn AS draft_id, text AS draft FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)"


def _drafts(spark, d):
    c = relations.read(spark, d, "conversations").filter("role = 'assistant' AND text IS NOT NULL")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("draft_id"), F.col("text").alias("draft"))


_DECORATED = "'<think>so' || chr(10) || 'on</think>## Title' || chr(10) || '- **' || draft || '**' || chr(10) || '| a | b |' || chr(10) || '---' || chr(10) || '`end`<think>open'"


def _decorated(draft=None):
    return F.concat(F.lit("<think>so\non</think>## Title\n- **"), F.col("draft") if draft is None else draft, F.lit("**\n| a | b |\n---\n`end`<think>open"))


@query(f"WITH {_DRAFTS} SELECT draft_id, '## Title' || chr(10) || '- **' || draft || '**' || chr(10) || '| a | b |' || chr(10) || '---' || chr(10) || '`end`' AS prose FROM drafts")
def strip_reasoning(spark, d):
    return _drafts(spark, d).select("draft_id", drafts.strip_reasoning(_decorated()).alias("prose"))


@query(rf"WITH {_DRAFTS} SELECT draft_id, {_strip('draft')} || chr(10) || 'end' AS prose FROM (SELECT draft_id, regexp_replace(draft, '\s+', ' ', 'g') AS draft FROM drafts)")
def strip_markdown(spark, d):
    return _drafts(spark, d).select("draft_id", drafts.strip_markdown(drafts.strip_reasoning(_decorated(F.regexp_replace("draft", r"\s+", " ")))).alias("prose"))


@query()
def focus_source(spark, d):
    near = _nearest(spark, d).filter("source_rank = 1")
    return near.select("claim_id", drafts.focus_source(F.col("claim"), F.col("text"), 600).alias("focused"))


@query(f"WITH {_SOURCES}, {_CLAIMS}, {_top('top', 'TRUE')} SELECT claim_id AS question_id, string_agg('SOURCE ' || source_rank || ' (' || url || '):' || chr(10) || substr(text, 1, 4000), chr(10) || chr(10) ORDER BY source_rank) AS prompt FROM top JOIN sources USING (source_id) GROUP BY 1")
def prompt_assembly(spark, d):
    near = _nearest(spark, d).select(F.col("claim_id").alias("question_id"), (F.col("source_rank") - 1).alias("rank"), "url", "text")
    return drafts.prompt_sources(near)


@query(f"{_FACTS}, {symbolic_sql.judged('facts', 'j', 'fact_id, claim, span')} SELECT fact_id, {_jac(_SETS[0], _SETS[1])} >= 0.3 AND NOT ({_ANY}) AS kept FROM j")
def faithful_symbolic(spark, d):
    """Claims of a draft whose source sentence may contradict them."""
    f = relations.facts(spark, d).select(F.col("fact_id").alias("draft_id"), F.col("span").alias("draft"), F.col("claim").alias("text"), F.col("span").alias("source_sentence"))
    return decompose.filter_faithful(f, 0.3).select(F.col("draft_id").alias("fact_id"), "kept")


@query(rf"""WITH {_DRAFTS}, a AS (SELECT draft_id, CASE WHEN draft IN (SELECT draft FROM drafts WHERE draft_id % 3 = 0) THEN [draft || '!', 'x'] ELSE list_filter(string_split(regexp_replace({_strip('draft')}, '([.!?])(\s+)', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> '') END AS ss FROM drafts)
SELECT draft_id, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS idx FROM a""")
def scripted_claims(spark, d):
    rows = _drafts(spark, d)
    script = rows.filter("draft_id % 3 = 0").select("draft", F.array(F.concat("draft", F.lit("!")), F.lit("x")).alias("claims"))
    return decompose.scripted_claims(rows, script).select("draft_id", "text", F.col("index").cast("long").alias("idx"))


_SENT = rf"""WITH {_DRAFTS}, ds AS (SELECT draft_id, draft, list_filter(string_split(regexp_replace({_strip('draft')}, '([.!?])(\s+)', '\1' || chr(2), 'g'), chr(2)), lambda x: x <> '') AS ss FROM drafts),
ats AS (SELECT draft_id, draft, unnest(ss) AS text, generate_subscripts(ss, 1) - 1 AS idx FROM ds),
jd AS (SELECT *, {_jac(f"list_distinct({_tok('text')})", f"list_distinct({_tok('draft')})")} >= 0.3 AS kept FROM ats) """


@query(_SENT + "SELECT draft_id, idx AS \"index\", text, kept FROM jd")
def faithful_filter(spark, d):
    judged = decompose.filter_faithful(decompose.split_sentences(_drafts(spark, d)), 0.3)
    return judged.select("draft_id", F.col("index").cast("long").alias("index"), "text", "kept")


@query(_SENT + "SELECT d.draft_id, count_if(kept)::BIGINT AS n_kept, count_if(NOT kept)::BIGINT AS n_dropped, coalesce(round(count_if(NOT kept) / nullif(count(kept), 0), 6), 0) AS drift_rate FROM drafts d LEFT JOIN jd USING (draft_id) GROUP BY 1")
def drift_rate(spark, d):
    rows = _drafts(spark, d)
    return decompose.drift_rate(decompose.filter_faithful(decompose.split_sentences(rows), 0.3), rows).withColumn("drift_rate", F.round("drift_rate", 6))


@query(_SENT + "SELECT draft_id, idx AS \"index\", trim(text) AS text, draft AS source_sentence FROM ats WHERE trim(text) <> ''")
def decompose_json(spark, d):
    each = F.transform(spans.naive_sentences(F.col("draft")), lambda s: F.struct(s.alias("atomic"), F.col("draft").alias("source_sentence")))
    replies = _drafts(spark, d).select("draft_id", F.to_json(F.struct(each.alias("claims"))).alias("reply"))
    return decompose.parse_reply(replies).filter("index IS NOT NULL").select("draft_id", F.col("index").cast("long").alias("index"), "text", "source_sentence")


# --- pages -----------------------------------------------------------------------------------------------------------


@query("SELECT url, sha256(html) AS sha256, substr(sha256(html), 1, 16) || '.html' AS artifact_key, 'raw-fetch' AS tool FROM pages")
def snapshot_digest(spark, d):
    return artifacts.snapshots(relations.read(spark, d, "pages").select("url", F.col("html").alias("body"))).drop("body")


@query("SELECT url, page_id % 9 <> 0 AS valid FROM pages")
def integrity_check(spark, d):
    p = relations.read(spark, d, "pages")
    recorded = p.select("url", artifacts.digest(F.col("html")).alias("sha256"))
    changed = p.select(artifacts.digest(F.col("html")).alias("sha256"), F.when(F.col("page_id") % 9 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("body"))
    return artifacts.read_checked(recorded, changed, strict=False).select("url", "valid")


def _visible_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(?is)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)^.*?<body\b[^>]*>', ''), '(?is)</body\s*>.*$', ''), '(?s)<[^>]*>', '', 'g')"
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


@query(f"SELECT page_id, {_visible_sql('html')} AS visible FROM pages")
def visible_text(spark, d):
    return relations.read(spark, d, "pages").select("page_id", pages.visible_text(F.col("html")).alias("visible"))


@query()
def main_text(spark, d):
    return relations.read(spark, d, "pages").select("page_id", pages.main_text(F.col("html")).alias("main"))


@query()
def sanitize_html(spark, d):
    return relations.read(spark, d, "pages").select("page_id", F.md5(pages.sanitize(F.col("html")).cast("binary")).alias("digest"))


def _anchored(spark, d):
    p = relations.read(spark, d, "pages").withColumn("main", pages.main_text(F.col("html"))).withColumn("target", pages.visible_text(F.col("html")))
    s = F.get(spans.candidate_spans(F.col("main")), F.lit(1))
    near = anchors.proportional_near(F.col("s.start"), F.length("main"), F.length("target"))
    found = tokens.pinned(tokens.pinned(p, "main", "target").withColumn("s", s), "s").filter("s IS NOT NULL")
    return tokens.pinned(found.select("page_id", "url", "html", F.col("s.text").alias("quote"), "target", near.alias("near")), "near")


@query()
def anchor_ladder(spark, d):
    return anchors.anchor_ladder(_anchored(spark, d)).select("page_id", "anchor.start", "anchor.end", "anchor.strategy", "anchor.score")


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN round_even(n_chars // 3 / n_chars::DOUBLE * (n_chars + doc_id % 90), 0)::BIGINT END AS near FROM documents WHERE n_chars >= 0.6 * (n_chars + doc_id % 90) AND n_chars > 0")
def proportional_near(spark, d):
    n = F.col("n_chars")
    near = anchors.proportional_near(F.floor(n / 3), n, n + F.col("doc_id") % 90)
    return relations.read(spark, d, "documents").select("doc_id", near.cast("long").alias("near")).filter("near IS NOT NULL")


@query()
def receipt_html(spark, d):
    rows = tokens.pinned(anchors.anchor_ladder(_anchored(spark, d)).filter("anchor IS NOT NULL"), "anchor")
    html = receipts.render(F.col("html"), F.col("quote"), F.col("url"), F.lit("OK"), F.lit("direct"), artifacts.digest(F.col("html")), F.col("anchor"))
    return rows.select("page_id", F.md5(html.cast("binary")).alias("digest"), F.length(html).alias("n_chars"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'http://10.0.0.' || (page_id % 256) || '/' WHEN 1 THEN 'ftp://' || url ELSE url END AS url FROM pages)
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'address' WHEN 1 THEN 'scheme' END AS reason FROM u""")
def safe_url(spark, d):
    u = relations.read(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id") % 256, F.lit("/"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.col("url")).alias("url"))
    return u.select("page_id", "url", pages.unsafe_reason(F.col("url"), F.array(F.lit("93.184.216.34"))).alias("reason"))


@query("""WITH RECURSIVE h AS (SELECT url, page_id, CASE WHEN page_id % 8 <> 7 THEN page_id + 1 ELSE NULL END AS next FROM pages),
c AS (SELECT page_id AS start, page_id AS at, 0 AS n FROM pages UNION ALL SELECT c.start, h.next, c.n + 1 FROM c JOIN h ON h.page_id = c.at WHERE h.next IS NOT NULL AND h.next IN (SELECT page_id FROM pages) AND c.n < 5)
SELECT p.url AS start, max(n) AS n_hops, p.page_id % 8 < 2 AND p.page_id + 6 <= (SELECT max(page_id) FROM pages) AS stopped FROM c JOIN pages p ON p.page_id = c.start GROUP BY p.url, p.page_id""")
def redirect_chain(spark, d):
    """Pages share addresses, so a chain goes from page to page: page_id stands for the address."""
    p = relations.read(spark, d, "pages").select("page_id", "url").distinct()
    ids = p.select(F.col("page_id").alias("url")).distinct()
    to = ids.select((F.col("url") - 1).alias("url"), F.col("url").alias("location")).filter("url % 8 <> 7")
    out = research.redirect_chains(ids, ids.join(to, "url", "left").withColumn("safe", F.lit(True)))
    return p.join(out.withColumnRenamed("start", "page_id").drop("url"), "page_id").select(F.col("url").alias("start"), F.col("n_hops").cast("long").alias("n_hops"), F.col("reason").isNotNull().alias("stopped"))


@query()
def spine_stages(spark, d):
    p = relations.read(spark, d, "pages")
    judged = p.select("url", F.col("html").alias("body"), F.when(F.col("page_id") % 10 == 3, "BLOCKED").otherwise("OK").alias("verdict"))
    first = F.get(spans.candidate_spans(pages.main_text(F.col("html"))), F.lit(1))["text"]
    requests = p.select(F.col("page_id").alias("request_id"), "url", F.when(F.col("page_id") % 10 == 4, "Nothing of the kind was ever said.").otherwise(first).alias("claim"))
    return research.spine(requests, judged, binder.BinderConfig(tau=0.5))


@query(_BIND.replace("SELECT c.claim_id, c.claim,", "SELECT item_id AS question_id, count(*) AS n_claims, count_if(status = 'cited')::BIGINT AS n_cited, count_if(status <> 'cited')::BIGINT AS n_unverified FROM (SELECT c.claim_id, c.claim, c.item_id,", 1) + ") GROUP BY 1")
def research_report(spark, d):
    items = relations.read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    bound = bind_claims(spark, d).withColumn("question_id", F.floor(F.col("claim_id") / 1000))
    none = spark.createDataFrame([], "question_id long, status string")
    return research.research_report(items, bound, none).filter("n_claims > 0").select("question_id", "n_claims", "n_cited", "n_unverified")


# --- connectors ------------------------------------------------------------------------------------------------------


@query("SELECT item_id AS question_id, 'https://x.example/' || item_id AS url, substr(text, 1, 20) AS title FROM benchmark")
def searxng_hits(spark, d):
    b = relations.read(spark, d, "benchmark")
    results = F.array(F.struct(F.concat(F.lit("https://x.example/"), "item_id").alias("url"), F.substring("text", 1, 20).alias("title"), F.lit("").alias("content")), F.struct(F.lit("mailto:a@b").alias("url"), F.lit("no").alias("title"), F.lit("").alias("content")))
    replies = b.select(F.col("item_id").alias("question_id"), F.to_json(F.struct(results.alias("results"))).alias("reply"))
    return search.searxng_hits(replies).select("question_id", "url", "title")


@query(r"SELECT item_id AS question_id, 'https://en.wikipedia.org/wiki/' || url_encode(replace(regexp_replace(substr(text, 1, 20), '\s', ' ', 'g'), ' ', '_')) AS url, 'a b' AS snippet FROM benchmark")
def wikipedia_hits(spark, d):
    b = relations.read(spark, d, "benchmark")
    found = F.array(F.struct(F.regexp_replace(F.substring("text", 1, 20), r"\s", " ").alias("title"), F.lit("<span class='m'>a</span> b").alias("snippet")), F.struct(F.lit(" ").alias("title"), F.lit("").alias("snippet")))
    replies = b.select(F.col("item_id").alias("question_id"), F.to_json(F.struct(F.struct(found.alias("search")).alias("query"))).alias("reply"))
    return search.wikipedia_hits(replies).select("question_id", "url", "snippet")


@query("SELECT item_id AS question_id, 'https://d.example/' || item_id AS url, text AS title, '' AS snippet FROM benchmark")
def duckduckgo_hits(spark, d):
    b = relations.read(spark, d, "benchmark")
    none = F.lit(None).cast("string")
    found = F.array(F.struct(none.alias("href"), F.concat(F.lit("https://d.example/"), "item_id").alias("url"), F.col("text").alias("title"), none.alias("body")), F.struct(F.lit("ftp://x").alias("href"), none.alias("url"), F.lit("no").alias("title"), F.lit("").alias("body")))
    replies = b.select(F.col("item_id").alias("question_id"), F.to_json(found).alias("reply"))
    return search.duckduckgo_hits(replies).select("question_id", "url", "title", "snippet")


@query(f"WITH {_HITS}, h AS (SELECT question_id, url, list_id, rank FROM hits UNION ALL SELECT question_id, url, 2, rank FROM hits WHERE list_id = 0 AND question_id % 2 = 0), z AS (SELECT question_id, url, round(sum(1.0::DOUBLE / (60 + rank + 1)), 12) AS score, min(list_id * 1000 + rank) AS f FROM h GROUP BY 1, 2) SELECT question_id, url, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, f) - 1 AS fused_rank FROM z")
def combined_search(spark, d):
    """Three services, of which one failed on every other question."""
    hits = relations.search_hits(spark, d)
    lists = [hits.filter(F.col("list_id") == k).drop("list_id") for k in (0, 1)] + [hits.filter("list_id = 0 AND question_id % 2 = 0").drop("list_id")]
    return ranking.rrf_fuse(search.combined(lists)).select("question_id", "url", F.col("fused_rank").cast("long").alias("fused_rank"))


@query("SELECT page_id, url || ';' || page_id || '.org' AS urls FROM pages")
def pasted_urls(spark, d):
    p = relations.read(spark, d, "pages")
    pasted = F.concat(F.lit(" ,\n"), "url", F.lit(" \n, \t"), F.col("page_id").cast("string"), F.lit(".org,,"))
    return p.select("page_id", F.array_join(search.pasted_urls(pasted), ";").alias("urls"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'progress' WHEN 1 THEN 'draft' WHEN 2 THEN 'result' ELSE 'error' END AS type, event_type AS data FROM events")
def event_lines(spark, d):
    e = relations.read(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in artifacts.EVENTS]), (F.col("event_id") % 4).cast("int") + 1)
    lines = artifacts.event_lines(e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("event_type").alias("data")))
    return lines.select(F.col("seq").alias("event_id"), F.from_json("value", "struct<type:string,data:string>").alias("v")).select("event_id", "v.type", "v.data")


@query("SELECT substr(sha256(url || chr(10) || 'q'), 1, 16) AS receipt_id, max(page_id) AS seq FROM pages GROUP BY 1 ORDER BY 2 DESC LIMIT 500")
def receipt_store(spark, d):
    p = relations.read(spark, d, "pages")
    return artifacts.receipts(p.select(F.col("page_id").alias("seq"), "url", F.lit("q").alias("quote"), "html"), 500).select("receipt_id", "seq")


@query(_LABELLED + "SELECT pair_id::VARCHAR AS id, bucket, claim, source_url, verdict, entailed, answerable FROM pairs")
def labelled_pairs(spark, d):
    """Pairs written as JSON, one text for each bucket of ids, and read again."""
    fields = ["bucket", "claim", "source_url", "source_text", "verdict", "entailed", "answerable"]
    files = relations.labelled(spark, d).groupBy(F.expr("pair_id % 16")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("pair_id").cast("string").alias("id"), *fields)).alias("pairs"))).alias("value"))
    return artifacts.parse_pairs(files).select("id", "bucket", "claim", "source_url", "verdict", "entailed", "answerable")


@query("""WITH l AS (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), m AS (SELECT count(*) AS n, avg((a = b)::INT) AS observed, avg(a::INT) AS px, avg(b::INT) AS py FROM l)
SELECT n, round(observed, 6) AS observed, round(px * py + (1 - px) * (1 - py), 6) AS expected, round((observed - (px * py + (1 - px) * (1 - py))) / nullif(1 - (px * py + (1 - px) * (1 - py)), 0), 6) AS kappa FROM m""")
def cohen_kappa(spark, d):
    k = evaluate.kappa(relations.read(spark, d, "labels").select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


@query("""WITH r AS (SELECT doc_id, unnest([quality, 1 - toxic, (doc_id % 7 > 0)::INT]) AS c FROM (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)),
e AS (SELECT doc_id, c, count(*) AS k FROM r GROUP BY ALL), i AS (SELECT doc_id, sum(k * (k - 1)) / 6.0 AS p FROM e GROUP BY 1), s AS (SELECT sum(k * k) / pow(sum(k), 2) AS x FROM (SELECT c, sum(k) AS k FROM e GROUP BY 1))
SELECT count(*) AS n, round(avg(p), 6) AS observed, round(any_value(x), 6) AS expected, round((avg(p) - any_value(x)) / (1 - any_value(x)), 6) AS kappa FROM i, s""")
def fleiss_kappa(spark, d):
    one = relations.read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    votes = F.array(F.col("quality").cast("int"), (1 - F.col("toxic")).cast("int"), (F.col("doc_id") % 7 > 0).cast("int"))
    k = evaluate.fleiss_kappa(one.select(F.col("doc_id").alias("item"), F.explode(votes).alias("category")))
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


__all__ = ["QUERIES", "SQL"]
