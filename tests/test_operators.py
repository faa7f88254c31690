import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestine.functions import anchors, bounds, drafts, pages, receipts, spans
from attestine.operators import binder, decompose, evaluate, gate, ranking, retrieve
from attestine.plans import research
from attestine.sources import search


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_spans_keep_offsets(spark):
    text = "  First one.[5] Second é one! Third\nline? tail 3.5 ends"
    found = one(spark, spans.candidate_spans(F.col("t")), t=text)
    assert [text[s.start : s.end] for s in found] == [s.text for s in found] == ["First one.", "Second é one!", "Third\nline?", "tail 3.5 ends"]
    assert one(spark, spans.candidate_spans(F.col("t")), t="") == []


def test_occurrences_and_nearest(spark):
    assert one(spark, spans.occurrences(F.col("q"), F.col("p")), q="aa", p="aaa b aa") == [0, 1, 6]
    assert one(spark, spans.occurrences(F.col("q"), F.col("p")), q="a\\Eb.", p="xa\\Eb.") == [1]
    assert one(spark, spans.occurrences(F.col("q"), F.col("p")), q="z", p="aaa") == []
    assert one(spark, spans.nearest(spans.occurrences(F.col("q"), F.col("p")), F.lit(4)), q="aa", p="aaa b aa") == 6
    assert one(spark, spans.is_unique_in(F.col("q"), F.col("p")), q="b", p="aaa b aa")
    assert not one(spark, spans.is_unique_in(F.col("q"), F.col("p")), q="aa", p="aaa")


def test_prose_and_anaphor(spark):
    rows = spark.createDataFrame([("See also:\nx",), ("^ a note",), ("a|b|c|d|e",), ("It was so.",)], "t string")
    got = rows.select(spans.is_citable_prose(F.col("t")).alias("p"), spans.has_leading_anaphor(F.col("t")).alias("a")).collect()
    assert [(r.p, r.a) for r in got] == [(False, False), (False, False), (False, False), (True, True)]


PAIRS = "pair_id int, claim string, source_url string, source_text string, verdict string"


def test_binder_gates(spark):
    text = "The red bridge opened in 1998. The red bridge opened in 1989 to traffic. Other words."
    rows = [(1, "The red bridge opened in 1989.", "u", text, "OK"), (2, "The red bridge opened in 1989.", "u", text, "BLOCKED"), (3, "Nothing like it at all.", "u", text, "OK"), (4, "The red bridge opened in 1989.", " ", text, "OK"), (5, None, "u", text, "OK"), (6, "The red bridge opened in 1989.", "u", None, "OK")]
    got = {r.pair_id: r for r in binder.bind(spark.createDataFrame(rows, PAIRS), binder.BinderConfig(tau=0.5)).collect()}
    assert len(got) == 6 and got[1].cited and got[1].cited_span == "The red bridge opened in 1989 to traffic."
    assert text[got[1].cited_start :].startswith(got[1].cited_span)
    assert not any(got[k].cited for k in (2, 3, 4, 5, 6)) and all(r.cited != r.abstained for r in got.values())
    strict = binder.BinderConfig(tau=0.5, second=binder.lexical_score, tau_second=0.99)
    assert not binder.bind(spark.createDataFrame(rows[:1], PAIRS), strict).first().cited
    with pytest.raises(ValueError):
        binder.BinderConfig(tau=1.5)


def test_baselines_and_report(spark):
    rows = [(k, "a red bridge opened", "u", "A red bridge opened. Else.", v, "b", True, v == "OK") for k, v in enumerate(("OK", "BLOCKED", "OK"))]
    pairs = spark.createDataFrame(rows, PAIRS + ", bucket string, entailed boolean, answerable boolean")
    report = {r.bucket: r for r in evaluate.report(binder.lexical_overlap(pairs, 0.3)).collect()}
    assert report["pooled"].n == 3 and report["pooled"].cited == 2 and report["pooled"].violations == 0 and report["b"].precision == 1.0
    none = {r.bucket: r for r in evaluate.report(binder.always_abstain(pairs)).collect()}
    assert none["pooled"].cited == 0 and none["pooled"].precision == 0.0
    adversary = pairs.withColumns({"cited": F.lit(True), "abstained": F.lit(False), "cited_span": F.lit("x")})
    assert {r.bucket: r.violations for r in evaluate.report(adversary).collect()}["pooled"] == 1
    assert evaluate.kappa(spark.createDataFrame([(True, True), (False, False), (True, False)], "a boolean, b boolean"), "a", "b").first().observed == pytest.approx(2 / 3)


def test_bounds():
    assert bounds.clopper_pearson_lower(50, 50, 0.10) == pytest.approx(0.1 ** (1 / 50))
    assert bounds.clopper_pearson_lower(49, 50, 0.10) == pytest.approx(0.92442, abs=1e-5)
    assert bounds.clopper_pearson_lower(0, 9, 0.1) == 0 and bounds.clopper_pearson_upper(9, 9, 0.1) == 1
    for bad in ((3, 2, 0.1), (1, 0, 0.1), (1, 2, 0.0)):
        with pytest.raises(ValueError):
            bounds.clopper_pearson_lower(*bad)


def test_prune(spark):
    rows = [(c, k, f"s{k}", "u", s) for c, scores in enumerate(((0.95, 0.90, 0.85), (0.60, 0.55, 0.65), (0.95, 0.30, 0.25))) for k, s in enumerate(scores)]
    left = ranking.prune(spark.createDataFrame(rows, "claim_id int, pos int, span_text string, source_url string, score double"), 0.7).groupBy("claim_id").count().collect()
    assert {r.claim_id: r["count"] for r in left} == {0: 1, 1: 3, 2: 1}


def test_search_diversity(spark):
    hits = [(1, "q words", 0, k, "t", f"https://a.site.co.uk/{k}", "s") for k in range(4)] + [(1, "q words", 1, 0, "t", "https://www.reddit.com/r", "q words"), (1, "q words", 1, 1, "t", "https://grokipedia.com/x", "q"), (1, "q words", 1, 2, "t", "https://b.org/", "s")]
    table = spark.createDataFrame(hits, "question_id int, question string, list_id int, rank long, title string, url string, snippet string")
    got = [r.url for r in research.search(table).orderBy("final_rank").collect()]
    assert len(got) == 4 and got[-1].startswith("https://www.reddit.com") and not any("grokipedia" in u for u in got)


def test_domains_and_queries(spark):
    urls = spark.createDataFrame([("https://a.b.co.uk/x",), ("http://m.youtube.com:80/",), ("https://localhost/",), ("http://10.0.0.1/",)], "u string")
    assert [r.d for r in urls.select(ranking.registrable_domain(F.col("u")).alias("d")).collect()] == ["b.co.uk", "youtube.com", "localhost", "10.0.0.1"]
    assert one(spark, ranking.query_variants(F.col("q")), q="Who was President Abraham Lincoln of 1865 America?") == ["Abraham Lincoln", "Who was President Abraham Lincoln of 1865 America?"]
    assert one(spark, ranking.query_variants(F.col("q")), q="how do cats purr") == ["how do cats purr"]


def test_drafts(spark):
    assert one(spark, drafts.strip_markdown(F.col("t")), t="## T\n- **bold** x\n| a | b |\n---\n\n1) `code`") == "bold x\ncode"
    assert one(spark, drafts.strip_reasoning(F.col("t")), t="<think>a\nb</think>x<think>y") == "x"
    text = "\n".join(["filler words here"] * 100 + ["the answer about red bridges"] + ["more filler"] * 50)
    assert "red bridges" in one(spark, drafts.focus_source(F.lit("where are red bridges"), F.col("t"), 100), t=text)
    assert one(spark, drafts.focus_source(F.lit("q"), F.col("t"), 100), t="short") == "short"


def test_decompose(spark):
    reply = '{"claims":[{"atomic":"A b.","source_sentence":"A b c."},{"atomic":" "},{"atomic":"C."}]}'
    rows = decompose.parse_reply(spark.createDataFrame([(1, reply), (2, "no json")], "draft_id int, reply string")).orderBy("draft_id", "index").collect()
    assert [(r.draft_id, r["index"], r.text, r.malformed) for r in rows] == [(1, 0, "A b.", False), (1, 1, "C.", False), (2, None, None, True)]
    with pytest.raises(ValueError):
        decompose.reject_minicheck(type("MiniCheckScorer", (), {})())


def test_retrieval(spark):
    assert one(spark, retrieve.is_hit(F.array(F.lit("x A  cat y")), F.col("g")), g="a cat") and not one(spark, retrieve.is_hit(F.array(F.lit("x")), F.col("g")), g=" ")
    v = one(spark, retrieve.hashed_words(F.col("t"), 16), t="a a b")
    assert sum(x * x for x in v) == pytest.approx(1) and one(spark, retrieve.hashed_words(F.col("t"), 4), t="!") == [0.0] * 4


def test_retrieved_spans(spark):
    """Against all pairs of claims and spans, whole texts; sources that may not be cited give none."""
    texts = {1: "The river rose. It fell again in May! The river rose by two metres.", 2: "Exports grew. A river, a hill. " * 30 + "The river rose by two metres in June.", 3: "The river rose by two metres.", 4: "", 5: None}
    rows = [(k, t, "BLOCKED" if k == 3 else "OK") for k, t in texts.items()]
    claims = {7: "The river rose by two metres.", 8: "exports grew in may", 9: "!"}
    got = retrieve.retrieve_spans(spark.createDataFrame(list(claims.items()), "claim_id long, claim string"), spark.createDataFrame(rows, "source_id long, text string, verdict string"), 5, digest="md5")
    pool = [(k, at, x) for k, t in texts.items() if t and k != 3 for at, x in enumerate(re.split(r"(?<=[.!?])\s+", t.strip()))]

    def vector(t):
        return Counter(int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big") % 256 for w in re.findall("[a-z0-9]+", t.lower()))

    def cosine(a, b):
        a, b = vector(a), vector(b)
        return round(sum(a[x] * b[x] for x in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9) if a and b else 0.0

    want = {(c, r + 1, x) for c, t in claims.items() for r, (_, _, x) in enumerate(sorted(pool, key=lambda p: (-cosine(t, p[2]), p[0], p[1]))[:5])}
    assert {(r.claim_id, r.rank, r.span_text) for r in got.collect()} == want


def test_anchor_ladder(spark):
    rows = [("the cat sat", "xx the cat sat, the cat sat", 14), ("the  cat\nsat", "xx the cat­ sat", None), ("the quick brown fox jumps", "say the quick brown fax jumps now", None), ("zzz", "abc", None), ("", "abc", None)]
    got = [r.anchor for r in anchors.anchor_ladder(spark.createDataFrame(rows, "quote string, target string, near int")).orderBy(F.desc("quote")).collect()]
    by = {r.quote: r.anchor for r in anchors.anchor_ladder(spark.createDataFrame(rows, "quote string, target string, near int")).collect()}
    assert len(got) == 5 and by["the cat sat"].start == 16 and by["the cat sat"].strategy == "exact"
    assert by["the  cat\nsat"].strategy == "normalized" and by["the quick brown fox jumps"].strategy == "fuzzy" and by["zzz"] is None and by[""] is None
    assert one(spark, anchors.proportional_near(F.col("s"), F.lit(10), F.lit(10)), s=5) == 5 and one(spark, anchors.proportional_near(F.col("s"), F.lit(5), F.lit(10)), s=5) is None


def test_pages(spark):
    page = "<html><head><title>t</title><script>bad()</script></head><body><nav>menu</nav><article><p>Real <b>text</b> &amp; more.</p></article><footer>f</footer></body></html>"
    assert one(spark, pages.main_text(F.col("p")), p=page) == "Real text & more."
    assert one(spark, pages.visible_text(F.col("p")), p=page) == "menuReal text & more.f"
    hostile = '<body onload="x()"><a href="java\tscript:alert(1)" title="k">a</a><img src="data:image/png;base64,x"><iframe src="y">z</iframe><a href="data:text/html,x">b</a><meta http-equiv="refresh"></body>'
    safe = one(spark, pages.sanitize(F.col("p")), p=hostile)
    assert "script" not in safe and "onload" not in safe and "iframe" not in safe and "data:text" not in safe and "data:image" in safe and "meta" not in safe and 'title="k"' in safe
    anchor = F.struct(F.lit("</script>").alias("exact"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.lit("exact").alias("strategy"))
    html = one(spark, receipts.render(F.col("p"), F.lit("a<b"), F.lit("u"), F.lit("OK"), F.lit(None), F.lit("0" * 64), anchor), p=page)
    assert html.count("</script>") == 1 and "a&lt;b" in html and html.index("<body>") < html.index('id="receipt"')


@pytest.mark.parametrize(("url", "safe"), [("https://x.org/", True), ("ftp://x.org/", False), ("http://127.0.0.1/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://169.254.1.1/", False), ("http://8.8.8.8/", True), ("http:///x", False), (None, False)])
def test_safe_urls(url, safe):
    assert (pages._unsafe_reason(url, ["93.184.216.34"]) is None) == safe


def test_redirects(spark):
    hops = [(f"u{k}", f"u{k + 1}", True) for k in range(9)] + [("a", "b", True), ("b", "a", True), ("p", "q", True), ("q", None, False), ("z", None, True)]
    got = {r.start: (r.n_hops, r.reason) for r in research.redirect_chains(spark.createDataFrame([("u0",), ("u5",), ("a",), ("p",), ("z",)], "url string"), spark.createDataFrame(hops, "url string, location string, safe boolean")).collect()}
    assert got == {"u0": (5, "too many redirects"), "u5": (4, None), "a": (1, "loop"), "p": (1, "unsafe"), "z": (0, None)}


def test_gate_and_connectors(spark):
    rows = spark.createDataFrame([("OK", "x"), ("OK", ""), (None, "x"), ("UNVERIFIED", "x")], "v string, t string")
    assert [r.s for r in rows.select(gate.source_status(F.col("v"), F.col("t")).alias("s")).collect()] == ["ok", "no_content", "excluded", "excluded"]
    assert one(spark, gate.location_header(F.create_map(F.lit("LoCation"), F.col("x"))), x="u") == "u"
    assert one(spark, gate.is_sentinel(F.col("t"), "Nothing found."), t=" Nothing found ")
    reply = '{"query":{"search":[{"title":"A b/c (d)","snippet":"<b>x</b>y"},{"title":" "}]}}'
    hit = search.wikipedia_hits(spark.createDataFrame([(1, reply)], "question_id int, reply string")).collect()
    assert [(h.url, h.snippet) for h in hit] == [("https://en.wikipedia.org/wiki/A_b/c_%28d%29", "xy")]
    assert search.choose_provider("wikipedia", "u") == "wikipedia" and search.choose_provider(None, "u") == "searxng" and search.choose_provider() == "combined"


def test_streaming(spark, tmp_path):
    from attestine.streaming.claims import distinct_claims

    spark.createDataFrame([("A  b", "2024-01-01 00:00:00"), ("a b", "2024-01-01 00:01:00"), ("c", "2024-01-01 00:02:00")], "claim string, t string").withColumn("ts", F.to_timestamp("t")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("claim string, ts timestamp").parquet(str(tmp_path / "in"))
    q = distinct_claims(stream).writeStream.format("memory").queryName("claims_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("claims_out").count() == 2


def test_entities_and_frames(spark):
    assert one(spark, pages.decoded(F.col("t")), t="&rsquo;&eacute;&#8217;&#x1F600;&bogus; a & b &amp;lt; &#0; &apos;&") == "’é’😀&bogus; a & b &lt; &#0; '&"
    assert one(spark, pages.visible_text(F.col("t")), t='<body><a title="x > y">l&rsquo;a</a> 1 < 2</body>') == "l’a 1 < 2"
    safe = one(spark, pages.sanitize(F.col("p")), p='<body><frame src="x"><p>kept</p></body>')
    assert "kept" in safe and "<frame" not in safe


def test_model_seams(spark):
    rows = spark.createDataFrame([("a b", "a b x"), ("a b", "x y")], "claim string, span string")

    def load():
        import math  # stands for a model's library, which only workers need

        return lambda claims, spans: [math.floor(len(set(c.split()) & set(s.split()))) / len(c.split()) for c, s in zip(claims, spans, strict=True)]

    assert [r.s for r in rows.select(binder.model_scorer(load)(F.col("claim"), F.col("span")).alias("s")).collect()] == [1.0, 0.0]
    long = "x " * 100 + "a b"
    score = binder.windowed(binder.lexical_score, words=10, most=24)
    assert one(spark, score(F.lit("a b"), F.col("t")), t=long) == 1.0 and one(spark, score(F.lit("a b"), F.col("t")), t="x " * 300 + "a b") == 0


def test_next_source_where_the_first_cannot_be_shown(spark):
    text = "The red bridge opened in 1989. Other words follow here."
    claims = spark.createDataFrame([(1, "The red bridge opened in 1989."), (2, "Other things were never said.")], "claim_id int, claim string")
    sources = spark.createDataFrame([(1, "u1", text, "OK", "gone"), (2, "u2", text + " More.", "OK", text), (3, "u3", text, "BLOCKED", text)], "source_id int, url string, text string, verdict string, target string")
    got = {r.claim_id: r for r in research.bind_nearest(claims, sources, binder.BinderConfig(tau=0.5, coref=False)).collect()}
    assert got[1].status == "cited" and got[1].source_id == 2 and got[1].strategy == "exact" and got[1].n_tried == 2
    assert got[2].status == "unverified" and got[2].best_entailment is not None and got[2].best_entailment < 0.5
    drafts_ = spark.createDataFrame([(1, "The red bridge opened in 1989."), (2, "The sources do not answer this question")], "question_id int, draft string")
    pool = spark.createDataFrame([(1, k, 0, s) for k, s in enumerate((1, 2, 3))], "question_id int, rank int, n_urls int, source_id int")
    bound, counts = research.research(drafts_.select("question_id"), pool, sources, drafts_)
    assert [(r.claim_id, r.status) for r in bound.collect()] == [(1000, "cited")] and tuple(counts.first()) == (1, 0, 1)


def test_events_and_pairs(spark):
    from attestine.sources import artifacts

    bad = spark.createDataFrame([(1, "other", "x")], "seq int, type string, data string")
    with pytest.raises(Exception, match="unknown event type"):
        artifacts.event_lines(bad).collect()
    twice = spark.createDataFrame([('{"pairs":[{"id":"a"},{"id":"a"}]}',)], "value string")
    with pytest.raises(Exception, match="duplicate pair id"):
        artifacts.parse_pairs(twice).collect()
    assert one(spark, search.pasted_urls(F.col("t")), t=" https://a ,\n\nhttps://b,") == ["https://a", "https://b"]
    rows = spark.createDataFrame([(1, "a", "q", "h1"), (2, "a", "q", "h2"), (3, "b", "q", "h3")], "seq int, url string, quote string, html string")
    assert [(r.seq, r.html) for r in artifacts.receipts(rows, 2).collect()] == [(3, "h3"), (2, "h2")]


def same_as_sql(spark, name, pages, tmp_path):
    """The query's rows and its SQL's, over pages (page_id, url, html)."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    return got, sorted(con.execute(entry.oracle_sql()[name]).fetchall())


def test_redirects_between_pages_of_one_address(spark, tmp_path):
    got, told = same_as_sql(spark, "redirect_chain", [(k, f"u{k % 11}" if k < 30 else f"u{k // 2}", "x") for k in range(60)], tmp_path)
    assert got == told and len(got) == 60


def test_shells_of_pages_of_one_address(spark, tmp_path):
    got, told = same_as_sql(spark, "escalate_shells", [(k, f"u{k % 3}", "x") for k in range(40)], tmp_path)
    assert got == told and len(got) == 40
    fetch = spark.createDataFrame([("u", "EMPTY_SHELL", "", "direct")], "url string, verdict string, body string, tactic string")
    again = spark.createDataFrame([("u", "OK", "b"), ("u", "OK", "a")], "url string, verdict string, body string")
    assert [(r.url, r.verdict, r.body, r.tactic) for r in gate.acquire(fetch, again).collect()] == [("u", "OK", "a", "rendered")]
