import pytest
from pyspark.sql import functions as F

from attestine.functions.symbolic import RULES, contradiction_messages, normal_number, stem

FIRES = {
    "percent_mismatch": [("Sales grew 12% in May.", "Sales grew 21% in May."), ("A rate of 5 per cent.", "A rate of 6 percent."), ("It is 1,200.50%.", "It is 1200.6%."), ("Nearly 12% left.", "30 % left.")],
    "unit_mismatch": [("The plant made 40 tonnes of steel.", "The plant made 55 tonnes of steel."), ("About 100 people came.", "About 300 people came."), ("~100 people came.", "106 people came.")],
    "year_mismatch": [("The bridge opened in 1989.", "The bridge opened in 1998."), ("Founded 1901.", "Built since 1910.")],
    "date_mismatch": [("They met on June 7.", "They met on June 8."), ("They met on 7 June.", "They met on June 8.")],
    "index_mismatch": [("It is told in chapter 3.", "It is told in chapter 4."), ("See fig 02.", "See fig 3.")],
    "negation_flip": [("Prices fell last year.", "Prices did not fall last year."), ("The drug reduces pain.", "The drug fails to reduce pain."), ("Sales never dropped.", "Sales dropped.")],
    "direction_flip": [("Exports rose.", "Exports fell."), ("Output increased.", "Output dropped."), ("Output increased sharply.", "Output dropped steadily."), ("Output increased x production.", "Output dropped production.")],
    "quantifier_flip": [("All studies agreed.", "Some studies agreed."), ("Most voters agreed.", "Few voters agreed."), ("All of the studies agreed.", "None of the studies agreed.")],
}
HOLDS = [
    ("Sales grew 12%.", "Sales grew 12 percent, more than the 8% of the year before."),
    ("About 100 people came.", "98 people came."),
    ("More than 100 people came.", "250 people came."),
    ("No more than 100 people came.", "50 people came."),
    ("~100 people came.", "104 people came."),
    ("The trial had 2000 patients.", "The trial began in 2019."),
    ("Imports rose.", "Exports fell."),
    ("Exports rose.", "Export fell."),
    ("Output increased hiring.", "Output dropped footprint."),
    ("Output increased.", "Output dropped footprint."),
    ("The drug treats bacterial disease.", "The drug does not treat viral disease."),
    ("The test did not help.", "The test did not really help."),
    ("All employees got bonuses.", "No employees were laid off."),
    ("Most people supported it.", "Most people supported it, while few people opposed it."),
    ("Most people agreed.", "It passed, few people agreed."),
    ("They met on June 7.", "They met on 7 June."),
    ("They met on June 45.", "They met on June 7."),
    ("A supernova was seen in 1054.", "A supernova of 1054 left a pulsar found in 1968."),
    ("", "Anything 5%."),
    (None, "x"),
    ("x", None),
]


def test_rules(spark):
    """Each pair fires its rule and no other; the rest fires none."""
    pairs = [(rule, c, s) for rule, some in FIRES.items() for c, s in some] + [(None, c, s) for c, s in HOLDS]
    rows = spark.createDataFrame([(k, c, s) for k, (_, c, s) in enumerate(pairs)], "k int, c string, s string")
    got = rows.select("k", *[(F.size(contradiction_messages(F.col("c"), F.col("s"), [rule])) > 0).alias(rule) for rule in RULES]).collect()
    fired = {r.k: [rule for rule in RULES if r[rule]] for r in got}
    assert [fired[k] for k in range(len(pairs))] == [[rule] if rule else [] for rule, _, _ in pairs]
    every = rows.select("k", contradiction_messages(F.col("c"), F.col("s")).alias("m")).collect()
    assert all(bool(r.m) == bool(fired[r.k]) for r in every)
    assert next(r.m for r in every if r.k == 0) == ["percentage 12 against 21"]


@pytest.mark.parametrize(("token", "plain"), [("1,000", "1000"), ("3.50", "3.5"), ("7.0", "7"), ("007", "007"), ("100", "100"), ("10.00", "10")])
def test_numbers(spark, token, plain):
    assert spark.range(1).select(normal_number(F.lit(token)).alias("x")).first().x == plain


def test_stems(spark):
    words = ["fell", "fallen", "working", "works", "cats", "gas", "boxes", "uses", "thing", "red"]
    got = [r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select(stem(F.col("w")).alias("s")).collect()]
    assert got == ["#fall", "#fall", "#work", "#work", "cat", "gas", "box", "use", "thing", "red"]


def test_bind_scores_sets_once(spark):
    """The claim's words are cut once for each pair, and a scorer of one's own is still asked."""
    from attestine.operators import binder

    pairs = spark.createDataFrame([("Exports rose by 12%.", "u", "Exports rose by 12%. Exports fell by 30%.", "OK")], "claim string, source_url string, source_text string, verdict string")
    bound = binder.bind(pairs, binder.BinderConfig(tau=0.3, coref=False))
    row = bound.first()
    assert row.cited and row.cited_span == "Exports rose by 12%." and row.symbolic_ok
    cut = "regexp_extract_all(lower(claim"
    assert bound._jdf.queryExecution().optimizedPlan().toString().count(cut) <= 2  # the content words and the set
    own = binder.bind(pairs, binder.BinderConfig(tau=0.3, coref=False, scorer=lambda c, s: F.when(s.contains("fell"), 1.0).otherwise(0.0))).first()
    assert not own.cited and own.entailment == 1.0 and own.symbolic_ok is False
