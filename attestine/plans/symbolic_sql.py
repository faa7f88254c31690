"""The symbolic rules once more, as SQL over token lists: what the queries' rows are held against."""

from __future__ import annotations

from attestine.functions import lexicon

_DOWN = [down for _, down in lexicon.DIRECTION_PAIRS]
_UP = [up for up, _ in lexicon.DIRECTION_PAIRS]
_QUANTIFIERS = [w for words in lexicon.QUANTIFIER_TIERS.values() for w in words]


def texts(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _has(words, x: str) -> str:
    return f"coalesce(list_contains({texts(words)}, {x}), FALSE)"


def _stem(w: str) -> str:
    families = " ".join(f"WHEN {_has(forms, w)} THEN '#{head}'" for head, forms in lexicon.VERB_FAMILIES.items())
    endings = " ".join(f"WHEN ends_with({w}, '{e}') AND length({w}) >= {len(e) + 3} THEN substr({w}, 1, length({w}) - {len(e)})" for e in ("ing", "ed", "es", "s"))
    return f"(CASE {families} {endings} ELSE {w} END)"


def _number(t: str) -> str:
    return f"(CASE WHEN contains({t}, '.') THEN regexp_replace(replace({t}, ',', ''), '\\.?0*$', '') ELSE replace({t}, ',', '') END)"


def _side(p: str) -> str:
    """The columns of one text, named with prefix p: lists of what the number rules compare, and word lists."""
    t = f"{p}t"
    at = f"range(1, len({t}) + 1)"
    number = f"regexp_matches({t}[i], '^[0-9]')"
    hedged = _has(lexicon.APPROX_CUES, f"{t}[i - 1]")
    bounded = f"({_has(lexicon.BOUND_CUES, f'{t}[i - 1]')} OR {_has(lexicon.BOUND_CUES, f"{t}[i - 2] || ' ' || {t}[i - 1]")} OR {_has(lexicon.BOUND_CUES, f"{t}[i - 3] || ' ' || {t}[i - 2] || ' ' || {t}[i - 1]")})"
    unit = f"({number} AND {_has(lexicon.UNITS, f'{t}[i + 1]')})"
    percent = f"({number} AND {_has(('%', 'percent'), f'{t}[i + 1]')})"
    pick = lambda what: f"list_distinct(list_transform(list_filter({at}, lambda i: {what} AND NOT {bounded}), lambda i: {_number(f'{t}[i]')}))"
    any_hedged = lambda what: f"len(list_filter({at}, lambda i: {what} AND NOT {bounded} AND {hedged})) > 0"
    year = f"regexp_matches(rtrim({t}[i], ','), '^[12][0-9]{{3}}$') AND {_has((*lexicon.DATE_CUES, *lexicon.MONTHS), f'{t}[i - 1]')} AND NOT {_has(lexicon.UNITS, f'{t}[i + 1]')}"
    month = _has(lexicon.MONTHS, f"{t}[i]")
    day = lambda j: f"coalesce(regexp_matches({t}[{j}], '^[0-9]{{1,2}},*$'), FALSE)"
    plain = lambda j: f"rtrim({t}[{j}], ',')::INT"
    dates = (
        f"list_concat(list_transform(list_filter({at}, lambda i: {month} AND {day('i + 1')}), lambda i: {t}[i] || ' ' || {plain('i + 1')}),"
        f" list_transform(list_filter({at}, lambda i: {month} AND {day('i - 1')}), lambda i: {t}[i] || ' ' || {plain('i - 1')}))"
    )
    index = f"list_transform(list_filter({at}, lambda i: {_has(lexicon.INDEX_NOUNS, f'{t}[i]')} AND coalesce(regexp_matches({t}[i + 1], '^[0-9]{{1,4}},*$'), FALSE)), lambda i: {t}[i] || ' ' || {plain('i + 1')})"
    numbers = f"list_transform(list_filter({t}, lambda x: regexp_matches(x, '^[0-9]')), lambda x: {_number('x')})"
    return f"""{pick(percent)} AS {p}percents, {any_hedged(percent)} AS {p}percents_hedged, {pick(unit)} AS {p}units, {any_hedged(unit)} AS {p}units_hedged,
list_transform(list_filter({at}, lambda i: {year}), lambda i: rtrim({t}[i], ',')) AS {p}years, {dates} AS {p}dates, {index} AS {p}indexed, {numbers} AS {p}numbers"""


def _words(p: str, words: str, clauses: str) -> str:
    """What the word rules compare."""
    at = f"range(1, len({clauses}) + 1)"
    denied = f"({_has(lexicon.NEGATION_CUES, f'{clauses}[i - 1]')} OR ({clauses}[i - 1] = 'to' AND {_has(lexicon.NEGATION_HEADS, f'{clauses}[i - 2]')}))"
    content = f"(length({clauses}[i]) >= 3 AND NOT {_has((*lexicon.CLAUSE_BREAKS, *lexicon.PROPOSITION_STOPWORDS), f'{clauses}[i]')} AND length({_stem(f'{clauses}[i]')}) >= 3)"
    said = lambda operators: f"list_concat(list_transform(list_filter({words}, lambda w: length(w) >= 3 AND NOT {_has((*lexicon.PROPOSITION_STOPWORDS, *operators), 'w')}), lambda w: {_stem('w')}), {p}numbers)"
    first = f"list_min(list_filter(range(1, len({words}) + 1), lambda i: {_has((*_UP, *_DOWN), f'{words}[i]')}))"
    plain = f"length(w) >= 2 AND NOT {_has((*lexicon.PROPOSITION_STOPWORDS, *_UP, *_DOWN), 'w')}"
    head = f"list_transform(list_filter({clauses}[i + 1 : i + 4], lambda w: length(w) >= 2 AND NOT {_has((*lexicon.QUANTIFIER_SKIPS, *_QUANTIFIERS), 'w')}), lambda w: {_stem('w')})[1]"
    turn = f"coalesce(list_min(list_filter({at}, lambda j: {_has((',', ';', *lexicon.CONTRASTS), f'{clauses}[j]')})), 100000)"
    quantified = f"list_filter(list_transform(list_filter({at}, lambda i: {_has(_QUANTIFIERS, f'{clauses}[i]')}), lambda i: {{'word': {clauses}[i], 'head': {head}, 'aside': i > {turn}}}), lambda z: z.head IS NOT NULL)"
    return f"""len(list_filter({at}, lambda i: {_has(lexicon.NEGATION_CUES, f'{clauses}[i]')} OR ({clauses}[i] = 'to' AND {_has(lexicon.NEGATION_HEADS, f'{clauses}[i - 1]')}))) > 0 AS {p}negates,
list_distinct(list_transform(list_filter({at}, lambda i: {content}), lambda i: {_stem(f'{clauses}[i]')})) AS {p}keys,
list_distinct(list_transform(list_filter({at}, lambda i: {content} AND NOT coalesce({denied}, FALSE)), lambda i: {_stem(f'{clauses}[i]')})) AS {p}affirmed,
{said(lexicon.NEGATION_CUES)} AS {p}said, {said(_QUANTIFIERS)} AS {p}said_q,
list_sort(list_distinct(list_filter({words}[1 : {first} - 1], lambda w: {plain}))) AS {p}subject,
list_transform(list_filter({words}[{first} + 1 : {first} + 3], lambda w: {plain} AND NOT {_has(lexicon.DIRECTION_ADVERBS, 'w')}), lambda w: {_stem('w')})[1] AS {p}object,
list_has_any({words}, {texts(_UP)}) AS {p}up, list_has_any({words}, {texts(_DOWN)}) AS {p}down, {quantified} AS {p}quantified"""


def _off(name: str) -> str:
    """Both lists have values, and one of the claim's is not in the span's, nor near one if hedged."""
    near = "CASE WHEN contains(x, '.') THEN 0.5 * pow(10, -length(string_split(x, '.')[2])) ELSE greatest(0.5, 0.05 * abs(x::DOUBLE)) END"
    return f"""(len(c{name}) > 0 AND len(s{name}) > 0 AND len(list_filter(c{name}, lambda x: NOT list_contains(s{name}, x)
      AND NOT ((c{name}_hedged OR s{name}_hedged) AND len(list_filter(s{name}, lambda y: abs(y::DOUBLE - x::DOUBLE) <= {near})) > 0))) > 0)"""


def _apart(name: str) -> str:
    what = lambda x: f"list_transform({x}, lambda v: string_split(v, ' ')[1])"
    both = f"list_intersect({what(f'c{name}')}, {what(f's{name}')})"
    return f"(len(list_filter({both}, lambda k: NOT list_contains({what(f'list_intersect(c{name}, s{name})')}, k))) > 0)"


_TIERS = " ".join(f"WHEN {_has(words, '{w}')} THEN {tier}" for tier, words in lexicon.QUANTIFIER_TIERS.items())
_OPPOSITE = texts([f"{x} {y}" for p in lexicon.QUANTIFIER_ANTONYMS for x, y in (p, p[::-1])])


def _tier(w: str) -> str:
    return "(CASE " + _TIERS.replace("{w}", w) + " END)"


_RIVALS = f"""list_filter(cquantified, lambda x: len(list_filter(squantified, lambda y: y.head = x.head AND y.word = x.word)) = 0
  AND len(list_filter(squantified, lambda y: y.head = x.head AND NOT y.aside AND y.word <> x.word AND (list_contains({_OPPOSITE}, x.word || ' ' || y.word) OR {_tier('x.word')} <> {_tier('y.word')}))) > 0)"""

RULES = {
    "percent_mismatch": _off("percents"),
    "unit_mismatch": _off("units"),
    "year_mismatch": "(len(cyears) > 0 AND len(syears) > 0 AND NOT list_has_any(cyears, syears) AND NOT list_has_any(cyears, snumbers))",
    "date_mismatch": _apart("dates"),
    "index_mismatch": _apart("indexed"),
    "negation_flip": """(cnegates <> snegates AND list_has_all(ssaid, csaid)
  AND len(list_filter(list_intersect(ckeys, skeys), lambda k: NOT list_contains(CASE WHEN cnegates THEN caffirmed ELSE saffirmed END, k))) > 0)""",
    "direction_flip": "((cup OR cdown) AND (sup OR sdown) AND len(csubject) > 0 AND csubject = ssubject AND cobject IS NOT DISTINCT FROM sobject AND NOT (cup AND sup) AND NOT (cdown AND sdown))",
    "quantifier_flip": f"(list_has_all(ssaid_q, csaid_q) AND len({_RIVALS}) > 0)",
}


def judged(pairs: str, out: str, keep: str = "*", rules=None) -> str:
    """CTEs that end in `out`: the columns `keep` of `pairs`, which has claim and span, and a boolean for each rule."""
    tokens = lambda x: f"regexp_extract_all(lower({x}), '[0-9][0-9,]*(?:\\.[0-9]+)?|[a-z]+|[~%]')"
    words = lambda x: f"regexp_extract_all(lower({x}), '[a-z'']+')"
    clauses = lambda x: f"regexp_extract_all(lower({x}), '[a-z'']+|[,;]')"
    lists = ", ".join(f"{f(x)} AS {p}{k}" for p, x in (("c", "claim"), ("s", "span")) for k, f in (("t", tokens), ("w", words), ("l", clauses)))
    flags = ", ".join(f"coalesce({RULES[name]}, FALSE) AS {name}" for name in rules or RULES)
    return f"""{out}_t AS (SELECT *, {lists} FROM {pairs}), {out}_n AS (SELECT *, {_side('c')}, {_side('s')} FROM {out}_t),
{out}_w AS (SELECT *, {_words('c', 'cw', 'cl')}, {_words('s', 'sw', 'sl')} FROM {out}_n), {out} AS (SELECT {keep}, {flags} FROM {out}_w)"""
