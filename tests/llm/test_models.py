"""Packing, mixing, language models, fingerprints and licence scans against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestine.llm import ctw, lang_ppm, license_scan, mixing, packing, queries, spotsigs

DOCS = "doc_id long, text string, lang string, source string, score double"
WORDS = {"en": "the of and house river stone with under light that from".split(), "fr": "le la des été rivière pierre avec sous lumière que dans".split()}


def text(seed, n, lang="en"):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", ",", "."]) for _ in range(n))


def docs(spark, extra=()):
    rows = [(k, text(k, 5 + 7 * (k % 30), ("en", "fr")[k % 2]), ("en", "fr")[k % 2], f"src{k % 3}", 0.5) for k in range(120)]
    rows += [(200, None, "en", "src0", None), (201, "", None, None, None), (202, "12 34", "en", "src0", None), (203, text(9, 20_000), "en", "src1", None), (204, rows[3][1], "fr", "src0", None), *extra]
    return spark.createDataFrame(rows, DOCS)


def pieces_of(ids):
    return [(k, s, ids[s : s + 2048]) for k, s in enumerate(range(0, len(ids), 2048))]


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file())
    encode = packing.word_encoder(queries.tokenizer_file())
    for t in ("it's we're 3.14 x_y -- ''s", "a b\x1cc d", "İstanbul Ⱥ ẞß", "<|endoftext|> a<|b", "café café œuvre", "你好 мир", "ΣΑΣ", "", " \n\t ", text(1, 300, "fr")):
        assert encode(t) == np.asarray(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_packing(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_file())
    table = docs(spark)
    want = {(r.doc_id, k): (s, len(p), zlib.crc32(np.asarray(p, "<u4").tobytes())) for r in table.collect() for k, s, p in pieces_of([*plain.encode(r.text or "", add_special_tokens=False).ids, 0])}
    rows = packing.pack_documents(table, queries.tokenizer_file()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    whole = packing.sequences(table, queries.tokenizer_file()).collect()
    assert len(whole) == len(by) and sum(r.length for r in whole) == sum(r.length for r in rows)
    assert packing.pack_documents(table.limit(0), queries.tokenizer_file()).count() == 0


def test_sum_of_squares_rule():
    r = random.Random(4)
    sizes, capacity = [r.randint(1, 20) for _ in range(300)], 20
    bins, offsets = packing.sum_of_squares(np.array(sizes), capacity)
    gaps, level = Counter(), {}
    for size, at, offset in zip(sizes, bins, offsets, strict=True):
        best = min(sum(v * v for g, v in (gaps - Counter({gap: 1}) + Counter({gap - size: 1})).items() if g) for gap in [g for g, v in gaps.items() if g >= size and v] + [capacity]) if True else 0
        old = level.get(at, capacity)
        assert offset == capacity - old and old >= size
        if at in level:
            gaps[old] -= 1
        level[at] = old - size
        gaps[old - size] += 1
        gaps[0] = 0
        gaps += Counter()
        assert sum(v * v for v in gaps.values()) == best
    with pytest.raises(ValueError):
        packing.sum_of_squares(np.array([21]), 20)


def test_budgets():
    w = mixing.Weights({("a",): 3.0, ("b",): 1.0})
    supply = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 40, ("b", "x", "1"): 1000}
    got = mixing.budgets(supply, 400, w, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 250, ("a", "y", "1"): 40, ("b", "x", "1"): 100}  # the shortage of y goes to its sibling x, not to b
    assert mixing.budgets(supply, 10_000, w, 2)[("a", "x", "1")] == 20 and mixing.budgets({}, 5, w, 1) == {}
    with pytest.raises(ValueError):
        mixing.budgets({("c",): 1}, 1, mixing.Weights({("c",): -1.0}), 1)


def test_mix(spark):
    table = docs(spark, [(5, "one more row of five", "fr", "src2", None)])
    out = mixing.mix(table, 1.3, mixing.Weights({("*", "fr"): 3.0}), max_epochs=3, seed=1)
    assert out.columns[:5] == table.columns
    size = {}
    for r in table.collect():
        size.setdefault(("", r.lang or "", r.source or ""), []).append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    budget = mixing.budgets({k: sum(n for _, n in v) for k, v in size.items()}, 1.3 * sum(n for v in size.values() for _, n in v), mixing.Weights({("*", "fr"): 3.0}), 3)
    taken = {}
    for r in out.collect():
        taken.setdefault(tuple(r.leaf), []).append((r.epoch, r.doc_id))
    place = {(e, r.doc_id): r.h for e in range(4) for r in table.select("doc_id", F.xxhash64(F.lit(1), F.lit(e), F.col("doc_id")).alias("h")).collect()}
    for leaf, rows in size.items():
        total = sum(n for _, n in rows)
        epochs, want, left = (budget[leaf] // total, [], budget[leaf] % total) if total else (0, [], 0)
        want = [(e, d) for e in range(epochs) for d, _ in rows]
        before = 0
        for d in sorted({d for d, _ in rows}, key=lambda d: place[epochs, d]):
            if before >= left:
                break
            want += [(epochs, x) for x, _ in rows if x == d]
            before += sum(n for x, n in rows if x == d)
        assert sorted(taken.get(leaf, [])) == sorted(want)
    assert mixing.mix(table.limit(0), 1.0, mixing.Weights()).count() == 0


def test_language_id(spark):
    table = docs(spark)
    train = table.filter(~lang_ppm.held_out(4, 2))
    rows = {r.doc_id: r for r in lang_ppm.predict(table.select("doc_id", "text"), lang_ppm.train(train)).collect()}
    assert all(rows[k].lang_pred == ("en", "fr")[k % 2] and 0.5 < rows[k].score <= 1 for k in range(10, 120))
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (200, 201, 202))
    none = lang_ppm.predict(table, lang_ppm.train(table.filter("lang = 'xx'")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    kept = lang_ppm.keep_recognised(table)
    assert kept.columns == table.columns and kept.filter("doc_id = 10").first().score == 0.5 and {r.doc_id for r in kept.collect()}.isdisjoint({200, 201, 202})


def test_language_id_letters_and_code_length(spark):
    rows = [(k, text(k, 60, ("en", "fr")[k % 2]), ("en", "fr")[k % 2]) for k in range(60)]
    rows += [(100, "²½ Ⅷ ①", "en"), (101, "Ж" * 40, None), (102, "the", None), (103, text(500, 20000, "en"), None), (104, text(7, 60, "fr"), "fr"), (104, text(7, 60, "fr"), "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bits_per_byte", F.lit("clash"))
    got = {r.doc_id: r for r in lang_ppm.predict(table.drop("lang"), lang_ppm.train(table)).collect()}
    assert got[100].lang_pred == "und" and got[101].bits_per_byte >= lang_ppm.MOST_BITS > got[102].bits_per_byte and got[103].lang_pred == "en" and got[104].lang_pred == "fr"
    kept = lang_ppm.keep_recognised(table)
    assert kept.columns == table.columns and {r[0] for r in rows} - {r.doc_id for r in kept.collect()} == {100, 101}
    assert lang_ppm.keep_recognised(table.limit(0)).count() == 0


def ppm_bits(train, data, order=3):
    """Straightforward PPM, method C with exclusion, frozen."""
    tables = [Counter() for _ in range(order + 1)]
    for b in train:
        p = b"\n\n\n" + b
        for k in range(3, len(p)):
            for o in range(order + 1):
                tables[o][p[k - o : k], p[k]] += 1
    bits, p = 0.0, b"\n\n\n" + data
    for k in range(3, len(p)):
        gone, chance = set(), 1.0
        for o in range(order, -1, -1):
            have = {s: n for s in range(256) if s not in gone and (n := tables[o][p[k - o : k], s])}
            if not have:
                continue
            total = sum(have.values()) + len(have)
            if p[k] in have:
                chance *= have[p[k]] / total
                break
            chance *= len(have) / total
            gone |= set(have)
        else:
            chance /= 256 - len(gone)
        bits -= math.log2(chance)
    return bits


def test_ppm_code_lengths():
    train = [text(k, 30, "fr").encode() for k in range(5)]
    data = np.frombuffer(b"".join(train), np.uint8)
    offs = np.cumsum([0, *map(len, train)])
    gram, times = np.unique(lang_ppm.kernels.byte_grams(data, offs), return_counts=True)
    model = lang_ppm.build({"fr": (gram.astype(np.int64), times)})
    for t in (text(77, 10, "fr"), "zzz Ω le la", ""):
        b = t.encode()
        got = lang_ppm.code_lengths(model, np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0, 0]
        assert got == pytest.approx(ppm_bits(train, b), rel=1e-4, abs=1e-3)


def ctw_bits(train, data, depth=ctw.DEPTH):
    """Straightforward context tree weighting with frozen counts."""
    counts = {}
    for b in train:
        p = b"\n" * depth + b
        for k in range(depth, len(p)):
            for d in range(depth + 1):
                node = 1
                for bit in range(7, -1, -1):
                    x = p[k] >> bit & 1
                    counts.setdefault((p[k - d : k], node), [0, 0])[x] += 1
                    node = 2 * node + x
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    children = {}
    for c, n in counts:
        if c:
            children.setdefault((c[1:], n), []).append((c, n))
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted(c) for c in children[key])) - math.log(2)
        return memo[key]

    bits, p = 0.0, b"\n" * depth + data
    for k in range(depth, len(p)):
        node = 1
        for bit in range(7, -1, -1):
            x, left, chance = p[k] >> bit & 1, 1.0, 0.0
            for d in range(depth + 1):
                key = (p[k - d : k], node)
                if key not in counts:
                    break
                share = 1.0 if d == depth else math.exp(kt(*counts[key]) - math.log(2) - weighted(key))
                chance += left * share * (counts[key][x] + 0.5) / (sum(counts[key]) + 1)
                left *= 1 - share
            bits -= math.log2(chance + left * 0.5)
            node = 2 * node + x
    return bits


def test_context_tree_and_base_score(spark):
    table = docs(spark).filter("doc_id < 40 OR doc_id IN (200, 201, 202)")
    rows = {r.doc_id: r for r in ctw.score(table, ~lang_ppm.held_out(7, 2), heavy_words=8).collect()}
    every = {r.doc_id: r.text or "" for r in table.collect()}
    train = {k for k in every if zlib.crc32(str(k).encode()) % 7 != 2}
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.lower()), "END"]
    c = Counter(w for k in train for w in tokens(every[k]))
    n, v = sum(c.values()), len(c)
    seen = [every[k].lower().encode() for k in sorted(train)]
    assert len(rows) == len(every) and any(r.held_out for r in rows.values())
    for k, t in every.items():
        assert rows[k].held_out == (k not in train) and rows[k].train_tokens == n
        assert rows[k].n_tokens == len(tokens(t)) and rows[k].n_known == sum(w in c for w in tokens(t))
        assert rows[k].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
    for k in (0, 1, 9, 12, 201):
        assert rows[k].score == pytest.approx(-ctw_bits(seen, every[k].lower().encode()) * math.log10(2), rel=1e-4, abs=1e-6)
    for most in (0, 60):  # grams that are not broadcast give the same scores, in rows of their own where a text has many
        few = {r.doc_id: r.score for r in ctw.score(table, ~lang_ppm.held_out(7, 2), heavy_grams=most).collect()}
        assert all(few[k] == pytest.approx(r.score, rel=1e-9) for k, r in rows.items())
    flat = {r.doc_id: r.score for r in ctw.score(table, ~lang_ppm.held_out(7, 2), depth=3).collect()}
    assert flat[9] == pytest.approx(-ctw_bits(seen, every[9].lower().encode(), 3) * math.log10(2), rel=1e-6)
    none = ctw.score(table, F.lit(False)).filter("doc_id = 0").first()
    assert none.train_tokens == 0 and none.bits_per_byte == pytest.approx(8)


def test_context_tree_on_odd_tables(spark):
    long = text(5, 60_000)
    rows = [(1, long, "en", "s", 1.0), (1, long, "en", "s", 1.0), (None, "x" * 1000, "en", "s", 1.0), (3, "é", None, None, None), (4, None, None, None, None)]
    table = spark.createDataFrame(rows, DOCS).withColumn("held_out", F.lit("x")).withColumn("rare", F.lit(1)).withColumn("uid", F.lit(0)).withColumn("gram", F.lit(0))
    got = ctw.score(table, F.lit(True)).collect()
    few = ctw.score(table, F.lit(True), heavy_grams=0).collect()
    by = lambda rs: sorted((r.doc_id or 0, r.score) for r in rs)
    assert len(got) == len(few) == 5 and len(long) > ctw._RARE
    assert all(a[0] == b[0] and a[1] == pytest.approx(b[1], rel=1e-9) for a, b in zip(by(got), by(few), strict=True))
    assert by(got)[0][0] == 0 and {s for k, s in by(got) if k == 4} == {0.0} and len({s for k, s in by(got) if k == 1}) == 1
    assert ctw.score(table.limit(0), F.lit(True)).count() == 0


def test_whole_subtrees(monkeypatch):
    monkeypatch.setattr(ctw, "_BLOCK", 20)
    r = random.Random(1)
    gram = np.sort(np.unique([r.randrange(12) << 24 | r.randrange(1 << 24) for _ in range(600)] + list(range(5 << 24, (5 << 24) + 90))))
    batches = [pa.RecordBatch.from_arrays([pa.array(gram[k : k + 7]), pa.array(gram[k : k + 7] % 5)], ["gram", "n"]) for k in range(0, len(gram), 7)]
    blocks = list(ctw.whole_subtrees(iter(batches), 5))
    assert np.array_equal(np.concatenate([g for g, _ in blocks]), gram) and all(np.array_equal(n, g % 5) for g, n in blocks)
    assert len(blocks) > 5 and all(a[0][-1] >> 24 < b[0][0] >> 24 for a, b in zip(blocks, blocks[1:], strict=False))


def test_long_texts_in_pieces():
    r = random.Random(3)
    data = np.array([r.randrange(256) for _ in range(5000)], np.uint8)
    offs = np.array([0, 0, 1, 3, 700, 700, 701, 5000])
    whole = ctw.path_grams(data, offs, 0, 5000, 5)
    assert np.array_equal(np.concatenate([ctw.path_grams(data, offs, lo, min(lo + 7, 5000), 5) for lo in range(0, 5000, 7)]), whole)
    assert whole[700] == int.from_bytes(bytes([10] * 5 + [data[700]]), "big") and whole[699] == int.from_bytes(bytes([*data[694:699][::-1], data[699]]), "big")


def test_spot_signatures(spark):
    table = docs(spark).filter("doc_id < 30 OR doc_id >= 200")
    rows = {r.doc_id: r for r in spotsigs.fingerprints(table).collect()}
    every = {r.doc_id: r.text or "" for r in table.collect()}
    ids = sorted(every)
    anchors = set(spotsigs.ANCHORS)

    def signatures(t):
        w = re.sub(r"[\W_]+", " ", t.lower()).split()
        out = set()
        for k, x in enumerate(w):
            if x in anchors and k + 1 < len(w) and w[k + 1] not in anchors:
                chain = [y for y in w[k + 1 :] if y not in anchors][:2]
                if len(chain) == 2:
                    out.add((x, *chain))
        return out or ({tuple(w)} if w else set())

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, i in enumerate(ids):
        follower = every[ids[(k + 1) % len(ids)]]
        t = every[i]
        q = len(t) // 4
        edited = t[: len(t) - q] + follower[:q]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(rows[i].fingerprint) == 8 * len(signatures(t))
        assert rows[i].near_edited == pytest.approx(alike(signatures(t), signatures(edited)))
        assert rows[i].near_next == pytest.approx(alike(signatures(t), signatures(follower)))
    assert rows[204].fingerprint == rows[3].fingerprint
    assert spotsigs.fingerprints(table.limit(0)).count() == 0
    one = spotsigs.fingerprints(table.filter("doc_id = 3")).first()
    assert one.near_next == 1.0
    membership, pairs = spotsigs.similar_pairs(table.filter("doc_id < 30 OR doc_id = 204"), 0.3)
    assert {r.doc_id: r.class_id for r in membership.collect()}[204] == 3
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if alike(signatures(every[a]), signatures(every[b])) >= 0.3 - 1e-9}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_ranges_of_documents(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 7)
    table = spark.range(100).select((F.col("id") * 3 - 50).alias("doc_id"), F.concat(F.lit("the "), F.col("id").cast("string"), F.lit(" river stone")).alias("text"))
    assert all(r.near_next == 0 for r in spotsigs.fingerprints(table).collect())
    got = {r.doc_id: r.edited_sha256 for r in spotsigs.fingerprints(table).collect()}
    rows = [(r.doc_id, r.text) for r in table.orderBy("doc_id").collect()]
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        assert got[i] == hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest()


def test_license_scan(spark):
    filler = text(5, 200)
    rows = [(1, f"{filler}\nReleased under the MIT License.\n{filler}"), (2, filler), (3, license_scan.TEMPLATES["MIT-grant"].replace("free of charge", "gratis") + filler), (4, None), (5, ""), (6, "license license licensed under nothing at all"), (7, "licensed under CC BY-NC 4.0"), (7, "licensed under CC BY-NC 4.0")]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(1, "MIT"), (3, "MIT-grant"), (7, "CC-BY-NC-4.0")}
    assert got[1, "MIT"].containment == 1.0 and got[1, "MIT"].first_word <= 200 < got[1, "MIT"].last_word and 0.8 <= got[3, "MIT-grant"].containment < 1
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_needed_words_lose_nothing():
    for t in license_scan.TEMPLATES.values():
        w = license_scan._words(t)
        runs = [w[k : k + 5] for k in range(max(1, len(w) - 4))]
        need = license_scan.needed_words(t, 0.8)
        assert sum(not set(need) & set(r) for r in runs) < 0.8 * len(runs)


def test_license_scan_against_brute_force(spark):
    """Every window of the operator against every template, without bands; edited bodies, a very long text, repeated rows and clashing names."""
    r = random.Random(5)
    rows = [(k, text(k, 40)) for k in range(4)] + [(9, None), (10, ""), (11, "MIT"), (12, text(1, 9000) + " " + license_scan.TEMPLATES["ISC-body"])]
    for k, body in enumerate(license_scan.TEMPLATES.values()):
        for edits in range(4):
            w = body.split()
            for _ in range(edits * len(w) // 60):
                w[r.randrange(len(w))] = "changed"
            rows.append((100 + 10 * k + edits, " ".join([text(k, 30), *w, text(k + 1, 20)])))
    rows.append(rows[-1])
    docs = spark.createDataFrame([(k, t, "a", 1, 2) for k, t in rows], "doc_id long, text string, license string, start int, have int")
    want = {name: set(license_scan_runs(spark, body)) for name, body in license_scan.TEMPLATES.items()}
    classes = license_scan._classes(license_scan.TEMPLATES, 0.8)
    expected = {}
    for x in license_scan.windows(docs, license_scan.TEMPLATES).distinct().collect():
        for name in classes[x["class"]]["names"]:
            held = len(set(x.have) & want[name]) / len(want[name])
            if held >= 0.8 - 1e-9:
                expected.setdefault((x.doc_id, name), []).append((held, x.start))
    got = {(x.doc_id, x.license): (x.containment, x.n_windows) for x in license_scan.scan(docs).collect()}
    assert got == {k: (max(h for h, _ in v), len({s for _, s in v})) for k, v in expected.items()}
    assert (12, "ISC-body") in got and len(got) > 40
    # the windows of texts that no needed word lets through would find nothing
    every = {x.doc_id for x in license_scan.windows(docs, license_scan.TEMPLATES).select("doc_id").distinct().collect()}
    for k, t in rows:
        if k not in every:
            runs = set(license_scan_runs(spark, t)) if t else set()
            assert all(len(runs & w) < 0.8 * len(w) for w in want.values())
    assert license_scan.scan(docs.limit(0)).count() == 0 and license_scan.scan(docs, {}).count() == 0


def license_scan_runs(spark, body):
    return spark.createDataFrame([(body,)], "t string").select(license_scan.shingles(F.col("t")).alias("r")).first().r
