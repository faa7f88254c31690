"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from attestine.llm import compact_windows, components, exact_dedup, minhash_dedup, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_shingles long, bucket string"
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark, texts):
    return spark.createDataFrame([(k, t, None, None, 1, "x") for k, t in enumerate(texts)], DOCS)


def words(seed, n, vocab=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocab)}é" if r.random() < 0.1 else f"w{r.randrange(vocab)}" for _ in range(n)]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}


def corpus():
    out = [None, "", "   \n", "One", "ONE", "a b", "A B"]
    for seed in range(6):
        base = words(seed, 120)
        out.append(" ".join(base))
        for copy in range(12):
            r, w = random.Random(seed * 100 + copy), list(base)
            for _ in range(copy % 7):
                w[r.randrange(len(w))] = f"edit{r.randrange(9)}"
            out.append("\t".join(w) if copy % 2 else " ".join(w))
    return out + ["same text"] * 40 + [" ".join(words(99, 9000))]


def test_exact_groups(spark):
    docs = table(spark, corpus())
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    groups = {}
    for k, t in enumerate(corpus()):
        groups.setdefault(t or "", []).append(k)
    assert len(got) == len(corpus())
    for text, ids in groups.items():
        for k in ids:
            assert (got[k].keep_id, got[k].group_size, got[k].kept, got[k].text_sha256) == (max(ids), len(ids), k == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_exact_groups_without_ids_and_with_clashing_columns(spark, batches):
    rows = [(None, "a"), (3, "a"), (None, "b"), (None, "b"), (7, "c"), (7, "c"), (9, None), (1, "")]
    docs = spark.createDataFrame([(k, t, "d", 1, 2) for k, t in rows], "doc_id long, text string, digest string, hot int, keep_id int")
    got = sorted(((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, batches=batches).collect()), key=str)
    assert got == sorted([(-1, 3, 2, False), (3, 3, 2, True), (-1, None, 2, True), (-1, None, 2, True), (7, 7, 2, True), (7, 7, 2, True), (9, 9, 2, True), (1, 9, 2, False)], key=str)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or -1, r.text) for r in out.collect() if r.text) == [(-1, "b"), (3, "a"), (7, "c")]


def test_exact_index_is_persistent(spark):
    index = exact_dedup.DigestIndex(spark, "digests_test")
    docs = table(spark, ["a", "a", "b", None])
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(docs, index).collect()) == [1, 2, 3]
    more = docs.withColumn("doc_id", F.col("doc_id") + 10).union(spark.createDataFrame([(20, "c", None, None, 1, "x")] * 3, DOCS))
    again = exact_dedup.deduplicate(more, index)
    assert [r.doc_id for r in again.collect()] == [20] and again.columns == docs.columns
    assert index.rows().count() == 4
    assert sorted(r.group_size for r in index.rows().collect()) == [2, 2, 3, 4]  # later copies count
    groups = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(spark.createDataFrame([(30, "a", None, None, 1, "x")], DOCS), index).collect()}
    assert groups == {30: (1, 5, False)}
    plan = index.rows().join(index.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
    index.drop()


@pytest.mark.parametrize("width", [2, 5])
def test_near_groups(spark, width):
    texts = corpus()
    sets = [shingles(t, width) for t in texts]
    parent = list(range(len(texts)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_groups(table(spark, texts), width, 80).collect()}
    assert got == {k: (len(sets[k]), top(k), top(k) == k) for k in range(len(texts))}


def components_of(sets, linked):
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if b < a and linked(sets[a], sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {k: top(k) for k in sets}


def alike(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def test_near_groups_of_copies_mostly_under_the_threshold(spark, monkeypatch):
    """Copies of one text with up to 20 of 150 words changed: many are like some other copies only; blocks are small here."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    base, texts = words(50, 150, 60), []
    for k in range(260):
        r, w = random.Random(k), list(base)
        for _ in range(k % 21):
            w[r.randrange(len(w))] = f"w{r.randrange(60)}"
        texts.append(" ".join(w))
        if k % 20 > 14:  # another copy with one word changed
            w[r.randrange(len(w))] = "again"
            texts.append(" ".join(w))
    sets = {k: shingles(t, 2) for k, t in enumerate(texts)}
    want = components_of(sets, alike)
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_groups(table(spark, texts), 2, 80).collect()}
    assert got == want and 10 < len(set(want.values())) < 200


def test_near_groups_of_one_doc_id_with_two_texts(spark):
    one, two, three = (words(k, 60) for k in (61, 62, 63))
    rows = [(5, one), (5, two), (9, one[:-1]), (8, two[1:]), (7, three), (7, three), (6, three[1:])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_groups(docs, 2, 80).collect())
    assert got == [(5, 5, True), (5, 5, True), (6, 6, True), (7, 6, False), (7, 6, False), (8, 5, False), (9, 5, False)]


def test_near_dedup_passes_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "x y z w v u", 1, "a", 2, "c", 3) for k in range(3)], "doc_id long, text string, hub long, component string, size long, residue string, sketch long")
    out = minhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(0, "x y z w v u", 1, "a", 2, "c", 3)]


def test_near_dedup_keeps_columns_and_empty_tables(spark):
    docs = table(spark, ["x y z w v u"] * 3 + [None, None])
    out = minhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 3, 4]
    assert minhash_dedup.near_groups(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    import numpy as np

    r = np.random.default_rng(1)
    common, a, b = r.integers(0, 1 << 63, 900, dtype=np.uint64), r.integers(0, 1 << 63, 50, dtype=np.uint64), r.integers(0, 1 << 63, 50, dtype=np.uint64)
    samples = minhash_dedup._samples(np.concatenate([common, a, common, b]), np.array([0, 950, 1900]), 128)
    bitmaps = minhash_dedup._sketches(samples, 1024)
    assert abs(minhash_dedup.odd_sketch_similarity(bitmaps[:1], bitmaps[1:], 128)[0] - 0.9) < 0.1


def test_components(spark):
    r = random.Random(3)
    links = [(k, k + 1) for k in range(60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(30)]
    parent = {n: n for pair in links for n in pair}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for n in {n for a, b in links if a != b for n in (a, b)}}


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shift", [0, -1000])
def test_suffix_dedup(spark, shift):
    passage = " ".join(words(5, 60))
    texts = corpus()[:40] + ["ab" * 400, "x" * 150, "x" * 100, "x" * 99, f"start {passage} end", f"other {passage}", passage * 3, None, ""]
    docs = table(spark, texts).withColumn("doc_id", F.col("doc_id") + shift)
    got = {r.doc_id - shift: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 100)))


def test_suffix_dedup_long_texts_and_short_periods(spark):
    """Texts in pieces of 1000 bytes, longer than a number's 2^10 places; runs of one byte and short periods."""
    passage = " ".join(words(6, 60))
    long = " ".join(words(7, 900))
    texts = [f"{long} {passage}", "x" * 9000, "abc" * 2000, f"{passage} {long[2000:]} {long[:700]}", "y" + "x" * 300 + "abc" * 90, "lorem ipsum " * 300, None, " ".join(words(8, 300)) + "x" * 400, "-" * 99]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(table(spark, texts), place_bits=10, most=1000).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 100)))


def test_bundles_of_a_megabyte_of_one_byte():
    import numpy as np

    for unit, left in ((b"x", 1), (b"ab", 2)):
        data = np.frombuffer(unit * (1_000_000 // len(unit)), np.uint8)
        _, _, count, _, repeats, _ = suffix_dedup.bundles(data, np.array([0, len(data)]), 100, 50)
        assert count.sum() == left and len(repeats) == len(data) - 99 - left


def test_rank_pairs_in_shares(spark):
    """Shares hold every window once, and equal windows are in one share."""
    text = "".join(random.Random(4).choices("abcdefgh", k=400)).encode()
    rows = spark.createDataFrame([(0, 301, text), (1 << 28, 301, text)], "at long, n int, bytes binary")
    whole = [tuple(r) for r in suffix_dedup._rank_pairs(rows, 100, 27).collect()]
    shares = [[tuple(r) for r in suffix_dedup._rank_pairs(rows, 100, 27, part, 4).collect()] for part in range(4)]
    assert sorted(sum(shares, [])) == sorted(whole) and len(whole) == 602
    assert all(shares) and sum(len({r[1:] for r in s}) for s in shares) == len({r[1:] for r in whole}) == 301


def test_suffix_dedup_repeated_rows_and_empty(spark):
    text = " ".join(words(8, 50))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.remove_repeats(docs, keep_text=True).collect()) == [0, len(text.encode()), len(text.encode())]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_cartesian_windows():
    import numpy as np

    r = np.random.default_rng(2)
    hashes = r.integers(0, 1 << 63, 90, dtype=np.uint64)
    first = np.array([0, 50, 50, 90])
    lo, c, hi = compact_windows.cartesian_windows(hashes, first, 8)
    for a, b in ((0, 50), (50, 90)):
        for x in range(a, b):
            for y in range(x + 7, b):
                at = x + int((hashes[x : y + 1] >> np.uint64(32)).argmin())
                assert ((lo <= x) & (x <= c) & (c <= y) & (y <= hi) & (c == at)).sum() == 1
                assert ((lo <= x) & (x <= c) & (c <= y) & (y <= hi)).sum() == 1


def test_near_passages(spark):
    passage = words(21, 80, 10_000)
    edited = list(passage)
    edited[40] = "changed"
    fill = lambda seed: " ".join(words(seed, 150, 10_000))
    texts = [f"{fill(1)} {' '.join(passage)} {fill(2)}", fill(3), f"{fill(4)} {' '.join(passage)}", f"{' '.join(edited)} {fill(5)}", None, "", fill(6)]
    rows = compact_windows.near_passages(table(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {2, 3} and all(r.similarity >= 0.8 for r in rows)
    whole = next(r for r in rows if r.doc_id == 2)
    assert whole.like_doc_id == 0 and whole.start_word <= 150 + 1 and whole.end_word >= 150 + 79 and whole.like_start_word == whole.start_word
    assert compact_windows.near_passages(table(spark, texts[:1])).count() == 0
    assert compact_windows.near_passages(table(spark, ["x"]).limit(0)).count() == 0


def edited_passages(n, seed=31, least=60, most=90):
    """n passages of distinct words, each with a copy that has words put in, left out and changed."""
    r, out = random.Random(seed), []
    for _ in range(n):
        base = words(r.random(), r.randrange(least, most), 100_000)
        copy = list(base)
        for _ in range(r.randrange(1, 4)):
            p, kind = r.randrange(len(copy)), r.randrange(4)
            copy[p : p + (kind != 1)] = {0: ["changed"], 1: ["new"], 2: [], 3: words(r.random(), 4, 100_000)}[kind]
        out.append((base, copy))
    return out


def hashes_of(some):
    import numpy as np

    from attestine.llm import kernels

    data = np.frombuffer(" ".join(some).encode(), np.uint8)
    return kernels.shingle_hashes(*kernels.word_hashes(data, np.array([0, len(data)])), 5)[0]


def brute_match(a, b, least, similar):
    """Whether any stretches of a and b have the similarity; shingles of each differ."""
    import numpy as np

    shared = np.zeros((len(a) + 1, len(b) + 1), int)
    shared[1:, 1:] = (a[:, None] == b[None, :]).cumsum(0).cumsum(1)
    at = np.arange(len(b) + 1)
    size = at[None, :] - at[:, None]
    for i in range(len(a) - least + 1):
        for j in range(i + least, len(a) + 1):
            both = (shared[j] - shared[i])[None, :] - (shared[j] - shared[i])[:, None]
            if ((size >= least) & (both >= similar * (j - i + size - both) - 1e-9)).any():
                return True
    return False


def test_matched_stretch_against_brute_force():
    import numpy as np

    found = 0
    for k, (base, copy) in enumerate(edited_passages(40)):
        copy = copy[30:] + copy[:30] if k % 8 == 0 else copy
        a, b = hashes_of(words(k + 200, 9, 90_000) + base + words(k + 300, 6, 90_000)), hashes_of(words(k + 400, 4, 90_000) + copy + words(k + 500, 9, 90_000))
        hits = [compact_windows.matched_stretch(a, b, i, int(j), 46, 0.8) for i in range(len(a)) for j in np.flatnonzero(b == a[i])]
        hits = [h for h in hits if h]
        assert bool(hits) == brute_match(a, b, 46, 0.8)
        assert all(min(h[1] - h[0], h[3] - h[2]) >= 46 and compact_windows.likeness(a[h[0] : h[1]], b[h[2] : h[3]]) >= 0.8 for h in hits)
        found += bool(hits)
    assert 10 < found < 40


def test_near_passages_with_a_word_put_in(spark):
    passage = words(22, 60, 10_000)
    texts = [" ".join(words(1, 40, 10_000) + passage + words(2, 40, 10_000)), " ".join(words(3, 50, 10_000) + passage[:30] + ["extra"] + passage[30:] + words(4, 30, 10_000))]
    (row,) = compact_windows.near_passages(table(spark, texts)).collect()
    assert (row.doc_id, row.like_doc_id) == (1, 0) and row.end_word - row.start_word >= 60 and row.similarity >= 0.8


def test_near_passages_keep_links_within_other_matches(spark):
    """C is like A as a whole; 50 words in the midst, where A differs, are B's."""
    c = words(41, 200, 100_000)
    a = [f"other{k}" if k in (85, 96, 107, 118) else w for k, w in enumerate(c)]
    b = words(43, 40, 100_000) + c[80:130] + words(44, 40, 100_000)
    rows = compact_windows.near_passages(table(spark, [" ".join(x) for x in (a, b, c)])).collect()
    assert {(r.doc_id, r.like_doc_id) for r in rows} == {(2, 0), (2, 1)}


def test_near_passages_meet():
    """Passages that brute force finds similar share a key that verification takes for a seed."""
    import numpy as np

    alike = met = 0
    for k, (base, copy) in enumerate(edited_passages(400, seed=7, least=50, most=60)):
        texts = [words(k + 1000, 9, 90_000) + base, copy + words(k + 2000, 9, 90_000)]
        a, b = (hashes_of(t) for t in texts)
        if not brute_match(a, b, 46, 0.8):
            continue
        alike += 1
        raw = [" ".join(t).encode() for t in texts]
        key, doc, place = compact_windows._keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5, 46)
        places = [{}, {}]
        for m, d, p in zip(key.tolist(), doc.tolist(), place.tolist(), strict=True):
            places[d].setdefault(m, set()).add(p)
        seeds = {(i, j) for m in places[0].keys() & places[1].keys() for i in places[0][m] for j in places[1][m]}
        met += any(compact_windows.matched_stretch(a, b, i, j, 46, 0.8) is not None for i, j in seeds)
    assert alike > 100 and met == alike


def test_joint_windows_of_repeated_texts():
    """Windows and their pairs against brute force, where many hashes are equal and functions stand one after the other."""
    import numpy as np

    r = np.random.default_rng(5)
    some = [np.tile(r.integers(0, 1 << 63, n, dtype=np.uint64), 1 + 120 // n)[:120] for n in (3, 40, 120, 7)]
    first = np.array([0, 4, 60, 60, 112, 120])
    windows = [compact_windows._windows([x, y], first, 8) for x, y in (some[:2], some[2:])]
    for (x, y), (lo, c, hi) in zip((some[:2], some[2:]), windows, strict=True):
        want = set()
        for k, h in enumerate((x, y)):
            high = h >> np.uint64(32)
            for a, b in zip(first[:-1], first[1:], strict=True):
                for at in range(a, b):
                    left = max([p + 1 for p in range(a, at) if high[p] <= high[at]], default=a)
                    right = min([p - 1 for p in range(at + 1, b) if high[p] < high[at]], default=b - 1)
                    if right - left + 1 >= 8:
                        want.add((left + 120 * k, at + 120 * k, right + 120 * k))
        assert set(zip(lo.tolist(), c.tolist(), hi.tolist(), strict=True)) == want and len(lo) == len(want)
    a, b = windows
    got = list(zip(*(x.tolist() for x in compact_windows.joint_windows(a, b, 8)), strict=True))
    fits = lambda i, k: max(a[0][i], b[0][k]) <= min(a[1][i], b[1][k]) and max(a[1][i], b[1][k]) <= min(a[2][i], b[2][k]) and min(a[2][i], b[2][k]) - max(a[0][i], b[0][k]) >= 7
    assert sorted(got) == [(i, k) for i in range(len(a[0])) for k in range(len(b[0])) if fits(i, k)]


def test_may_match_loses_no_match():
    import numpy as np

    dropped = 0
    for k, (base, copy) in enumerate(edited_passages(60, seed=77)):
        repeat = base[:12] * (k % 3)
        a, b = hashes_of(words(k + 200, 60, 90_000) + base + repeat), hashes_of(repeat + copy + words(k + 500, 60, 90_000))
        seeds = np.array([(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(b == a[i])])
        may = compact_windows.may_match(a, b, seeds[:, 0], 46, 0.8) & compact_windows.may_match(b, a, seeds[:, 1], 46, 0.8)
        dropped += int((~may).sum())
        assert all(compact_windows.matched_stretch(a, b, int(i), int(j), 46, 0.8) is None for i, j in seeds[~may])
    assert dropped > 50


def test_places_within_a_period_are_not_members():
    """Of a text that goes round, the first and the last place of a key are left; all that they stand for have a match there, too."""
    import numpy as np

    goes_round = words(71, 3, 10_000) * 300
    raw = [" ".join(words(72, 60, 10_000) + goes_round + words(73, 60, 10_000)).encode(), " ".join(words(74, 90, 10_000) + goes_round[:240]).encode()]
    key, doc, place = compact_windows._keys(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5, 46)
    assert np.unique(np.stack([key, doc.astype(np.uint64)]), axis=1, return_counts=True)[1].max() == 2 and len(key) < 600
    a, b = (hashes_of(t.decode().split()) for t in raw)
    places = [{m: place[(doc == d) & (key == m)] for m in key[doc == d]} for d in range(2)]
    seeds = [(int(i), int(j)) for m in places[0].keys() & places[1].keys() for i in places[0][m] for j in places[1][m]]
    assert any(compact_windows.matched_stretch(a, b, i, j, 46, 0.8) for i, j in seeds)
    value, times = compact_windows._meetings(key, doc, place, 46)
    far = {m for p in places for m in p if p[m][-1] - p[m][0] >= 46}
    assert set(value[times > 1].tolist()) == {int(m) for m in far | (places[0].keys() & places[1].keys())}
    none = compact_windows._keys(np.frombuffer(b"short text", np.uint8), np.array([0, 10]), 5, 46)
    assert [len(x) for x in compact_windows._meetings(*none, 46)] == [0, 0]


def test_may_meet_loses_no_match():
    """Both sides together: more pairs of places are left out than by each side alone, none with a match."""
    import numpy as np

    dropped = alone = 0
    for k, (base, copy) in enumerate(edited_passages(60, seed=78)):
        a, b = hashes_of(words(k + 200, 60, 90_000) + base + base[:12] * (k % 3)), hashes_of(base[:12] * (k % 3) + copy + words(k + 500, 60, 90_000))
        seeds = np.array([(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(b == a[i])])
        may = compact_windows.may_meet(a, b, seeds[:, 0], seeds[:, 1], 46, 0.8)
        match = np.array([compact_windows.matched_stretch(a, b, int(i), int(j), 46, 0.8) is not None for i, j in seeds])
        assert may[match].all()
        each = compact_windows.may_match(a, b, seeds[:, 0], 46, 0.8) & compact_windows.may_match(b, a, seeds[:, 1], 46, 0.8)
        dropped, alone = dropped + int((~may).sum()), alone + int((~each).sum())
    assert dropped > 1.1 * alone > 50


def test_joined_classes(spark):
    pairs = [[(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (31, 21)], [(5, 6), (6, 30)]]
    comps, seen = None, []
    for some in pairs:
        comps = compact_windows._joined_classes(spark.createDataFrame(some, "a long, b long"), comps)
        seen += some
        want = components.connected_components(spark.createDataFrame(seen, "a long, b long"))
        assert sorted(map(tuple, comps.collect())) == sorted(map(tuple, want.collect()))


def test_near_passages_of_copies(spark):
    """Copies have a row for the whole, and no row that compares them with others."""
    passage = words(61, 70, 10_000)
    texts = [words(62, 30, 10_000) + passage, passage + words(63, 80, 10_000)]
    rows = compact_windows.near_passages(table(spark, [" ".join(texts[k]) for k in (0, 1, 1, 0, 1)] + ["short text"] * 2)).collect()
    whole = {(r.doc_id, r.start_word, r.end_word, r.like_doc_id) for r in rows if r.doc_id > 1}
    assert whole == {(2, 0, 150, 1), (3, 0, 100, 0), (4, 0, 150, 1)}
    assert [(r.doc_id, r.like_doc_id) for r in rows if r.doc_id <= 1] == [(1, 0)] and all(r.similarity >= 0.8 for r in rows)


def test_near_dedup_keeps_rows_without_doc_id(spark):
    texts = [(None, "x y z w v u"), (None, "x y z w v u"), (None, None), (None, "q r s t u v w"), (1, "x y z w v u"), (2, "x y z w v u")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = minhash_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, texts[:5]))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in minhash_dedup.near_groups(docs).collect())
    assert got == [(False, 1, 1, True), (False, 2, 1, False)] + [(True, 0, None, True)] * 4
