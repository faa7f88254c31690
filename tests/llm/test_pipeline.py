"""The pipeline on a small fixture."""

import random
import zlib
from collections import Counter

import __spark_entry__
import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(1)
    vocab = [f"w{k}" for k in range(500)]
    base = [r.choice(vocab) for _ in range(200)]
    near = list(base)
    near[100] = "changed"
    rows = [(k, " ".join(r.choice(vocab) for _ in range(100)), "en", f"src{k % 3}", 1) for k in range(40)]
    rows += [(100, " ".join(base), "en", "src0", 1), (101, " ".join(near), "en", "src1", 1), (102, rows[0][1], "en", "src1", 1), (103, "123 456", "en", "src1", 1), (104, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        seen.append({x.doc_id for x in docs.collect()})
    everyone = {k for k, *_ in rows}
    assert seen == [everyone - {103, 104}, everyone - {103, 104, 0}, everyone - {103, 104, 0, 101}]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} <= seen[-1] and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out[0].asDict())
    assert "pipeline" in __spark_entry__.queries() and len([q for q in __spark_entry__.queries() if q.startswith("op")]) == 10


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component string, piece int, digest string, leaf string"


def test_stages_with_clashing_columns_repeats_and_nulls(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    r = random.Random(2)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    rows = [(k, say(80), "en" if k % 3 else None, f"src{k % 2}" if k % 5 else None) for k in range(30)]
    rows += [(50, say(9000), "en", "src0"), (51, None, None, None), (52, "", "en", "src1"), (53, "12", "en", "src1"), rows[1], rows[1], (None, say(40), "en", "src0"), (54, rows[2][1], "en", "src1")]
    docs = spark.createDataFrame([(*x, 1, "a", 2, "b", "c") for x in rows], COLUMNS)
    # each stage against a plain version of it, on its own input
    seen = docs
    for (name, stage), want in zip(
        corpus_pipeline.STAGES[:3],
        (
            lambda some: [x for x in some if x.text and any(c.isalpha() for c in x.text)],
            lambda some: list({x.text: x for x in sorted(some, key=lambda x: (x.doc_id is not None, x.doc_id or 0))}.values()),
            lambda some: some,
        ),
        strict=True,
    ):
        before = seen.collect()
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns, name
        assert Counter((x.doc_id, x.text) for x in seen.collect()) == Counter((x.doc_id, x.text) for x in want(before)), name
    before = Counter((x.doc_id, x.text) for x in seen.collect())
    mixed = corpus_pipeline.mix_sources(spark, seen, str(tmp_path))
    assert mixed.columns == docs.columns
    times = Counter((x.doc_id, x.text) for x in mixed.collect())
    assert set(times) <= set(before) and max(times.values()) <= 4 * max(before.values())
    budget, most = sum(len(t.split()) * n for (_, t), n in before.items()), max(len(t.split()) for _, t in before)
    assert 0 < sum(len(t.split()) * n for (_, t), n in times.items()) <= budget + 8 * most
    packed = corpus_pipeline.pack(spark, mixed, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_file())
    expected = Counter()
    for (doc, t), n in times.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[(doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += n
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in packed) == expected
    sequences = {}
    for x in packed:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
        docs = spark.createDataFrame([], COLUMNS)


def test_stages_free_the_driver_first(spark, tmp_path, monkeypatch):
    from attestine.llm import storage

    freed = []
    monkeypatch.setattr(storage, "free_shuffles", lambda s: freed.append("JVM"))
    monkeypatch.setattr(storage.kernels, "trim", lambda: freed.append("Python"))
    docs = spark.createDataFrame([(k, f"some words of document {k}", "en", "s", 1) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        freed.clear()
        stage(spark, docs, str(tmp_path))
        assert freed[:2] == ["JVM", "Python"], name
