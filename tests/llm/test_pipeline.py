from __future__ import annotations

import corpus_pipeline
from corvane.llm import toxicity


def test_stages_take_effect(spark, tmp_path):
    docs = [(i, f"plain text number {i} " + " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(60)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs += [(100 + i, docs[i][1] + "  ", "en", "s0", 1) for i in range(10)]
    docs += [(200 + i, f"you awfulword {i} " + docs[i][1], "en", "s1", 1) for i in range(40)]
    docs += [(300, None, None, None, None), (301, "", "en", None, 0)]
    labels = [(d[0], 1, int(d[0] // 100 == 2)) for d in docs[:100]] + [(None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        at = spark.read.parquet(str(tmp_path / f"out{i}"))
        kept.append(at.toPandas())
    assert all(list(k.columns) == ["doc_id", "text", "lang", "source", "n_chars"] for k in kept[:4])
    clean = {d[0] for d in docs} - {200 + i for i in range(40)}
    assert set(kept[0].doc_id) == clean
    assert len(kept[1]) == 61 and not set(kept[1].doc_id) & set(range(10))  # the copy with more code points stays
    assert set(kept[2].doc_id) <= set(kept[1].doc_id) and len(kept[2]) >= 50
    assert set(kept[3].doc_id) <= set(kept[2].doc_id)
    assert {"doc_id", "sequence_id", "offset"} <= set(kept[4].columns) and len(kept[4]) == len(kept[3])


def test_stages_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert toxicity.THRESHOLD == 0.3


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what the one before kept of the smallest tables, against plain Python."""
    import os
    from collections import Counter, defaultdict

    import pytest

    from corvane.llm import mixing

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    norm = lambda t: "".join((t or "").translate({9: None, 10: None, 11: None, 12: None, 13: None, 32: None}))
    at = spark.read.parquet(f"{sf}/documents.parquet")
    score = toxicity.query_model(spark, sf).scorer()
    frames = [at.toPandas()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, sf).write.parquet(str(tmp_path / f"{i}"))
        at = spark.read.parquet(str(tmp_path / f"{i}"))
        frames.append(at.toPandas())
    given, clean, exact, near, mixed, packed = frames
    assert set(clean.doc_id) == {d for d, t in zip(given.doc_id, given.text, strict=True) if score(t or "") < toxicity.THRESHOLD}
    best = {}
    for d, t in zip(clean.doc_id, clean.text, strict=True):
        best[norm(t)] = min(best.get(norm(t), (1, 0)), (-len(t or ""), d))
    assert sorted(exact.doc_id) == sorted(d for _, d in best.values())
    ids = exact.doc_id.tolist()
    grams = [[tuple((t or "").encode().lower().split()[j:][:5]) for j in range(max(1, len((t or "").split()) - 4))] for t in exact.text]
    sets, root = [set(g) for g in grams], {d: d for d in ids}
    for _ in range(5):
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if len(a & b) >= 0.8 * len(a | b):
                    root[ids[i]] = root[ids[j]] = min(root[ids[i]], root[ids[j]])
    assert sorted(near.doc_id) == sorted(set(root.values()))
    size = {d: len((t or "").encode().split()) for d, t in zip(near.doc_id, near.text, strict=True)}
    source, copies, taken, total = dict(zip(near.doc_id, near.source, strict=True)), Counter(mixed.doc_id), Counter(), Counter()
    aims = {r.source: r.target for r in mixing.mix(spark.createDataFrame(near)).select("source", "target").distinct().collect()}
    largest = defaultdict(int)
    for d, n in size.items():
        taken[source[d]] += n * copies[d]
        total[source[d]] += n
        largest[source[d]] = max(largest[source[d]], n)
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    assert all(abs(taken[s] - aims[s]) <= largest[s] / 2 + 1 for s in total)
    assert Counter(packed[packed.piece == 0].doc_id) == copies
    load = packed.groupby("sequence_id").length.sum()
    assert load.max() <= 4096 and len(load) <= packed.length.sum() / 4096 * 1.1 + 2


def test_toxicity_tells_large_batches_in_small_ones(spark, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import DataFrame

    from corvane.llm import toxicity

    docs, ran = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: ran.append(run) or self)
    assert isinstance(toxicity.drop_toxic(docs, toxicity.Model(prior=0.1)), DataFrame)
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(1201)), "text": ["x", None, ""] * 400 + ["y"]})
    out = list(ran[0](iter([whole, whole.slice(0, 0)])))
    assert max(b.num_rows for b in out) <= toxicity.ROWS
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == list(range(1201))
