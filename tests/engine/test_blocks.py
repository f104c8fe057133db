"""Nearest vectors in blocks, row numbers and batches over ranges, against loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corvane.operators import ordering, retrieval, vectors


def by_hand(queries, rows, k):
    out = []
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
    for q, a in queries:
        if not ok(a):
            continue
        found = []
        for d, b in rows:
            if ok(b) and len(b) == len(a):
                x, y = np.array(a, dtype=float), np.array(b, dtype=float)
                found.append((-round(float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)), 6), d))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("least", "slice_", "block"), [(20, 7, 3), (10_000, 64, 512)])
def test_nearest_equals_comparing_all(spark, monkeypatch, least, slice_, block):
    for name, v in (("LEAST", least), ("SLICE", slice_), ("QUERIES", block)):
        monkeypatch.setattr(vectors, name, v)
    r = np.random.default_rng(4)
    rows = [(f"d{i:03}", [float(np.float32(x)) for x in r.normal(0, 1, 6)]) for i in range(150)]
    rows += [(f"e{i}", rows[3][1]) for i in range(30)]  # ties by id, more than k
    rows += [("z0", None), ("z1", [0.0] * 6), ("z2", [float("nan")] * 6), ("z3", [None] * 6), ("z4", []), ("s1", [1.0, 2.0]), ("s2", [2.0, 1.0]), ("big", [1e30] * 6)]
    queries = [(i, rows[i][1]) for i in range(0, 40, 3)] + [(900, [1.0, 2.0]), (901, None), (902, [0.0] * 6), (903, [5.0])]
    d = spark.createDataFrame(rows, "doc_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame(queries, "question_id long, vector array<double>")
    got = retrieval.dense(q, d, 8)
    assert sorted((x.question_id, x.doc_id, x.score, x["rank"]) for x in got.collect()) == by_hand(queries, rows, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert retrieval.dense(q, d.limit(0), 8).count() == 0 and retrieval.dense(q.limit(0), d, 8).count() == 0


def test_row_numbers(spark):
    rows = [(random.Random(i).randrange(300), i) for i in range(500)] + [(None, -1)]
    got = ordering.row_numbers(spark.createDataFrame(rows, "k int, v int").repartition(5), "k", total="n").collect()
    assert sorted(r.ordinal for r in got) == list(range(501)) and {r.n for r in got} == {501}
    ordered = [r.k for r in sorted(got, key=lambda r: r.ordinal)]
    assert ordered == [None, *sorted(k for k, _ in rows if k is not None)]
    assert ordering.row_numbers(spark.createDataFrame([], "k int"), "k").count() == 0


def fold(sizes, batch_size):
    out, number, n = [], 0, 0
    for s in sizes:
        out.append(number)
        n += s or 0
        if n >= batch_size:
            number, n = number + 1, 0
    return out


@pytest.mark.parametrize("seed", range(30))
def test_transfers_of_runs_add_up(seed):
    r = random.Random(seed)
    sizes, batch_size = [r.choice([0, 1, 2, 3, 9, 40]) for _ in range(r.randrange(60))], r.choice([1, 2, 7, 30, 500])
    cuts = sorted(r.randrange(len(sizes) + 1) for _ in range(4))
    number = open_ = 0
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        for before in range(batch_size):  # any batch that is open
            n, closed = before, 0
            for s in sizes[a:b]:
                n += s
                if n >= batch_size:
                    n, closed = 0, closed + 1
            assert ordering.applied(ordering.transfer(sizes[a:b], batch_size), before) == (closed, n)
        closed, open_ = ordering.applied(ordering.transfer(sizes[a:b], batch_size), open_)
        number += closed
    assert number == (fold([*sizes, 0], batch_size)[-1] if sizes else 0)


@pytest.mark.parametrize("batch_size", [1, 7, 1000])
def test_batches_of_a_hot_lane_equal_the_fold(spark, monkeypatch, batch_size):
    r = random.Random(batch_size)
    rows = [("hot" if r.random() < 0.7 else r.choice(["a", "b", None]), f"d{i:04}", r.choice([0, 1, 2, 5, 30, None])) for i in range(900)]
    want = set()
    for lane in {x[0] for x in rows}:
        own = sorted((d, s) for name, d, s in rows if name == lane)
        want |= {(lane, d, b) for (d, _), b in zip(own, fold([s for _, s in own], batch_size), strict=True)}
    tables, real = [], ordering.kept
    monkeypatch.setattr(ordering, "kept", lambda df, name: tables.append(real(df, name)) or tables[-1])
    conf = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "lane string, doc_id string, size int").repartition(5)
        got = {tuple(x) for x in ordering.consecutive_batches(df, batch_size).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", conf)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert tables[0].where("__lane = 'hot'").select("__part").distinct().count() > 4  # one lane over many tasks
    assert ordering.consecutive_batches(df.limit(0), batch_size).count() == 0


def test_bootstrap_sketch_adds_up_and_covers(spark):
    from corvane.operators import metrics

    r = np.random.default_rng(2)
    rows = [(f"q{i}", float(x), "a" if i % 3 else "b") for i, x in enumerate(r.normal(2, 5, 400))]
    df = spark.createDataFrame(rows, "question_id string, delta double, grp string").repartition(4)
    whole = metrics.sketch(df, 400, 1)
    halves = metrics.sketch(df.where("delta > 2"), 400, 1).union(metrics.sketch(df.where("delta <= 2"), 400, 1))
    one, two = metrics.interval(whole, 400).first(), metrics.interval(halves, 400).first()
    assert one.low == pytest.approx(two.low) and one.high == pytest.approx(two.high)
    deltas = np.array([x for _, x, _ in rows])
    error = deltas.std() / np.sqrt(len(deltas))
    assert abs(one.low - (deltas.mean() - 1.96 * error)) < 0.5 * error and abs(one.high - (deltas.mean() + 1.96 * error)) < 0.5 * error
    told = whole.collect()
    times = np.array([x.times for x in told])
    assert len(told) == 400 and abs(times.mean() - 400) < 5 and 15 < times.std() < 25  # Poisson of mean 400
    assert {x.part for x in metrics.interval(metrics.sketch(df, 50, 1, by="grp"), 50).collect()} == {"a", "b"}


def test_short_passages_meet_parts_of_words(spark):
    r = random.Random(3)
    docs = [(f"d{i}", " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(12)))) for i in range(80)] + [("e", ""), ("n", None), ("w", "a  b")]
    passages = ["a", "ab", "abc", "abca", "ab c", "c ab", "b b", "a  b", "", " ", "zz", "cab abc", "bca a b", None]
    q = spark.createDataFrame([(f"q{i}", p) for i, p in enumerate(passages)] + [("again", "ab")], "question_id string, passage string")
    got = retrieval.gold_pairs(q, spark.createDataFrame(docs, "doc_id string, content string"))
    want = sorted((f"q{i}", d) for i, p in enumerate(passages) if p is not None for d, t in docs if t is not None and p in t)
    want += [("again", d) for d, t in docs if t is not None and "ab" in t]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plain = retrieval.gold_pairs(q.where("length(trim(passage)) > 0"), spark.createDataFrame(docs, "doc_id string, content string"))
    assert plain.count() == sum(passages[int(x[0][1:])].strip() != "" if x[0] != "again" else True for x in want)
