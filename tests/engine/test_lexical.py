"""Lexical scores by units of documents against loops."""

from __future__ import annotations

import math
import random

import pytest

from corvane.operators import retrieval


def by_hand(questions, docs, k):
    words = {d: t.split() for d, t in docs.items()}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = lambda t: sum(t in w for w in words.values())
    out = []
    for q, text in questions.items():
        score = {}
        for t in sorted(set(text.split())):
            idf = math.log(1 + (n - df(t) + 0.5) / (df(t) + 0.5))
            for d, w in words.items():
                if tf := w.count(t):
                    score[d] = score.get(d, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted((-round(s, 6), d) for d, s in score.items())[:k])]
    return sorted(out)


@pytest.mark.parametrize(("unit", "units", "asked", "products"), [((5, 9), 4, 2, 7), ((2048, 8192), 256, 256, 1 << 21)])
def test_units_tell_their_best_alone(spark, monkeypatch, unit, units, asked, products):
    for name, v in (("UNIT", unit), ("UNITS", units), ("ASKED", asked), ("PRODUCTS", products)):
        monkeypatch.setattr(retrieval, name, v)
    seen, top_k = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda scored, *a: seen.append(scored) or top_k(scored, *a))
    r = random.Random(7)
    docs = {f"d{i}": " ".join(r.choice(["the", "of", *(f"w{k}" for k in range(30)), "ä ö"]) for _ in range(r.randrange(1, 50))) for i in range(120)}
    docs |= {f"e{i}": "the w1 w1 of" for i in range(30)} | {"empty": ""}  # ties by id, more than k
    questions = {"q1": "the of w1", "q2": "w3 w4 ä ö w3", "q3": "absent", "q4": "", "q5": "the", "q6": "of w29 absent"}
    q = spark.createDataFrame(list(questions.items()), "question_id string, question string")
    got = retrieval.lexical(q, spark.createDataFrame(list(docs.items()), "doc_id string, content string").repartition(3), 4)
    plain = lambda rows: {a: b.replace("\u00a0", "_") for a, b in rows.items()}  # noqa: E731  no white space here, but to Python's split
    want = by_hand(plain(questions), plain(docs), 4)
    assert sorted((x.question_id, x.doc_id, x.score, x["rank"]) for x in got.collect()) == want
    n = -(-len(docs) // max(unit[0], min(unit[1], len(docs) // units)))
    assert seen[0].count() <= n * len(questions) * 4  # not a row for each question and document that share a word


def test_a_row_group_is_spread_however_many_tasks_its_file_is_split_into(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(400).selectExpr("'d' || id AS doc_id", "repeat(sha2(cast(id as string), 512), 20) AS content").coalesce(1).write.parquet(path)  # one row group
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        docs = spark.read.parquet(path)
        sizes = lambda df: df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(sizes(docs)) > 4 and max(sizes(docs)) == 400  # more tasks than cores, and one has all rows
        spread = retrieval.spread(docs)
        assert max(sizes(spread)) < 200 and sorted(spread.collect()) == sorted(docs.collect())
        even = docs.repartition(4)
        assert retrieval.spread(even) is even
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
