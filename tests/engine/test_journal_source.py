"""The journal source: splits, torn tails and streams of a growing file."""

from __future__ import annotations

import json

import pytest

from corvane.sources import journal

SCHEMA = "batch long, state string"


def line(n, extra=""):
    return json.dumps({"batch": n, "state": f"s{n}é{extra}"}, ensure_ascii=False) + "\n"


@pytest.mark.parametrize("split", [1, 7, 29, 1000])
def test_each_line_is_in_one_split(tmp_path, monkeypatch, split):
    monkeypatch.setattr(journal, "READ", 11)
    path = str(tmp_path / "j")
    data = "".join(line(i, "x" * (i % 40)) for i in range(30)).encode() + b"\n\nlast\ntorn"
    (tmp_path / "j").write_bytes(data)
    end = journal.whole(path)
    assert end == len(data) - 4
    got = [x for s in journal.splits(0, end, split) for x in journal.lines(path, s.start, s.end)]
    want, at = [], 0
    for part in data[:end].split(b"\n")[:-1]:
        want.append((at, part))
        at += len(part) + 1
    assert got == want
    assert journal.whole(str(tmp_path / "none")) == 0
    (tmp_path / "t").write_bytes(b"only a torn line")
    assert journal.whole(str(tmp_path / "t")) == 0


def test_batch_and_stream_give_the_same_rows_of_a_growing_journal(spark, tmp_path):
    path, out = tmp_path / "j", str(tmp_path / "out")
    stream = lambda: journal.read_stream(spark, str(path), SCHEMA, 64).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    texts = [line(0) + line(1), line(2) + line(3)[:9], line(3)[9:] + "\n" + line(4), line(5)[:-1]]
    whole = [2, 3, 5, 5]
    for text, n in zip(texts, whole, strict=True):
        with path.open("a", encoding="utf-8") as f:
            f.write(text)
        stream()
        batch = rows(journal.read(spark, str(path), SCHEMA, 50))
        assert [(b, s) for _, b, s in batch] == [(i, f"s{i}é") for i in range(n)]
        assert batch == rows(spark.read.schema(f"at long, {SCHEMA}").parquet(out))
    with path.open("a") as f:
        f.write("\nnot json\n")
    assert len(rows(journal.read(spark, str(path), SCHEMA).limit(1))) == 1
    with pytest.raises(Exception, match="(?i)malformed|bad record"):
        journal.read(spark, str(path), SCHEMA).collect()
    assert journal.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0
