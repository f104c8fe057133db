"""Streamed calls in any cut and order, the in-flight window, and the wait until a store is ready."""

from __future__ import annotations

import json
import random

import pytest

from corvane.streaming import calls
from corvane.streaming.ingest import InFlight, wait_ready

NAMED = [
    {"type": "response.reasoning_summary_text.delta", "delta": "hm"}, {"type": "response.output_text.delta", "delta": "Look"}, {"type": "response.output_text.delta", "delta": "ing."},
    {"type": "response.output_item.added", "item": {"type": "message"}}, {"type": "response.output_item.done"},
    {"type": "response.output_item.added", "item": {"type": "function_call", "name": "find", "call_id": "1"}}, {"type": "response.function_call_arguments.delta", "delta": '{"q": "a'},
    {"type": "response.function_call_arguments.delta", "delta": ' b"}'}, {"type": "response.output_item.done"},
    {"type": "response.output_item.added", "item": {"type": "function_call", "name": "stop", "call_id": "2"}}, {"type": "response.output_item.done"},
    {"type": "response.output_item.added", "item": {"type": "function_call", "name": "cut off", "call_id": "3"}}, {"type": "response.completed"},
]
call = lambda i, id_=None, name=None, args=None: {"index": i, "id": id_, "function": {"name": name, "arguments": args}}
CHAT = [{"choices": []}, {"choices": [{"delta": None}]}] + [{"choices": [{"delta": d}]} for d in (
    {"reasoning": "hm", "content": "not told"}, {"reasoning_content": "hm"}, {"content": "Look"}, {"content": "ing."}, {"tool_calls": [call(1, "2", "stop"), call(0, "1", "find", '{"q"')]},
    {"tool_calls": [call(0, args=': "a')], "content": "not told"}, {"tool_calls": [call(0, args=' b"}')]}, {"tool_calls": [call(3, "4", None, "{}")]}, {"tool_calls": [call(2, None, "nobody", "{}")]},
)]
WANT = ("Looking.", [("1", "find", '{"q": "a b"}'), ("2", "stop", "{}")])
SCHEMA = "response string, seq long, event string, last boolean"


def rows(name, events):
    return [(name, i, json.dumps(e), i == len(events) - 1 and "choices" in e) for i, e in enumerate(events)]


def told(df):
    return {r.response: (r.text, [tuple(c) for c in r.calls]) for r in df.collect()}


def test_both_shapes_give_the_same_calls(spark):
    own = rows("a", NAMED) + rows("b", CHAT)
    random.Random(1).shuffle(own)
    assert told(calls.whole(spark.createDataFrame(own, SCHEMA))) == {"a": WANT, "b": WANT}
    bad = [{"choices": [{"delta": {"tool_calls": [call(0, "1", "f", '{"torn')]}}]}]
    with pytest.raises(Exception, match="JSONDecodeError"):
        calls.whole(spark.createDataFrame(rows("x", bad), SCHEMA)).collect()
    assert calls.whole(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", [1])
def test_stream_of_any_cuts_tells_each_response_once(spark, tmp_path, seed):
    r = random.Random(seed)
    own = [x for n in range(4) for x in rows(f"a{n}", NAMED) + rows(f"b{n}", CHAT)]
    own += r.sample(own, 30)  # some come again
    r.shuffle(own)
    held = [x for x in own if x[0] == "a0" and x[1] == 3]  # one piece stays away
    own = [x for x in own if x not in held]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(0, len(own), 40):
        spark.createDataFrame(own[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    go = lambda: calls.stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(path), out, str(tmp_path / "c")).awaitTermination()
    go()
    everyone = {f"{k}{n}": WANT for n in range(4) for k in "ab"}
    assert told(spark.read.parquet(out)) == {k: v for k, v in everyone.items() if k != "a0"} and spark.read.parquet(out).count() == 7
    spark.createDataFrame(held[:1] + own[:20], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    go()
    assert told(spark.read.parquet(out)) == everyone and spark.read.parquet(out).count() == 8


def test_at_most_four_batches_are_in_flight(spark, tmp_path):
    log, sent, most = tmp_path / "log", [], []

    class Slow:
        def send(self, items, batch):
            done = len(list(log.glob("batch=*/_SUCCESS"))) if log.exists() else 0
            sent.append(batch)
            most.append(len(sent) - done)

    sink = InFlight(Slow(), lambda ids: {i: "errored" if i.endswith("3") else "completed" for i in ids}, str(log), window=4, sleep=lambda s: None)
    for b in range(9):
        sink.send(spark.createDataFrame([(f"{b}-{i}", "x") for i in range(5)], "id string, kind string"), b)
    assert sent == list(range(9)) and max(most) == 4 and len(sink.waiting) == 4
    assert sorted(int(p.name.removeprefix("batch=")) for p in log.glob("batch=*")) == list(range(5))  # the oldest first
    sink.finish()
    got = spark.read.parquet(str(log))
    assert got.count() == 45 and got.where("status = 'errored'").count() == 9
    # a status that cannot be had leaves its batch waiting
    broken = InFlight(Slow(), lambda ids: {}[0], str(tmp_path / "other"), window=1, sleep=lambda s: None)
    broken.send(spark.createDataFrame([("a", "x")], "id string, kind string"), 0)
    with pytest.raises(Exception, match="KeyError"):
        broken.finish()
    assert len(broken.waiting) == 1


def test_wait_until_ready():
    clock, answers = iter(range(100)), iter([{}, {"infra": {"ready_for_ingestion": False}}, {"infra": {"ready_for_ingestion": True}, "n": 1}])
    slept = []
    assert wait_ready(lambda: next(answers), clock=lambda: next(clock), sleep=slept.append)["n"] == 1 and slept == [20.0, 20.0]
    assert wait_ready(lambda: {"ready_for_ingestion": True})["ready_for_ingestion"]
    with pytest.raises(TimeoutError, match="not ready after 5 s: {'x': 1}"):
        wait_ready(lambda: {"x": 1}, timeout=5, clock=lambda c=iter(range(100)): next(c), sleep=slept.append)
