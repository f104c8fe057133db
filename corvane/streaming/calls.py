"""Whole answers and tool calls from the pieces that a model streams, in both shapes that services use.

Rows are (response, seq, event), event being the JSON that came. One shape names its events and announces each
call before its arguments come; the other sends choices whose calls have a number. Pieces of the model's reasoning
are no part of an answer. A call's arguments are its pieces in order of seq, {} if there are none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CALLS = "array<struct<call_id:string,name:string,args:string>>"
TOLD = f"text string, calls {CALLS}"
#: Events after which no more come.
LAST = ("response.completed", "response.failed", "response.incomplete")


class Fold:
    """Takes the events of one response in their order."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.numbered: dict[int, dict] = {}  # calls by their number
        self.told: list[dict] = []  # calls that were announced and are done
        self.current: dict | None = None

    def push(self, event: dict) -> None:
        if "choices" in event:
            for choice in event["choices"][:1]:
                self._choice(choice.get("delta") or {})
            return
        kind, item = event.get("type"), event.get("item") or {}
        if kind == "response.output_text.delta":
            self.text.append(event["delta"])
        elif kind == "response.output_item.added" and item.get("type") == "function_call":
            self.current = {"call_id": item.get("call_id"), "name": item.get("name"), "args": []}
        elif kind == "response.function_call_arguments.delta" and self.current is not None:
            self.current["args"].append(event["delta"])
        elif kind == "response.output_item.done" and self.current is not None:
            self.told.append(self.current)
            self.current = None

    def _choice(self, delta: dict) -> None:
        if delta.get("reasoning") or delta.get("reasoning_content"):
            return
        for piece in delta.get("tool_calls") or ():
            call, function = self.numbered.setdefault(piece["index"], {"call_id": None, "name": None, "args": []}), piece.get("function") or {}
            call["call_id"] = piece.get("id") or call["call_id"]
            call["name"] = function.get("name") or call["name"]
            call["args"].append(function.get("arguments") or "")
        if not delta.get("tool_calls") and delta.get("content"):
            self.text.append(delta["content"])

    def result(self) -> tuple[str, list[dict]]:
        """The text, and the calls that have a name and an id; arguments that are no JSON are an error."""
        calls = self.told + [self.numbered[i] for i in sorted(self.numbered)]
        out = []
        for c in calls:
            if c["name"] and c["call_id"]:
                args = "".join(c["args"]) or "{}"
                json.loads(args)
                out.append({"call_id": c["call_id"], "name": c["name"], "args": args})
        return "".join(self.text), out


def whole(events: DataFrame) -> DataFrame:
    """(response, text, calls) of all events: each response is folded as its rows stream by."""
    kind = events.schema["response"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        calls = pa.list_(pa.struct([(n, pa.string()) for n in ("call_id", "name", "args")]))

        def out(of: pa.DataType) -> pa.RecordBatch:
            text, told = fold.result()
            return pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([text]), pa.array([told], calls)], ["response", "text", "calls"])

        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            for response, event in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if fold is None or response != now:
                    if fold is not None:
                        yield out(of)
                    now, fold = response, Fold()
                fold.push(json.loads(event))
        if fold is not None:
            yield out(of)

    rows = events.select("response", "seq", "event").repartition("response").sortWithinPartitions("response", "seq").select("response", "event")
    return rows.mapInArrow(run, f"response {kind}, {TOLD}")


class Responses(StatefulProcessor):
    """By response: its events until the last one and all before it are there, in whatever cuts and order they come. seq counts from 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "seq long", "event string")
        self.size = handle.getValueState("size", "n long, have long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, have = self.size.get() or (None, 0)
        if n is not None and have >= n:
            return  # told already
        for r in rows:
            if not self.events.containsKey((r.seq,)):
                have += 1
                self.events.updateValue((r.seq,), (r.event,))
            if r.last:
                n = r.seq + 1
        self.size.update((n, have))
        if n is not None and have >= n:
            fold = Fold()
            for _, event in sorted((k[0], v[0]) for k, v in self.events.iterator()):
                fold.push(json.loads(event))
            self.events.clear()
            text, calls = fold.result()
            yield Row(response=key[0], text=text, calls=[Row(**c) for c in calls])

    def close(self) -> None:
        pass


def stream(events: DataFrame, path: str, checkpoint: str):
    """Starts a stream over events that writes each response once it is whole, and stops when all that is there has been taken.

    A response is whole with the row that has last, or an event that says so, and all of a smaller seq.
    """
    from .ledger import PROVIDER, ROCKS

    done = F.get_json_object("event", "$.type").isin(*LAST)
    last = F.coalesce(F.col("last") if "last" in events.columns else F.lit(False), F.lit(False)) | F.coalesce(done, F.lit(False))
    rows = events.select(F.col("response").cast("string").alias("response"), F.col("seq").cast("long").alias("seq"), "event", last.alias("last"))
    told = rows.groupBy("response").transformWithState(Responses(), f"response string, {TOLD}", "Append", "None")
    conf = rows.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        return told.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
