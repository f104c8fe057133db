"""An append-only journal of lines as a data source, in batch and as a stream.

Offsets are bytes, so a row's place in the journal is the byte its line begins at, whoever reads it. The journal is read in
splits of a bounded size, by as many tasks; a line belongs to the split it begins in. A last line without its line end may
still be in the writer's hands: it is kept back until it is whole, in batch as in a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20
READ = 1 << 20


def opened(path: str):
    """(size, file) of a path of any store that Arrow opens; without a scheme it is a local one."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    return (0, None) if info.type == fs.FileType.NotFound else (info.size, store.open_input_file(at))


def whole(path: str) -> int:
    """Bytes up to the end of the last whole line; read from the end, a block at a time."""
    size, file = opened(path)
    if file is None:
        return 0
    with file:
        end = size
        while end > 0:
            start = max(0, end - READ)
            if (found := file.read_at(end - start, start).rfind(b"\n")) >= 0:
                return start + found + 1
            end = start
    return 0


@dataclass
class Split(InputPartition):
    start: int
    end: int


def splits(start: int, end: int, each: int) -> list[Split]:
    return [Split(a, min(a + each, end)) for a in range(start, end, each)]


def lines(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(byte, line) of the lines that begin in [start, end), the last one of which may end later."""
    if start >= end:
        return
    _, file = opened(path)
    with file:
        # a line begins at start only if a line ends right before it
        at = start if start == 0 else start - 1
        file.seek(at)
        skip = start > 0
        rest = b""
        while block := file.read(READ):
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            for line in parts:
                if skip:
                    skip = False
                elif at >= end:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if at >= end and not skip:
                return


class _Reading:
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("split", SPLIT))

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        places, found, size = [], [], 0
        names = ["at", "line"]
        for at, line in lines(self.path, partition.start, partition.end):
            if line.strip():
                places.append(at)
                found.append(line.decode("utf-8", "replace"))
                size += len(line)
            if size >= READ:
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.string())], names)
                places, found, size = [], [], 0
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(found, pa.string())], names)


class Reader(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        return splits(0, whole(self.path), self.each) or [Split(0, 0)]


class StreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        return {"bytes": whole(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits(start["bytes"], end["bytes"], self.each) or [Split(0, 0)]

    def commit(self, end: dict) -> None:
        pass


class Journal(DataSource):
    """Options: path, and split, the bytes of a split."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return "at long, line string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """at and the fields of each line; a line that is whole but no JSON object fails the read."""
    return rows.select("at", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("at", "r.*")


def read(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Journal)
    return parsed(spark.read.format("journal").option("path", path).option("split", split).load(), schema)


def read_stream(spark: SparkSession, path: str, schema: str, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(Journal)
    return parsed(spark.readStream.format("journal").option("path", path).option("split", split).load(), schema)
