"""Content identities of a corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record():
    """A document as the text that identities cover."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.col("doc_id"), F.lit("\x1f"), text("title"), F.lit("\x1f"), text("content"), F.lit("\n"))


def content_hash(corpus: DataFrame, group: str) -> DataFrame:
    """(group, n, sha256): SHA-256 of the group's records in id order. A group streams through one task, record by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, h = None, 0, None
        kind = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n]), pa.array([h.hexdigest()])], [group, "n", "sha256"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for own, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if h is None or own != now:
                    if h is not None:
                        yield told()
                    now, n, h = own, 0, hashlib.sha256()
                n += 1
                h.update(record.as_py().encode())
        if h is not None:
            yield told()

    rows = corpus.select(group, "doc_id", record().alias("record")).repartition(group).sortWithinPartitions(group, "doc_id", "record").select(group, "record")
    return rows.mapInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, n long, sha256 string")


def content_merkle(corpus: DataFrame, digits: int = 3) -> DataFrame:
    """(n, sha256): a hash of hashes. Records are hashed, then each bucket's sorted hashes, then the buckets'. A bucket is what a hash begins with.

    Not the same value as content_hash; it also covers source_type.
    """
    own = F.sha2(F.concat_ws("\x1f", F.coalesce("source_type", F.lit("")), record()), 256)
    rows = corpus.select(own.alias("h")).withColumn("b", F.substring("h", 1, digits))
    parts = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), ""), 256).alias("sha256"))


def fingerprint(value: object) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(part, problem) where two identities of a corpus (rows as content_hash tells, the group first) differ: it changed during a run."""
    group = before.columns[0]
    side = lambda df, name: df.select(F.col(group).alias("part"), F.struct("n", "sha256").alias(name))
    both = side(before, "a").join(side(after, "b"), "part", "full_outer")
    problem = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "vanished").when(F.col("a") != F.col("b"), "changed")
    return both.select("part", problem.alias("problem")).where("problem is not null")
