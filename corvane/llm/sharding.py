"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group and stay together. Groups sorted by size enter the tightest shard with
room, found in a balanced tree. Equal sizes are alike to the packing, so it is computed for the histogram of group
sizes: how many groups of each size go where. A group then finds its shard by its size and its rank among groups of
that size, which distributed prefix sums give. The outcome is that of packing all groups one by one.

Scale: texts are read once; after that a few numbers a document move. The driver holds the histogram: different
sizes add up to no more than all bytes, so there are at most the square root of twice the bytes of them (245,000 at
30 GB), in practice as many as there are lengths of texts. Nothing is broadcast but what Spark finds small.

Defined results: a null text has no bytes and forms a group with the empty ones; a null doc_id is a document;
equal rows are separate members of a group; a group larger than a shard overfills one; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .capacity import pack_histogram
from .common import Shelf, loosened, read, running_sum


def shard(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot.

    shards: so many, each of an equal part of all bytes, or of capacity. With shards None, as few shards of capacity
    bytes as the packing needs; a group over the capacity then has a shard to itself.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "sharding")
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("digest"))
    rows = shelf.keep(rows, "rows")
    groups = shelf.keep(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    told = groups.groupBy("bytes").count().toArrow()
    histogram = dict(zip(told["bytes"].to_pylist(), told["count"].to_pylist(), strict=True))
    total = sum(k * n for k, n in histogram.items())
    runs, _ = pack_histogram(histogram, capacity or max(1, -(-total // (shards or 1))), shards)
    # a row for each size; its runs ascend by rank
    sizes = [(k, *zip(*(r[1:] for r in own), strict=True)) for k, own in ((k, list(own)) for k, own in groupby(runs, key=lambda r: r[0]))]
    kinds = (pa.int64(), *[pa.list_(pa.int64())] * 3)
    plan = spark.createDataFrame(pa.table([pa.array([x[i] for x in sizes], kind) for i, kind in enumerate(kinds)], ["bytes", "from", "first", "each"]))
    ranked = running_sum(groups.withColumn("one", F.lit(1)), ["bytes"], F.col("digest"), "one", "rank", ["digest"]).drop("one")
    ranked = ranked.join(loosened(plan, "bytes"), "bytes").withColumn("run", F.size(F.filter("from", lambda r: r <= F.col("rank"))))
    in_run = lambda c: F.element_at(c, F.col("run"))
    held = ranked.select("digest", (in_run("first") + F.floor((F.col("rank") - in_run("from")) / in_run("each"))).cast("int").alias("shard"))
    placed = rows.join(loosened(held, "digest"), "digest").select("doc_id", "size", "text_crc32", "shard")
    placed = shelf.keep(placed, "placed").withColumn("one", F.lit(1))
    return running_sum(placed, ["shard"], F.struct("doc_id", "text_crc32"), "one", "slot", ["doc_id", "text_crc32"]).drop("one")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
