"""An incremental tree of hashes beside a corpus, by which two versions of it tell their changed documents.

A document's leaf is its record's hash, in the bucket of its id; a bucket's hash covers its leaves, and a node's
hash its 16 children, up to one root. An update hashes the documents it is given, reads the leaves of their buckets
alone and renews the nodes above them. A comparison begins at the roots and descends where hashes differ, so it reads the
leaves of buckets that hold a change and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import kept
from ..sources import manifest
from ..streaming.table import KeyedTable
from .identity import record

FAN = 4  # bits, so 16 children


def node(level: Column, number: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), number.cast("string"))


class Tree:
    """levels: below the root; there are 16 to that power buckets, which a new tree keeps for good."""

    def __init__(self, root: str, levels: int = 2):
        self.levels = levels
        self.leaves = KeyedTable(f"{root}/leaves", "doc_id", 1 << FAN * levels)
        self.nodes = KeyedTable(f"{root}/nodes", "node", 16)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(1 << FAN * self.levels)).cast("int")

    def update(self, corpus: DataFrame, removed: DataFrame | None = None) -> None:
        """Puts documents (as corpus rows) in or in the place of those with their ids, and takes removed ids (doc_id) out.

        If an update ended between leaves and nodes, the next one renews all nodes.
        """
        spark = corpus.sparkSession
        whole = self._sound(spark)
        own = kept(corpus.select("doc_id", F.sha2(F.concat_ws("\x1f", F.coalesce("source_type", F.lit("")), record()), 256).alias("h")), "leaves")
        gone = own.select("doc_id").limit(0) if removed is None else kept(removed.select("doc_id").distinct(), "gone")
        ids = own.select("doc_id").union(gone)
        touched = {r[0] for r in ids.select(self.bucket()).distinct().collect()} if whole else set(range(1 << FAN * self.levels))  # at most all buckets
        version = self.leaves.upsert(own, removed=gone)
        leaves = self.leaves.read(spark, touched)
        hashes = leaves.groupBy(self.bucket().alias("number")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: F.concat_ws("\x1f", x["doc_id"], x["h"])), "\n"), 256).alias("h"))
        every = spark.createDataFrame([(b,) for b in sorted(touched)], "number int")
        new = kept(every.join(hashes, "number", "left").select(F.lit(self.levels).alias("level"), "number", "h"), "nodes")  # without leaves, no hash
        old = self.nodes.read(spark).select("level", "number", "h") if manifest.latest(spark, self.nodes.root)[1] else new.limit(0)
        told = [new]
        for level in range(self.levels - 1, -1, -1):
            below = old.where(F.col("level") == level + 1).join(told[-1].select("number"), "number", "left_anti").select("level", "number", "h").union(told[-1].select("level", "number", "h"))
            above = below.withColumn("up", F.shiftright("number", FAN)).join(told[-1].select(F.shiftright("number", FAN).alias("up")).distinct(), "up", "left_semi")
            h = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("h").isNotNull(), F.struct("number", "h")))), lambda x: F.concat_ws(":", x["number"].cast("string"), x["h"])), "\n")
            above = above.groupBy("up").agg(F.when(F.count("h") > 0, F.sha2(h, 256)).alias("h"))
            told.append(kept(above.select(F.lit(level).alias("level"), F.col("up").alias("number"), "h"), "nodes"))
        rows = told[0]
        for t in told[1:]:
            rows = rows.union(t)
        self.nodes.upsert(rows.select(node(F.col("level"), F.col("number")).alias("node"), "level", "number", "h"), batch=version)

    def _sound(self, spark: SparkSession) -> bool:
        """Whether the nodes are those of the leaves' last version."""
        version, _ = manifest.latest(spark, self.leaves.root)
        _, nodes = manifest.latest(spark, self.nodes.root)
        return not version or (bool(nodes) and nodes["batch"] == version)

    def root_hash(self, spark: SparkSession) -> str | None:
        row = self.nodes.read(spark).where("level = 0").first()
        return row and row["h"]


def differing(spark: SparkSession, a: Tree, b: Tree) -> set[int]:
    """Buckets whose hashes differ, found from the roots down."""
    if a.levels != b.levels:
        raise ValueError("trees of different depth")
    for t in (a, b):
        if not t._sound(spark):
            raise ValueError(f"an update of {t.leaves.root} has not ended")
    numbers = [0]
    for level in range(a.levels + 1):
        if not numbers:
            return set()
        keys = [f"{level}:{n}" for n in numbers]
        side = lambda t, name: t.nodes.read(spark).where(F.col("node").isin(keys)).select("number", F.col("h").alias(name))
        both = side(a, "x").join(side(b, "y"), "number", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        found = sorted(r[0] for r in both.select("number").collect())
        numbers = found if level == a.levels else [n * (1 << FAN) + i for n in found for i in range(1 << FAN)]
    return set(numbers)


def changes(spark: SparkSession, before: Tree, after: Tree) -> DataFrame:
    """(doc_id, problem): documents that changed, appeared or vanished between two trees."""
    buckets = differing(spark, before, after)
    side = lambda t, name: t.leaves.read(spark, buckets).select("doc_id", F.col("h").alias(name))
    both = side(before, "a").join(side(after, "b"), "doc_id", "full_outer")
    problem = F.when(F.col("a").isNull(), "appeared").when(F.col("b").isNull(), "vanished").when(F.col("a") != F.col("b"), "changed")
    return both.select("doc_id", problem.alias("problem")).where("problem is not null")
