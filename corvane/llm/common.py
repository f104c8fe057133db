"""What the operators share: written tables that cut lineage, distributed prefix sums, connected components.

Every helper keeps all rows. None collects rows whose number grows with the corpus.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Characters that separate words, as a class body for Java, Python and RE2 patterns alike.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows that go to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where it is unset one of our own.

    Unset on a cluster: a folder in the warehouse, which is shared too. Unset in local mode: a temporary folder,
    as driver and executors are one process there.
    """
    if there := spark.conf.get("spark.checkpoint.dir", None):
        return there.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        there = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    else:
        there = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corvane_checkpoints"
    spark.conf.set("spark.checkpoint.dir", there)
    return there


class Shelf:
    """Tables written to the shared folder under one run's own name. Reading one back starts a new lineage.

    A lost executor costs nothing that was written: the files outlive it. drop() removes a table that nothing
    reads any more, clear() all of a shelf's; what is left goes when the driver ends.
    """

    opened: list[Shelf] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Shelf.opened.append(self)
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """df as a table. The shuffle files behind it go as soon as it is written: nothing reads them any more.

        batch: most rows that go to a Python worker at once, where rows hold whole texts.
        """
        path, conf = f"{self.root}/{name}", self.spark.conf
        own = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
        before = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(_nullable(df.schema)).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm, jsc = self.spark._jvm, self.spark.sparkContext._jsc
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)

    def clear(self) -> None:
        if self in Shelf.opened:
            Shelf.opened.remove(self)
            atexit.unregister(self.clear)
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the session may be gone when the driver ends; the folder then stays to its owner
            pass


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def loosened(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, dealt out by another hash of keys.

    A small side that was just aggregated by the join's key needs no exchange of its own, and Spark then cannot
    split the other side's hot partitions. Dealt otherwise, both sides get an exchange for the join and Spark's
    skew join can split. Only for small sides.
    """
    return df.repartition(F.xxhash64(*[F.col(k) for k in keys], F.lit("loosened")))


def bucketed(df: DataFrame, group: list[str], key: Column, rows_per_bucket: int = 1024) -> DataFrame:
    """df with __key (a hash of key) and __bucket (the range of the key within its group).

    A group gets buckets in proportion to its rows, so a hot group is spread over many and a small one has one.
    Group columns must not be null.
    """
    counts = loosened(df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).cast("long").alias("__buckets")), *group)
    # 31 bits of the key pick the range, so ranges are equal shares of the hash and ascend with it
    out = df.join(counts, group).withColumn("__key", F.shiftrightunsigned(F.xxhash64(key), 1))
    return out.withColumn("__bucket", F.shiftright(F.shiftright(F.col("__key"), 32) * F.col("__buckets"), 31)).drop("__buckets")


def running_sum(df: DataFrame, group: list[str], key: Column, value: str, out: str, order: list[str] = (), rows_per_bucket: int = 1024) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group before this one, in the order of a hash of key.

    Distributed prefix sums: each range of the hashed keys is summed, the sums are accumulated along the ranges
    of a group, and each range sorts its own rows and starts from its offset. No task holds more than a few
    ranges, however large a group is. Rows with equal key and order columns are taken in any order. df is read
    twice, so it should be a written table.
    """
    parts, by = bucketed(df, group, key, rows_per_bucket), [*group, "__bucket"]
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*by).agg(F.sum(value).alias("__sum"))
    sums = sums.select(*by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).cast("long").alias("__offset"))
    within = Window.partitionBy(*by).orderBy("__key", *order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("__offset") + F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long")
    return parts.join(sums, by).withColumn(out, total).drop("__key", "__bucket", "__offset")


def components(shelf: Shelf, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root): root is the smallest node that node reaches over edges (a, b). Nodes without edges are absent.

    Alternating large-star and small-star rounds over written edge tables until a round changes nothing; the
    edges of a node are never gathered in one row, and only counts reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, turn = shelf.keep(e, f"{name}-0"), 0
    seen = None
    while True:
        # large-star: every larger neighbour of a node moves to the node's smallest neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = loosened(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shelf.keep(large, f"{name}-{turn}-large")
        # small-star: a node and its smaller neighbours move to the smallest of them
        least = loosened(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        turn += 1
        new = shelf.keep(small, f"{name}-{turn}")
        shelf.drop(f"{name}-{turn - 1}", f"{name}-{turn - 1}-large")
        e = new
        mark = e.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").bitwiseAND(0xFFFFFFFF))).first()
        if mark == seen:
            break
        seen = mark
    # all edges are stars now: each node points to its root
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a unique number for each row, which tells equal rows apart.

    The number follows from the row's place in its partition. Operators evaluate docs more than once and rely on
    equal numbers each time; so docs must be a table as read, or anything else that keeps rows in their places.
    """
    return docs.withColumn(name, F.monotonically_increasing_id())


def spare(docs: DataFrame, name: str) -> str:
    """name, or a like name where docs has such a column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str, columns: Iterable[str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)
