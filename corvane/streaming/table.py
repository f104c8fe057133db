"""A table with one row a key that streams write to: copied on write by buckets of keys, visible by a manifest.

An upsert reads the live files of the buckets it touches alone, writes these buckets anew under its version's folder
and then commits a manifest that names, for each bucket, the version to read. A crash before the commit leaves files that
nobody reads and the next try replaces; a batch that comes again after its commit is known by its number. Readers open
live files only and see one version throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.workspace import kept
from ..sources import manifest


class KeyedTable:
    def __init__(self, root: str, key: str = "id", buckets: int = 64):
        """buckets: of a new table; an existing one keeps its own."""
        self.root, self.key, self.buckets = root.rstrip("/"), key, buckets

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _read(self, spark: SparkSession, now: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(now["schema"])
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(now["live"].items(), key=lambda x: int(x[0])) if only is None or int(b) in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def read(self, spark: SparkSession, only: set[int] | None = None) -> DataFrame:
        """The rows of the last version, of some buckets alone if told so."""
        _, now = manifest.latest(spark, self.root)
        if not now:
            raise ValueError(f"there is no table in {self.root}")
        return self._read(spark, now, only)

    def upsert(self, rows: DataFrame, batch: int | None = None, order: str | None = None, removed: DataFrame | None = None) -> int:
        """Puts rows in the place of those with their keys, and takes removed keys out; tells the version that has them.

        Of rows with one key the last by order counts, else the largest. batch: numbers ascend, and one that is there
        already, or an earlier one, changes nothing. A column more or less than the table has is an error.
        """
        spark = rows.sparkSession
        version, now = manifest.latest(spark, self.root)
        if batch is not None and now and batch <= now["batch"]:
            return version
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        if now and T.StructType.fromJson(now["schema"]) != schema:
            raise ValueError(f"columns differ from those of {self.root}: {schema.simpleString()}")
        buckets, following = now.get("buckets", self.buckets), manifest.following(spark, self.root)
        every = F.struct(*rows.columns)
        new = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg((F.max_by(every, order) if order else F.max(every)).alias("__r")).select("__r.*")
        new = kept(new.withColumn("bucket", self._bucket(buckets)), "upsert")
        keys = new.select(self.key)
        if removed is not None:
            gone = kept(removed.select(self.key).distinct(), "removed").join(keys, self.key, "left_anti")
            keys = keys.union(gone)
        touched = {r[0] for r in keys.select(self._bucket(buckets)).distinct().collect()}  # as many as there are buckets
        live = {b: v for b, v in now.get("live", {}).items() if int(b) not in touched}
        if touched:
            rest = self._read(spark, now, touched).join(keys, self.key, "left_anti") if now else new.drop("bucket").limit(0)
            both = rest.select(*rows.columns).withColumn("bucket", self._bucket(buckets)).unionByName(new)
            both.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={following}")
            there = spark.read.parquet(f"{self.root}/data/v={following}").select("bucket").distinct().collect() if not both.isEmpty() else []
            live |= {str(r[0]): following for r in there}
        content = {"schema": schema.jsonValue(), "buckets": buckets, "live": live, "batch": now.get("batch", -1) if batch is None else batch}
        manifest.commit(spark, self.root, following, content)
        return following

    def vacuum(self, spark: SparkSession) -> list[str]:
        """Deletes files that the last version does not name; for a time without readers of earlier ones and without writers. Tells their folders."""
        version, now = manifest.latest(spark, self.root)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        named, gone = {(v, int(b)) for b, v in now.get("live", {}).items()}, []
        for v in fs.listStatus(path) if fs.exists(path) else []:
            number = int(v.getPath().getName().removeprefix("v="))
            for b in fs.listStatus(v.getPath()):
                name = b.getPath().getName()
                if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in named:
                    fs.delete(b.getPath(), True)
                    gone.append(f"v={number}/{name}")
        return sorted(gone)


class KeyedSink:
    """A sink of items in a table by id: a batch that comes again is there already."""

    def __init__(self, root: str, buckets: int = 64):
        self.table = KeyedTable(root, "id", buckets)

    def send(self, items: DataFrame, batch: int) -> None:
        self.table.upsert(items, batch)

    def current(self, spark: SparkSession) -> DataFrame:
        return self.table.read(spark)
