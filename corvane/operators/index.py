"""A stored inverted index for lexical search, in segments.

Postings are partitioned by a hash of their term, so a search reads the partitions of its own words alone. A row is a block
of at most about BLOCK postings of one term; words that many documents hold have many blocks, spread over files. Beside them
each segment keeps its documents' words, partitioned by a hash of the id, and what it replaces: an upsert reads the old
words of its own documents only and writes marks that take their postings out. Counts of documents and words are kept in the
manifest, so scores equal those of the corpus as it stands.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.workspace import kept
from ..sources import manifest
from ..sources.corpus import first_by
from .retrieval import asked_terms, bm25, spread, tokens

BUCKETS, BLOCK = 64, 4096
POSTINGS = "term string, block int, ids array<string>, tfs array<int>, lens array<int>, bucket int"
FORWARD = "doc_id string, len int, terms array<string>, part int"
GONE = "term string, doc_id string, of int, bucket int"


def _bucket(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, root: str, kind: str, segments: list[int], schema: str, within: str, values: list[int]) -> DataFrame:
    """Rows of the segments' partitions among values, with seg."""
    parts = []
    for s in segments:
        try:
            own = spark.read.schema(schema).parquet(f"{root}/{kind}/seg={s}")
        except AnalysisException:  # a segment without rows of this kind has no folder
            continue
        parts.append(own.where(F.col(within).isin(values)).withColumn("seg", F.lit(s)))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"{schema}, seg int")


def _beginnings(words: str):
    """Where each distinct word begins in the column of sorted words, from 0."""
    return F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i < F.size(words)) & ((i == 0) | (F.get(words, i) != F.get(words, i - 1))))


def _values(df: DataFrame, column: str) -> list[int]:
    return sorted(r[0] for r in df.select(column).distinct().collect())  # BUCKETS at most


def _retired(spark: SparkSession, root: str, now: dict, ids: DataFrame, version: int) -> tuple[int, int]:
    """Marks what the live segments hold of documents ids (doc_id); tells how many documents and words that is."""
    ids = ids.withColumn("part", _bucket("doc_id"))
    old = _read(spark, root, "forward", now.get("segments", []), FORWARD, "part", _values(ids, "part")).join(ids.select("doc_id"), "doc_id", "left_semi")
    # a document that a segment replaced was marked then: the last segment that has it is the live one, unless it was removed
    last = old.groupBy("doc_id").agg(F.max_by(F.struct("seg", "len", "terms"), "seg").alias("d")).select("doc_id", "d.*").where("len >= 0")
    last = kept(last, "retired")
    last.select(F.explode("terms").alias("term"), "doc_id", F.col("seg").alias("of")).withColumn("bucket", _bucket("term")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/gone/seg={version}")
    n, words = last.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return n, words


def upsert(spark: SparkSession, root: str, corpus: DataFrame) -> int:
    """Adds documents (doc_id, content) or replaces those with their ids, as one segment; of rows with one id the first by content. Tells the version."""
    version, (_, now) = manifest.following(spark, root), manifest.latest(spark, root)
    docs = first_by(spread(corpus.select("doc_id", F.coalesce("content", F.lit("")).alias("content"))), ["doc_id"], ["content"])
    # words in order, and where each one begins among them: a document counts its own words, and no word moves for that
    docs = docs.select("doc_id", F.array_sort(tokens(F.col("content"))).alias("w")).select("doc_id", "w", F.size("w").alias("len"))
    docs = kept(docs.withColumn("at", _beginnings("w")), "upserted")
    gone, gone_words = _retired(spark, root, now, docs.select("doc_id"), version)
    ends = F.concat(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.col("len")))
    own = F.transform(F.arrays_zip(F.col("at").alias("a"), ends.alias("b")), lambda x: F.struct(F.get("w", x["a"]).alias("term"), (x["b"] - x["a"]).alias("tf")))
    rows = docs.where("len > 0").select("doc_id", "len", F.inline(own))
    # most words have one block: only those with more are looked up
    many = kept(rows.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "blocks")
    rows = rows.join(many, "term", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int")).withColumn("bucket", _bucket("term"))
    # a block's postings meet where they are written, in one move
    packed = rows.select("bucket", "block", "term", "doc_id", "tf", "len").repartition("bucket", "block").groupBy("bucket", "block", "term").agg(*[F.collect_list(a).alias(b) for a, b in (("doc_id", "ids"), ("tf", "tfs"), ("len", "lens"))])
    packed.select("term", "block", "ids", "tfs", "lens", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/seg={version}")
    forward = docs.select("doc_id", "len", F.transform("at", lambda i: F.get("w", i)).alias("terms")).withColumn("part", _bucket("doc_id"))
    forward.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/forward/seg={version}")
    n, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    manifest.commit(spark, root, version, {"segments": [*now.get("segments", []), version], "documents": now.get("documents", 0) - gone + n, "words": now.get("words", 0) - gone_words + words})
    return version


def remove(spark: SparkSession, root: str, ids: DataFrame) -> int:
    """Takes documents (doc_id) out; ids that are not there change nothing."""
    version, (_, now) = manifest.following(spark, root), manifest.latest(spark, root)
    ids = kept(ids.select("doc_id").distinct(), "removed")
    gone, words = _retired(spark, root, now, ids, version)
    left = ids.select("doc_id", F.lit(-1).alias("len"), F.expr("cast(array() as array<string>)").alias("terms")).withColumn("part", _bucket("doc_id"))
    left.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/forward/seg={version}")
    manifest.commit(spark, root, version, {"segments": [*now.get("segments", []), version], "documents": now.get("documents", 0) - gone, "words": now.get("words", 0) - words})
    return version


def postings(spark: SparkSession, root: str, terms: DataFrame) -> DataFrame:
    """(term, doc_id, tf, len): live postings of terms (term), from their partitions alone."""
    _, now = manifest.latest(spark, root)
    buckets, segments = _values(terms.select(_bucket("term").alias("bucket")), "bucket"), now.get("segments", [])
    blocks = _read(spark, root, "postings", segments, POSTINGS, "bucket", buckets).join(terms.select("term").distinct(), "term", "left_semi")
    each = F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")
    rows = blocks.select("seg", "term", each).select("seg", "term", F.col("p.ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lens").alias("len"))
    gone = _read(spark, root, "gone", segments, GONE, "bucket", buckets).select(F.col("of").alias("seg"), "term", "doc_id")
    return rows.join(gone, ["seg", "term", "doc_id"], "left_anti").drop("seg")


def search(spark: SparkSession, root: str, questions: DataFrame, k: int, **options) -> DataFrame:
    """(question_id, doc_id, score, rank) as lexical() tells for the documents that are in the index."""
    _, now = manifest.latest(spark, root)
    asked = kept(asked_terms(questions), "asked")
    tf = kept(postings(spark, root, asked), "found")
    return bm25(asked, tf, now.get("documents", 0), now.get("words", 0), k, **options)
