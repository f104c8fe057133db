"""Mixing of sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. Within a source the keys are range-sorted, word counts get distributed
prefix sums, and the source is cut where its budget ends; a budget over the source's size repeats whole epochs
before the cut.

Scale: texts are read once, for word counts. What moves after that is a few numbers a document. A hot source has
as many key ranges as its rows need. The table of sources has a row for each source and is ordered in one task.

Defined results: a null text has no words; a null source is a source, after all others; equal rows are separate
documents; a source without words has target 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, WORD, Shelf, loosened, numbered, read, running_sum, spare

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words, null: 0. Each word with the space before it becomes one letter; what else is left is space."""
    letters = F.regexp_replace(F.regexp_replace(text, f"[{SPACE}]*+{WORD}", "x"), f"[{SPACE}]+", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes: (no_source, source, source_size), a row for each source. Adds target.

    All words are shared by weight; a target stops at most times its source's size, and the excess is reshared by
    weight. Sources ordered by cap over weight are capped up to some place, after which all get the same words a
    unit of weight; so one pass over running sums finds what repeated resharing ends at.
    """
    listed, everything = Window.orderBy("no_source", "source"), Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: F.col(c).cast("decimal(38,0)")
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(listed) - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("all_words", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    out = out.withColumn("capped", d("cap").cast("double") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * d("all_words").cast("double") - F.col("weight") * F.col("cap_before").cast("double"))
    held = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    out = out.withColumn("free_words", F.col("all_words") - held("cap")).withColumn("free_weight", F.col("all_weight") - held("weight"))
    return out.select("no_source", "source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("free_words").cast("double") / F.col("free_weight")).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per row of docs: __rid, doc_id, source, size, source_size, target, epochs, part, taken.

    epochs: times the whole document is taken; part: words of it taken in the epoch that the budget cuts, which
    come from its start; taken: all words. A source's taken words sum to its target, rounded.
    """
    shelf = Shelf(docs.sparkSession, "mixing")
    rows = numbered(docs, "__rid").select("__rid", F.col(doc_id).alias("doc_id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source), F.lit("")).alias("source"), word_count(F.col(text)).alias("size"))
    rows = shelf.keep(rows, "rows")
    sizes = rows.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"))
    aims = shelf.keep(targets(sizes, weights, most), "targets")
    # equal keys are equal documents in all that counts here, so reruns agree
    placed = running_sum(rows, ["no_source", "source"], F.struct("doc_id", "size"), "size", "before", ["doc_id", "size", "__rid"])
    out = placed.join(loosened(aims, "source"), ["no_source", "source"])
    out = out.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long")).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0).cast("long"))
    out = out.withColumn("room", F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("before"))
    out = out.withColumn("part", F.greatest(F.lit(0), F.least("room", "size")).cast("long"))
    return out.select("__rid", "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, whole; the one that a budget cuts counts if half of it fits.

    A document without words costs nothing and stays once.
    """
    rid = spare(docs, "__rid")
    own = numbered(docs, rid)
    copies = F.col("epochs") + F.when(F.col("part") * 2 >= F.col("size"), 1).otherwise(0)
    taken = mix(docs, doc_id, source, text, weights, most).select(F.col("__rid").alias(rid), F.when(F.col("size") == 0, 1).otherwise(copies).cast("int").alias("__copies")).where("__copies > 0")
    return own.join(taken, rid).select(*docs.columns, F.explode(F.sequence(F.lit(1), taken["__copies"]))).select(docs.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents", ["doc_id", "source", "text"])).select("doc_id", "size", "source_size", "target", "taken")
