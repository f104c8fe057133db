"""Contexts: whole documents in rank order under a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import document_of, leaks

# fixed values
RULE = "\n\n=====\n\n"
NOTHING = "(no context retrieved)"
CHUNKS_ONLY = "unknown (retrieved chunks only)"
CHUNK_RULE = "\n...\n"
BLOCK_COST = 9


def block(rank: Column, source: Column, title: Column, doc_id: Column, content: Column) -> Column:
    """A document as it stands in a context."""
    return F.concat(F.lit("[document "), rank.cast("string"), F.lit(" | source="), source, F.lit(" | title="), title, F.lit(" | id="), doc_id, F.lit("]\n"), content)


def hydrate(ranked: DataFrame, corpus: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """ranked (question_id, doc_rank, doc_id) with block and fallback: a document that is nowhere shows its chunks' texts.

    chunks: (question_id, rank, chunk_id, chunk_content).
    """
    out = ranked.join(corpus.select("doc_id", "source_type", "title", "content"), "doc_id", "left")
    if chunks is None:
        out = out.withColumn("texts", F.lit(None).cast("string"))
    else:
        texts = chunks.withColumn("doc_id", document_of(F.col("chunk_id"))).groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("chunk_content", F.lit("")).alias("t")))).alias("parts"))
        texts = texts.select("question_id", "doc_id", F.array_join(F.transform("parts", lambda p: p["t"]), CHUNK_RULE).alias("texts"))
        out = out.join(texts, ["question_id", "doc_id"], "left")
    gone = F.col("source_type").isNull()
    text = F.when(gone, F.coalesce("texts", F.lit(""))).otherwise(F.coalesce("content", F.lit("")))
    shown = block(F.col("doc_rank"), F.coalesce("source_type", F.lit(CHUNKS_ONLY)), F.coalesce("title", F.lit("")), F.col("doc_id"), text)
    return out.select("question_id", "doc_rank", "doc_id", shown.alias("block"), gone.alias("fallback"))


def budget_fold(docs: Column, budget: int) -> Column:
    """Struct (total, kept ranks) over an array of (rank, size) in rank order.

    The first document always enters; a later one enters if it still fits, also after another was dropped.
    """
    start = F.struct(F.lit(0).cast("long").alias("total"), F.expr("cast(array() as array<int>)").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        fits = (acc["total"] + d["size"] <= budget) | (F.size(acc["kept"]) == 0)
        return F.when(fits, F.struct((acc["total"] + d["size"] + BLOCK_COST).alias("total"), F.concat(acc["kept"], F.array(d["rank"])).alias("kept"))).otherwise(acc)

    return F.aggregate(docs, start, step)


def build(hydrated: DataFrame, questions: DataFrame, n_docs: int = 12, max_chars: int = 240_000) -> DataFrame:
    """One row per question: context, context_docs, dropped_docs, chunk_fallback_docs, context_chars, context_sha256, leaked."""
    top = hydrated.where(F.col("doc_rank") <= n_docs)
    one = F.struct(F.col("doc_rank").cast("int").alias("rank"), F.length("block").cast("long").alias("size"), "doc_id", "block", "fallback")
    per = questions.select("question_id").join(top.groupBy("question_id").agg(F.array_sort(F.collect_list(one)).alias("docs")), "question_id", "left")
    per = per.withColumn("docs", F.coalesce("docs", F.filter(F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("size"), F.lit("").alias("doc_id"), F.lit("").alias("block"), F.lit(False).alias("fallback"))), lambda d: F.lit(False))))
    per = per.withColumn("fold", budget_fold(F.col("docs"), max_chars))
    kept = lambda d: F.array_contains(F.col("fold.kept"), d["rank"])
    ids = lambda keep: F.transform(F.filter("docs", keep), lambda d: d["doc_id"])
    text = F.array_join(F.transform(F.filter("docs", kept), lambda d: d["block"]), RULE)
    per = per.select("question_id", F.when(F.size("fold.kept") == 0, NOTHING).otherwise(text).alias("context"), ids(kept).alias("context_docs"), ids(lambda d: ~kept(d)).alias("dropped_docs"), ids(lambda d: d["fallback"]).alias("chunk_fallback_docs"))
    return per.select("*", F.length("context").alias("context_chars"), F.sha2("context", 256).alias("context_sha256"), leaks(F.col("context")).alias("leaked"))


def authoritative(attempts: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The latest saved attempt of each completed question whose text's own hash is the checkpoint's; found tells if there is one."""
    done = checkpoint.where(F.col("stage").isin("retrieved", "answered")).select("question_id", "context_sha256")
    own = attempts.select("question_id", "attempt", "context", F.sha2("context", 256).alias("context_sha256"))
    latest = own.groupBy("question_id", "context_sha256").agg(F.max_by("context", "attempt").alias("context"), F.max("attempt").alias("attempt"))
    return done.join(latest, ["question_id", "context_sha256"], "left").withColumn("found", F.col("attempt").isNotNull())


def replayed(checkpoint: DataFrame, saved: DataFrame) -> DataFrame:
    """Completed questions with their published contexts: the saved ranking of documents, else those in the context.

    source tells where the context came from; rebuild marks questions whose text was not saved.
    """
    s = saved.select("question_id", F.sha2("context", 256).alias("context_sha256"), "context", F.col("context_docs").alias("saved_docs"))
    out = checkpoint.where(F.col("stage").isin("retrieved", "answered")).join(s, ["question_id", "context_sha256"], "left")
    docs = F.coalesce(F.col("retrieved_doc_ids"), F.col("saved_docs"), F.col("context_docs"))
    return out.select("question_id", "context", docs.alias("document_ids"), F.col("context").isNull().alias("rebuild"))


def finished(replay: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Contexts of replay, built anew where none was saved, which rebuilt_here notes."""
    r = rebuilt.select("question_id", F.col("context").alias("new"))
    return replay.join(r, "question_id", "left").select("question_id", F.coalesce("context", "new").alias("context"), "document_ids", (F.col("rebuild") & F.col("new").isNotNull()).alias("rebuilt_here"))
