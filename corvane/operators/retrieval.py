"""Local retrieval lanes and rankings. The lanes' formulas are this engine's own choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import document_of
from ..plans.workspace import kept
from .vectors import nearest, rounded

SPACE = r"[\x20\x09-\x0D]+"
EMPTY = "cast(array() as array<string>)"
#: Documents of a unit at least, where there are so many, and at most; about how many units there are in between.
UNIT, UNITS = (2048, 8192), 256
#: Documents that a task takes apart into words, about.
SHARE = 32_768
#: Questions that meet a unit at once, and about how many of their words' postings at once.
ASKED, PRODUCTS = 256, 1 << 21


def spread(df: DataFrame) -> DataFrame:
    """df over tasks of about SHARE rows, or over all cores if it has fewer; as it is where no task reads much more than that.

    Rows are counted by task, not tasks: a file of one row group is read by one task, into however many it is split.
    """
    by_task = df.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    rows, most = by_task.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARE))
    # by a hash: dealt out in turn, rows would be sorted first, all in the task that reads them
    return df.repartition(tasks, *df.columns) if most > 2 * -(-rows // tasks) else df


def tokens(text):
    return F.array_remove(F.split(text, SPACE), "")


def _short_pairs(q: DataFrame, corpus: DataFrame, gram: int = 3) -> DataFrame:
    """(question_id, doc_id) for passages of fewer than three words, q (question_id, passage, w).

    The passage's longest word lies within a word of the document. Distinct words of the corpus meet it by a part of
    gram letters, or of fewer where it is shorter, and documents meet their words; then whole passages are verified. Passages
    of white space only are looked for in every document: nothing else tells where they stand.
    """
    sizes = sorted(r[0] for r in q.select(F.least(F.array_max(F.transform("w", lambda x: F.length(x))), F.lit(gram)).alias("n")).distinct().collect() if r[0] is not None)  # at most gram
    text = corpus.select("doc_id", "content")
    blank = q.where(F.size("w") == 0).select("question_id", "passage")
    out = text.join(blank, F.contains("content", "passage")).select("question_id", "doc_id")
    if not sizes:
        return out
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x), x.alias("x"))))["x"]
    asked = q.where(F.size("w") > 0).select("question_id", "passage", longest.alias("part")).withColumn("gram", F.substring("part", 1, gram))
    words = text.select("doc_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("word"))
    parts = lambda n: F.when(F.length("word") >= n, F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda i: F.substring(F.col("word"), i, F.lit(n)))).otherwise(F.expr(EMPTY))
    grams = words.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(*map(parts, sizes)))).alias("gram"))
    within = grams.join(asked, "gram").where(F.contains("word", "part")).select("word", "question_id", "passage").distinct()
    met = words.join(within, "word").select("doc_id", "question_id", "passage").distinct().join(text, "doc_id")
    return out.union(met.where(F.contains("content", "passage")).select("question_id", "doc_id")).distinct()


def gold_pairs(questions: DataFrame, corpus: DataFrame, seed: int = 8) -> DataFrame:
    """(question_id, doc_id): documents whose content holds the question's passage.

    Words between a passage's first and last stand in the document as whole words, so the pair meets by a hash of
    them, of the first seed at most, and is then verified. Documents make hashes of those lengths alone that occur
    among the passages. Passages of one or two words have no whole word to meet by and meet parts of words instead.
    """
    q = questions.select("question_id", "passage", tokens(F.col("passage")).alias("w"))
    held = _short_pairs(q.where(F.size("w") < 3), corpus)
    q = q.where(F.size("w") >= 3).withColumn("n", F.least(F.size("w") - 2, F.lit(seed)))
    lengths = sorted(r[0] for r in q.select("n").distinct().collect())  # at most seed
    if not lengths:
        return held
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    q = q.select("question_id", "passage", F.xxhash64(F.slice(hashes, 2, F.col("n"))).alias("key"))

    def runs(n: int):
        """Hashes of all runs of n words."""
        return F.when(F.size("h") >= n, F.transform(F.sequence(F.lit(1), F.size("h") - n + 1), lambda i: F.xxhash64(F.slice("h", i, F.lit(n))))).otherwise(F.expr("cast(array() as array<bigint>)"))

    d = spread(corpus.select("doc_id", "content")).select("doc_id", tokens(F.col("content")).alias("w")).select("doc_id", hashes.alias("h"))
    d = d.select("doc_id", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("key"))
    met = d.join(q.select("key", "question_id"), "key").select("doc_id", "question_id").distinct()
    met = met.join(q.select("question_id", "passage"), "question_id").join(corpus.select("doc_id", "content"), "doc_id")
    return met.where(F.contains("content", "passage")).select("question_id", "doc_id").distinct().union(held)


def gold_sets(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question_id, expected_doc_ids): sorted, empty where there is none."""
    sets = pairs.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    return questions.select("question_id").join(sets, "question_id", "left").select("question_id", F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("expected_doc_ids"))


def top_k(scored: DataFrame, k: int, by: str = "score", group: str = "question_id", item: str = "doc_id", out: str = "rank") -> DataFrame:
    """The k best rows of each group, equal scores by item; Spark limits each group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), item)
    return scored.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def bm25(asked: DataFrame, tf: DataFrame, documents: int, words: int, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question_id, doc_id, score, rank) of asked (question_id, term) by all postings tf (term, doc_id, tf, len) of the terms.

    documents and words: how many there are in the corpus. Documents are dealt into units by a hash, every question visits
    every unit, and a unit tells the k best of each question. So of all pairs of a question and a document only those leave
    their task, however frequent the words are, and lists merge however documents are dealt.
    """
    n, mean = F.lit(documents), F.lit(words / max(documents, 1))
    df = kept(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    each = max(UNIT[0], min(UNIT[1], documents // UNITS))
    units = -(-documents // each) or 1
    part = (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))).alias("s")
    members = tf.join(idf, "term").select((F.pmod(F.xxhash64("doc_id"), F.lit(units)) * 2).alias("at"), F.col("doc_id").alias("id"), "term", part)
    visits = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(units - 1).cast("long")), lambda u: u * 2 + 1)).alias("at")
    guests = asked.select(visits, F.col("question_id").alias("id"), "term", F.lit(None).cast("double"))
    # rows meet by their unit and become arrays there: rows are dear on their way to Python
    dealt = members.union(guests).withColumn("unit", F.shiftright("at", 1)).repartition("unit")
    dealt = dealt.groupBy("unit", "at", "id").agg(F.collect_list("term").alias("terms"), F.collect_list("s").alias("s")).sortWithinPartitions("at").select("at", "id", "terms", "s")
    found = dealt.mapInArrow(lambda batches: _unit_hits(batches, k), "question_id string, doc_id string, score double")
    return top_k(found, k)


def _unit_hits(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(question_id, doc_id, score) of each unit's k best documents for each question, of (at, id, terms, s).

    at is twice the unit for a document and one more for a question, and comes sorted.
    """
    unit, held, waiting, postings = None, [], [], None

    def answers() -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting, postings
        if held:
            postings, held = Postings(pa.Table.from_batches(held)), []
        if waiting and postings is not None:
            asked = pa.Table.from_batches(waiting).combine_chunks()
            yield postings.best(asked.column(1).combine_chunks(), asked.column(2).combine_chunks(), k)
        waiting = []

    for batch in batches:
        at = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if at[a] >> 1 != unit:
                yield from answers()
                unit, postings, held = at[a] >> 1, None, []
            if at[a] % 2 == 0:
                held.append(batch.slice(a, b - a))
                continue
            for c in range(a, b, ASKED):
                waiting.append(batch.slice(c, min(ASKED, b - c)))
                if sum(w.num_rows for w in waiting) >= ASKED:
                    yield from answers()
    yield from answers()


class Postings:
    """A unit's postings by document and term, of (at, id, terms, s): documents in the order of their ids."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by([(rows.column_names[1], "ascending")])
        terms, s = (rows.column(i).combine_chunks() for i in (2, 3))
        term = terms.flatten().dictionary_encode()
        self.ids, self.words = rows.column(1).combine_chunks(), term.dictionary
        at, self.term = np.repeat(np.arange(len(self.ids)), pc.list_value_length(terms).to_numpy()), term.indices.to_numpy().astype(np.int64)
        # words in the order of their letters: sums are the same however rows came
        letters = np.empty(len(self.words), dtype=np.int64)
        letters[pc.sort_indices(self.words).to_numpy()] = np.arange(len(self.words))
        order = np.lexsort((letters[self.term], at))
        self.doc, self.term, self.s = at[order], self.term[order], s.flatten().to_numpy()[order]

    def best(self, questions: pa.Array, terms: pa.Array, k: int) -> pa.RecordBatch:
        """The k best documents of each question; equal scores by id."""
        word = pc.index_in(terms.flatten(), value_set=self.words)
        who = np.repeat(np.arange(len(questions)), pc.list_value_length(terms).to_numpy())
        has = word.is_valid().to_numpy(zero_copy_only=False)
        word, who = word.fill_null(0).to_numpy().astype(np.int64)[has], who[has]
        by = np.argsort(word, kind="stable")
        who, n = who[by], np.bincount(word, minlength=len(self.words))
        first, asks = np.cumsum(n) - n, n[self.term]
        own = np.flatnonzero(asks)  # postings that some question asks for
        doc, s, asks, at = self.doc[own], self.s[own], asks[own], first[self.term[own]]
        score = np.zeros((len(questions), len(self.ids)))
        ends = np.cumsum(asks)
        cut = 0
        while cut < len(own):
            to = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PRODUCTS, side="right")))
            to += int(np.searchsorted(doc[to:], doc[to - 1], side="right")) if to < len(own) else 0  # no document is cut
            m = asks[cut:to]
            step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            low, high = doc[cut], doc[to - 1] + 1
            cell = who[np.repeat(at[cut:to], m) + step] * (high - low) + np.repeat(doc[cut:to] - low, m)
            score[:, low:high] = np.bincount(cell, weights=np.repeat(s[cut:to], m), minlength=len(questions) * (high - low)).reshape(len(questions), -1)
            cut = to
        out = []
        for q in range(len(questions)):
            hit = np.flatnonzero(score[q] > 0)
            told = rounded(score[q, hit])
            if len(hit) > k:
                near = np.flatnonzero(told >= np.partition(told, len(told) - k)[len(told) - k])
                hit, told = hit[near], told[near]
            by = np.argsort(-told, kind="stable")[:k]
            out.append((np.full(len(by), q), hit[by], told[by]))
        q, d, told = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([questions.take(pa.array(q)), self.ids.take(pa.array(d)), pa.array(told)], ["question_id", "doc_id", "score"])


def asked_terms(questions: DataFrame) -> DataFrame:
    """(question_id, term): the distinct words of each question."""
    return questions.select("question_id", F.explode(F.array_distinct(tokens(F.col("question")))).alias("term"))


def lexical(questions: DataFrame, corpus: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(question_id, doc_id, score, rank) by BM25 over white-space words, scores rounded to six places.

    The corpus is read once: only postings of the questions' words leave it, and are kept as a table beside each document's
    length. Where a corpus is searched more than once, an index saves that pass (operators/index.py).
    """
    asked = kept(asked_terms(questions), "asked")
    docs = spread(corpus.select("doc_id", "content")).select("doc_id", tokens(F.coalesce("content", F.lit(""))).alias("w"))
    # a row without a term carries the length of its document, so that lengths need no pass of their own
    rows = docs.select("doc_id", F.size("w").alias("len"), F.explode(F.concat("w", F.array(F.lit("")))).alias("term"))
    wanted = asked.select("term").union(rows.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tf = kept(rows.join(wanted, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, total = tf.where("term = ''").agg(F.count(F.lit(1)), F.sum("len")).first()
    return bm25(asked, tf.where("term <> ''"), n, total or 0, k, k1, b)


def dense(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(question_id, doc_id, score, rank) by cosine of (question_id, vector) and (doc_id, embedding), in blocks."""
    return nearest(queries, vectors, k)


def hybrid(dense_hits: DataFrame, lexical_hits: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical after scaling each question's hits of a lane to 0..1; an absent hit is 0."""

    def scaled(hits: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("question_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return hits.select("question_id", "doc_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = scaled(dense_hits, "d").join(scaled(lexical_hits, "l"), ["question_id", "doc_id"], "full_outer")
    both = both.select("question_id", "doc_id", F.round(alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("l", F.lit(0.0)), 6).alias("score"))
    return top_k(both, k)


def distinct_documents(hits: DataFrame) -> DataFrame:
    """(question_id, doc_id, doc_rank): documents of (question_id, rank, chunk_id) in the order of their first hit."""
    docs = hits.withColumn("doc_id", document_of(F.col("chunk_id"))).where("doc_id <> ''")
    first = docs.groupBy("question_id", "doc_id").agg(F.min("rank").alias("first"))
    return first.select("question_id", "doc_id", F.row_number().over(Window.partitionBy("question_id").orderBy("first")).alias("doc_rank"))


def search(questions: DataFrame, corpus: DataFrame, max_results: int = 100, query_by: str = "text", alpha: float = 0.5, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(question_id, doc_id, score, rank): the local stand-in for a search service. query_by: text, vector or hybrid."""
    if query_by == "text":
        return lexical(questions, corpus, max_results)
    if vectors is None or query_vectors is None:
        raise ValueError("vectors are needed for this kind of search")
    near = dense(query_vectors, vectors, max_results)
    return near if query_by == "vector" else hybrid(near, lexical(questions, corpus, max_results), alpha, max_results)


def request(question: str, collection: str, max_results: int = 100, query_by: str = "hybrid", mode: str = "fast", alpha: float = 0.5, graph_context: bool = False, query_apps: bool = False) -> dict:
    """What a search service is asked. The last two are named only where they are set."""
    if query_by not in ("text", "vector", "hybrid") or mode not in ("fast", "thinking") or not 0 <= alpha <= 1:
        raise ValueError(f"no such search: {query_by}, {mode}, {alpha}")
    out = {"collection": collection, "query": question, "max_results": max_results, "query_by": query_by, "mode": mode, "alpha": alpha}
    return out | {name: True for name, on in (("graph_context", graph_context), ("query_apps", query_apps)) if on}


def search_service(questions: DataFrame, ask: Callable[[dict], list[dict]], collection: str, attempts: int = 5, wait: float = 5.0, transient: tuple[type[Exception], ...] = (TimeoutError, ConnectionError), sleep: Callable[[float], None] = time.sleep, **options) -> DataFrame:
    """(question_id, rank, chunk_id, chunk_content, score) from a service: ask takes a request and tells chunks (chunk_id, content, score) in order.

    No result and transient failures are asked for again after growing waits; a failure that stays is raised, no result is none.
    """

    def found(question: str) -> list[dict]:
        failure = None
        for i in range(attempts):
            try:
                failure = None
                if chunks := ask(request(question, collection, **options)):
                    return chunks
            except transient as e:
                failure = e
            if i + 1 < attempts:
                sleep(wait * (i + 1))
        if failure is not None:
            raise failure
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(q, i, c["chunk_id"], c.get("content"), c.get("score")) for q, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(found(text), 1)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["question_id", "rank", "chunk_id", "chunk_content", "score"])

    return questions.select("question_id", "question").mapInArrow(run, "question_id string, rank int, chunk_id string, chunk_content string, score double")
