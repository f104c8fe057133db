"""Registered queries over the driver's tables, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as ft
from ..operators import context, identity, index, items, judging, ledger, merkle, metrics, retrieval, validation
from ..sources import corpus as sources
from ..sources import journal
from ..streaming import calls
from . import adapter as ad
from .answers import generate
from .workspace import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Views that queries' SQL shares, one for each adapter.
VIEWS = {
    "corpus": "SELECT 'd' || doc_id AS doc_id, source AS source_type, substring(coalesce(text, ''), 1, 40) AS title, coalesce(text, '') AS content, length(coalesce(text, '')) AS content_len FROM documents",
    "questions": "SELECT 'q' || item_id AS question_id, text AS question FROM benchmark",
    "results": """SELECT 'd' || l.doc_id AS question_id, d.lang AS question_type, d.source, l.quality = 1 AS answer_correct, CAST(d.n_chars % 101 AS DOUBLE) AS completeness_pct,
        CASE WHEN d.n_chars % 7 <> 0 THEN CAST(d.n_chars % 5 * 25 AS DOUBLE) END AS document_recall_pct, CASE WHEN d.n_chars % 7 <> 0 THEN d.n_chars % 4 END AS invalid_extra_docs, l.toxic = 1 AS corrected
        FROM labels l JOIN documents d USING (doc_id)""",
    "other": "SELECT question_id, question_type, source, CASE WHEN completeness_pct % 9 = 0 THEN NOT answer_correct ELSE answer_correct END AS answer_correct, least(100.0, completeness_pct + 3) AS completeness_pct, document_recall_pct, invalid_extra_docs, corrected FROM results",
    "pairs": """SELECT a.question_id, a.question_type, a.answer_correct AS a_ok, b.answer_correct AS b_ok, a.completeness_pct AS a_complete, b.completeness_pct AS b_complete,
        CASE WHEN a.answer_correct THEN a.completeness_pct ELSE 0 END AS a_score, CASE WHEN b.answer_correct THEN b.completeness_pct ELSE 0 END AS b_score FROM results a JOIN other b USING (question_id)""",
    "log": "SELECT strftime(ts, '%Y-%m-%d') AS batch, 'u' || user_id AS id, CASE event_type WHEN 'error' THEN 'errored' WHEN 'purchase' THEN 'completed' ELSE 'pending' END AS status, event_id AS seq FROM events",
    "threads": "SELECT 'c' || conv_id AS doc_id, CAST(turn AS INTEGER) AS i, role AS author, coalesce(text, '') AS body FROM conversations",
    "gold_pairs": "SELECT 'q' || b.item_id AS question_id, 'd' || d.doc_id AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "gold": "SELECT q.question_id, coalesce(list_sort(list(DISTINCT g.doc_id) FILTER (g.doc_id IS NOT NULL)), []) AS ids FROM questions q LEFT JOIN gold_pairs g USING (question_id) GROUP BY 1",
    "postings": r"SELECT doc_id, unnest(list_filter(string_split_regex(content, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term FROM corpus",
    "sizes": "SELECT c.doc_id, coalesce(p.n, 0) AS len FROM corpus c LEFT JOIN (SELECT doc_id, count(*) AS n FROM postings GROUP BY 1) p USING (doc_id)",
    "asked": r"SELECT DISTINCT question_id, unnest(list_filter(string_split_regex(question, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS term FROM questions",
    "tf": "SELECT term, doc_id, count(*) AS tf FROM postings WHERE term IN (SELECT term FROM asked) GROUP BY ALL",
    "bm25": """SELECT question_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
        FROM asked JOIN tf USING (term) JOIN (SELECT term, count(*) AS df FROM tf GROUP BY 1) USING (term) JOIN sizes USING (doc_id), (SELECT count(*) AS n, avg(len) AS mean FROM sizes) GROUP BY ALL""",
    "hits": "SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 50",
    "ranked": "SELECT question_id, list(doc_id ORDER BY rank) AS ids FROM hits GROUP BY 1",
    "recall": """SELECT g.question_id, k, 100.0 * len(list_intersect(coalesce(r.ids, [])[1:k], g.ids)) / len(g.ids) AS recall_pct, len(list_filter(coalesce(r.ids, [])[1:k], lambda x: NOT list_contains(g.ids, x))) AS invalid_extra
        FROM gold g LEFT JOIN ranked r USING (question_id), (SELECT unnest([1, 3, 5, 10, 20, 50]) AS k) WHERE len(g.ids) > 0""",
    "blocks": r"""SELECT h.question_id, h.rank, h.doc_id, c.doc_id IS NULL AS fallback,
        '[document ' || h.rank || ' | source=' || coalesce(c.source_type, 'unknown (retrieved chunks only)') || ' | title=' || coalesce(c.title, '') || ' | id=' || h.doc_id || e']\n' || CASE WHEN c.doc_id IS NULL THEN 'chunk of ' || h.doc_id ELSE c.content END AS block
        FROM hits h LEFT JOIN (SELECT * FROM corpus WHERE content_len % 10 <> 0) c USING (doc_id) WHERE h.rank <= 12""",
    "folded": """SELECT question_id, rank, doc_id, block, fallback, true AS kept, CAST(length(block) + 9 AS BIGINT) AS total FROM blocks WHERE rank = 1
        UNION ALL SELECT b.question_id, b.rank, b.doc_id, b.block, b.fallback, f.total + length(b.block) <= 12000, CASE WHEN f.total + length(b.block) <= 12000 THEN f.total + length(b.block) + 9 ELSE f.total END
        FROM folded f JOIN blocks b ON b.question_id = f.question_id AND b.rank = f.rank + 1""",
}
USES = {
    "other": ["results"], "pairs": ["results", "other"], "gold": ["questions", "gold_pairs"], "postings": ["corpus"], "sizes": ["corpus", "postings"], "asked": ["questions"], "tf": ["postings", "asked"],
    "bm25": ["asked", "tf", "sizes"], "hits": ["bm25"], "ranked": ["hits"], "recall": ["gold", "ranked"], "blocks": ["hits", "corpus"], "folded": ["blocks"],
}


def _with(views: list[str], body: str) -> str:
    order: list[str] = []

    def need(v: str) -> None:
        for u in USES.get(v, []):
            need(u)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    return ("WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in order) + " " if order else "") + body


def query(name: str, sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _with(views.split(), sql)
        return f

    return add


# --- sources


@query("corpus_rows", "SELECT doc_id, source_type, title, md5(content) AS content_md5, CAST(content_len AS BIGINT) AS content_len FROM corpus", "corpus")
def corpus_rows(spark, sf_dir):
    rows = sources.normalised(ad.corpus(spark, sf_dir))
    return rows.select("doc_id", "source_type", "title", F.md5("content").alias("content_md5"), F.col("content_len").cast("long").alias("content_len"))


@query("corpus_scan_keyset", "SELECT doc_id, source_type FROM corpus WHERE source_type IN ('src0', 'src1', 'src2') AND doc_id > 'd2' ORDER BY doc_id LIMIT 50", "corpus")
def corpus_scan_keyset(spark, sf_dir):
    return sources.scan(ad.corpus(spark, sf_dir), ["src0", "src1", "src2"], "d2", 50).select("doc_id", "source_type")


@query("corpus_fetch_ids", "SELECT doc_id, CAST(content_len AS BIGINT) AS content_len FROM corpus WHERE doc_id IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1)", "corpus")
def corpus_fetch_ids(spark, sf_dir):
    ids = ad.table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    return sources.fetch(ad.corpus(spark, sf_dir), ids).select("doc_id", F.col("content_len").cast("long").alias("content_len"))


@query("corpus_fallback", """SELECT 'd' || l.doc_id AS doc_id, CASE WHEN c.content_len % 3 = 0 THEN 'first' WHEN c.content_len % 3 = 1 THEN 'second' END AS found_in, CASE WHEN c.content_len % 3 < 2 THEN md5(c.content) END AS content_md5
    FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN corpus c ON c.doc_id = 'd' || l.doc_id""", "corpus")
def corpus_fallback(spark, sf_dir):
    c = ad.corpus(spark, sf_dir)
    ids = ad.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    return sources.fetch_with_fallback(ids, c.where("content_len % 3 = 0"), c.where("content_len % 3 < 2")).select("doc_id", "found_in", F.md5("content").alias("content_md5"))


@query("corpus_count", "SELECT count(*) AS n FROM corpus WHERE source_type IN ('src0', 'src3')", "corpus")
def corpus_count(spark, sf_dir):
    return sources.normalised(ad.corpus(spark, sf_dir)).where(F.col("source_type").isin("src0", "src3")).agg(F.count(F.lit(1)).alias("n"))


@query("source_stats", "SELECT source_type, count(*) AS n, CAST(trunc(avg(content_len)) AS BIGINT) AS mean_len, CAST(max(content_len) AS BIGINT) AS max_len, CAST(min(content_len) AS BIGINT) AS min_len FROM corpus GROUP BY 1 ORDER BY n DESC, source_type", "corpus")
def source_stats(spark, sf_dir):
    n = F.col("content_len").cast("long")
    return ad.corpus(spark, sf_dir).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.avg(n).cast("long").alias("mean_len"), F.max(n).alias("max_len"), F.min(n).alias("min_len")).orderBy(F.desc("n"), "source_type")


@query("insert_or_ignore", "SELECT doc_id, min(origin) AS origin FROM (SELECT doc_id, 0 AS origin FROM corpus WHERE content_len % 2 = 0 UNION ALL SELECT doc_id, 1 FROM corpus) GROUP BY 1", "corpus")
def insert_or_ignore(spark, sf_dir):
    c = ad.corpus(spark, sf_dir).select("doc_id", "content_len")
    rows = c.where("content_len % 2 = 0").withColumn("origin", F.lit(0)).union(c.withColumn("origin", F.lit(1)))
    return sources.first_by(rows, ["doc_id"], ["origin"]).select("doc_id", "origin")


def _raw(spark, sf_dir):
    """Raw JSON documents from pages, some with broken labels."""
    p = ad.table(spark, sf_dir, "pages").withColumn("m", F.col("page_id") % 6)
    label = F.when(F.col("m") == 1, F.lit(None)).when(F.col("m") == 2, "missing").otherwise("url")
    names = F.when(F.col("m") == 3, F.array().cast("array<string>")).when(F.col("m") == 4, F.array(F.lit("html"))).when(F.col("m") == 5, F.array(F.lit("nowhere"))).otherwise(F.array(F.lit("url"), F.lit("tags"), F.lit("html")))
    return p.select("page_id", F.to_json(F.struct(label.alias("title_field_name"), names.alias("content_field_names"), "url", F.coalesce("html", F.lit("")).alias("html"), F.array(F.lit("a"), F.lit("b")).alias("tags"))).alias("raw"))


@query("canonical_extract", r"""SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'no title label' WHEN 2 THEN 'title field absent' WHEN 3 THEN 'content labels are empty' WHEN 5 THEN 'content field absent' END AS reject_reason,
    CASE WHEN page_id % 6 IN (0, 4) THEN url END AS title, CASE page_id % 6 WHEN 0 THEN md5(e'url:\n' || url || e'\n\ntags:\na\nb\n\nhtml:\n' || coalesce(html, '')) WHEN 4 THEN md5(coalesce(html, '')) END AS content_md5 FROM pages""")
def canonical_extract(spark, sf_dir):
    title, content, reason = sources.extracted(F.col("raw"))
    return _raw(spark, sf_dir).select("page_id", reason.alias("reject_reason"), title.alias("title"), F.md5(content).alias("content_md5"))


@query("answers_written", "SELECT question_id, question AS answer, CAST(len(ids) AS BIGINT) AS n_ids FROM questions JOIN gold USING (question_id)", "questions gold")
def answers_written(spark, sf_dir):
    q = ad.questions(spark, sf_dir)
    g = retrieval.gold_sets(q, retrieval.gold_pairs(q, ad.corpus(spark, sf_dir)))
    return q.join(g, "question_id").select("question_id", F.col("question").alias("answer"), F.size("expected_doc_ids").cast("long").alias("n_ids"))


# --- retrieval


def _gold(spark, sf_dir):
    q = ad.questions(spark, sf_dir)
    return retrieval.gold_sets(q, retrieval.gold_pairs(q, ad.corpus(spark, sf_dir)))


def _hits(spark, sf_dir, k=50):
    return retrieval.lexical(ad.questions(spark, sf_dir), ad.corpus(spark, sf_dir), k)


def _ranked(hits):
    return hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r")).select("question_id", F.transform("r", lambda x: x["doc_id"]).alias("document_ids"))


@query("gold_sets", "SELECT question_id, array_to_string(ids, ',') AS ids, CAST(len(ids) AS BIGINT) AS n FROM gold", "gold")
def gold_sets(spark, sf_dir):
    return _gold(spark, sf_dir).select("question_id", F.array_join("expected_doc_ids", ",").alias("ids"), F.size("expected_doc_ids").cast("long").alias("n"))


@query("lexical_topk", "SELECT question_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM hits", "hits")
def lexical_topk(spark, sf_dir):
    return _hits(spark, sf_dir).select("question_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("lexical_index_topk", "SELECT question_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM hits", "hits")
def lexical_index_topk(spark, sf_dir):
    """The same from a stored index that was built in two parts, the second of which replaces some documents."""
    from .workspace import fresh

    root, c = fresh(spark, "index"), ad.corpus(spark, sf_dir)
    early = c.where("content_len % 3 <> 0").withColumn("content", F.when(F.col("content_len") % 3 == 1, F.substring("content", 5, 1000)).otherwise(F.col("content")))
    index.upsert(spark, root, early)
    index.upsert(spark, root, c.where("content_len % 3 <> 2"))
    return index.search(spark, root, ad.questions(spark, sf_dir), 50).select("question_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("dense_topk", """WITH u AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), q AS (SELECT * FROM u WHERE vec_id % 100 = 0),
    s AS (SELECT q.vec_id AS question_id, u.vec_id AS doc_id, round(list_dot_product(q.e, u.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(u.e, u.e))), 6) AS score FROM q, u)
    SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10""")
def dense_topk(spark, sf_dir):
    v = ad.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(q, v, 10).withColumn("rank", F.col("rank").cast("long"))


@query("hybrid_topk", """, u AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings), s AS (SELECT 'q' || i.item_id AS question_id, 'd' || u.vec_id AS doc_id, round(list_dot_product(q.e, u.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(u.e, u.e))), 6) AS score FROM benchmark i JOIN u q ON q.vec_id = i.item_id, u),
    d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) <= 20), l AS (SELECT question_id, doc_id, score FROM hits WHERE rank <= 20),
    x AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS b FROM d WINDOW w AS (PARTITION BY question_id)), y AS (SELECT *, min(score) OVER w AS a, max(score) OVER w AS b FROM l WINDOW w AS (PARTITION BY question_id)),
    z AS (SELECT question_id, doc_id, round(0.6 * coalesce(CASE WHEN x.b > x.a THEN (x.score - x.a) / (x.b - x.a) WHEN x.b IS NOT NULL THEN 1.0 END, 0.0) + 0.4 * coalesce(CASE WHEN y.b > y.a THEN (y.score - y.a) / (y.b - y.a) WHEN y.b IS NOT NULL THEN 1.0 END, 0.0), 6) AS score FROM x FULL JOIN y USING (question_id, doc_id))
    SELECT question_id, doc_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM z QUALIFY rank <= 10""", "hits")
def hybrid_topk(spark, sf_dir):
    """A vector stands for the document, and for the question, of its number."""
    v = ad.table(spark, sf_dir, "embeddings")
    docs = v.select(F.concat(F.lit("d"), "vec_id").alias("doc_id"), "embedding")
    q = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(v, "vec_id").select(F.concat(F.lit("q"), "vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return retrieval.hybrid(retrieval.dense(q, docs, 20), _hits(spark, sf_dir, 20), 0.6, 10).select("question_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("distinct_docs", """SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY first) AS doc_rank
    FROM (SELECT 'g' || conv_id % 97 AS question_id, 'c' || conv_id AS doc_id, min(turn * 1000000000 + conv_id) AS first FROM conversations GROUP BY ALL)""")
def distinct_docs(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations")
    hits = c.select(F.concat(F.lit("g"), F.col("conv_id") % 97).alias("question_id"), (F.col("turn") * 1_000_000_000 + F.col("conv_id")).alias("rank"), F.format_string("c%d_m%04d", "conv_id", "turn").alias("chunk_id"))
    return retrieval.distinct_documents(hits).withColumn("doc_rank", F.col("doc_rank").cast("long"))


@query("recall_at_k", "SELECT CAST(k AS INTEGER) AS k, round(avg(recall_pct), 6) AS recall_pct, round(avg(invalid_extra), 6) AS invalid_extra, count(*) AS n FROM recall GROUP BY 1", "recall")
def recall_at_k(spark, sf_dir):
    out = metrics.recall_at(_ranked(_hits(spark, sf_dir)), _gold(spark, sf_dir), (1, 3, 5, 10, 20, 50))
    return out.select("k", F.round("recall_pct", 6).alias("recall_pct"), F.round("invalid_extra", 6).alias("invalid_extra"), "n")


@query("full_coverage", "SELECT CAST(count(*) FILTER (recall_pct = 100) AS BIGINT) AS covered, count(*) AS n FROM recall WHERE k = 10", "recall")
def full_coverage(spark, sf_dir):
    return metrics.full_coverage(_ranked(_hits(spark, sf_dir)), _gold(spark, sf_dir))


@query("recall_compare", """, r AS (SELECT a.question_id, a.k, a.recall_pct AS a, b.recall_pct AS b FROM recall a JOIN (SELECT question_id, k2 AS k, recall_pct FROM recall JOIN (SELECT unnest([5, 10, 20]) AS k2, unnest([1, 1, 3]) AS k1) ON k = k1) b ON a.question_id = b.question_id AND a.k = b.k),
    e AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY question_id) - 1 AS place, b - a AS delta, count(*) OVER (PARTITION BY k) AS n FROM r),
    w AS (SELECT k, draw, CAST(('0x' || substring(md5('0|' || draw || '|' || place), 1, 8)) AS BIGINT) % n AS place FROM e, (SELECT unnest(range(200)) AS draw)),
    m AS (SELECT k, draw, avg(delta) AS mean FROM w JOIN e USING (k, place) GROUP BY ALL), o AS (SELECT k, mean, row_number() OVER (PARTITION BY k ORDER BY mean, draw) - 1 AS pos FROM m)
    SELECT CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(a), 6) AS a, round(avg(b), 6) AS b, round(avg(b - a), 6) AS delta_mean, any_value(low) AS low, any_value(high) AS high
    FROM r JOIN (SELECT k, round(max(CASE WHEN pos = 5 THEN mean END), 6) AS low, round(max(CASE WHEN pos = 195 THEN mean END), 6) AS high FROM o GROUP BY 1) USING (k) GROUP BY 1""", "recall")
def recall_compare(spark, sf_dir):
    out = metrics.recall_comparison(*_two_depths(spark, sf_dir), draws=200)
    return out.select("k", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta_mean", "low", "high")])


def _two_depths(spark, sf_dir):
    """Recall rows at 5, 10 and 20 of a run, and of one that submits one, one and three documents there."""
    rows = kept(metrics.recall_rows(_ranked(_hits(spark, sf_dir)), _gold(spark, sf_dir), (1, 3, 5, 10, 20)), "recall")
    at = F.explode(F.when(F.col("k") == 1, F.array(F.lit(5), F.lit(10))).otherwise(F.array(F.lit(20))))
    return rows.where("k > 3"), rows.where("k <= 3").withColumn("k", at)


@query("coverage_changes", "SELECT CAST(a.k AS INTEGER) AS k, a.question_id, CASE WHEN b.recall_pct >= 100 THEN 'gained' ELSE 'lost' END AS change FROM recall a JOIN (SELECT question_id, k2 AS k, recall_pct FROM recall JOIN (SELECT unnest([5, 10, 20]) AS k2, unnest([1, 1, 3]) AS k1) ON k = k1) b ON a.question_id = b.question_id AND a.k = b.k WHERE (a.recall_pct >= 100) <> (b.recall_pct >= 100)", "recall")
def coverage_changes(spark, sf_dir):
    return metrics.coverage_changes(*_two_depths(spark, sf_dir))


# --- contexts


def _hydrated(spark, sf_dir):
    hits = kept(_hits(spark, sf_dir, 12), "hits")  # read more than once below
    chunks = hits.select("question_id", "rank", F.concat("doc_id", F.lit("_m0000")).alias("chunk_id"), F.concat(F.lit("chunk of "), "doc_id").alias("chunk_content"))
    return context.hydrate(hits.select("question_id", F.col("rank").alias("doc_rank"), "doc_id"), ad.corpus(spark, sf_dir).where("content_len % 10 <> 0"), chunks)


def _contexts(spark, sf_dir):
    return context.build(_hydrated(spark, sf_dir), ad.questions(spark, sf_dir), 12, 12_000)


@query("hydrate_left", "SELECT question_id, doc_id, CAST(rank AS BIGINT) AS doc_rank, fallback, md5(block) AS block_md5 FROM blocks", "blocks")
def hydrate_left(spark, sf_dir):
    return _hydrated(spark, sf_dir).select("question_id", "doc_id", F.col("doc_rank").cast("long").alias("doc_rank"), "fallback", F.md5("block").alias("block_md5"))


@query("context_greedy", "SELECT question_id, coalesce(string_agg(doc_id, ',' ORDER BY rank) FILTER (kept), '') AS used, coalesce(string_agg(doc_id, ',' ORDER BY rank) FILTER (NOT kept), '') AS dropped, coalesce(string_agg(doc_id, ',' ORDER BY rank) FILTER (fallback), '') AS fallback FROM questions LEFT JOIN folded USING (question_id) GROUP BY 1", "questions folded")
def context_greedy(spark, sf_dir):
    ids = lambda c, name: F.array_join(c, ",").alias(name)
    return _contexts(spark, sf_dir).select("question_id", ids("context_docs", "used"), ids("dropped_docs", "dropped"), ids("chunk_fallback_docs", "fallback"))


@query("context_hash", r"SELECT question_id, sha256(context) AS context_sha256, CAST(length(context) AS BIGINT) AS context_chars FROM (SELECT question_id, coalesce(string_agg(block, e'\n\n=====\n\n' ORDER BY rank) FILTER (kept), '(no context retrieved)') AS context FROM questions LEFT JOIN folded USING (question_id) GROUP BY 1)", "questions folded")
def context_hash(spark, sf_dir):
    return _contexts(spark, sf_dir).select("question_id", "context_sha256", F.col("context_chars").cast("long").alias("context_chars"))


@query("leak_scan", "SELECT page_id, contains(html, 'title_field_name') OR contains(html, 'content_field_names') OR contains(html, 'dataset_doc_uuid') OR contains(html, 'dataset_noise_document') AS leaked, contains(html, 'href') OR contains(html, 'cookie') AS own_marker FROM pages")
def leak_scan(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").select("page_id", ft.leaks(F.col("html")).alias("leaked"), ft.leaks(F.col("html"), ("href", "cookie")).alias("own_marker"))


@query("authoritative_contexts", """SELECT question_id, sha256(question || '#' || (2 - length(question) % 2)) AS context_sha256, CAST(CASE WHEN length(question) % 5 = 0 THEN NULL ELSE 2 - length(question) % 2 END AS BIGINT) AS attempt FROM questions WHERE length(question) % 3 > 0""", "questions")
def authoritative_contexts(spark, sf_dir):
    q = ad.questions(spark, sf_dir).withColumn("n", F.length("question"))
    attempts = q.where("n % 5 <> 0").select("question_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), "question").select("question_id", "attempt", F.concat("question", F.lit("#"), F.col("attempt").cast("string")).alias("context"))
    done = q.select("question_id", F.sha2(F.concat("question", F.lit("#"), (2 - F.col("n") % 2).cast("string")), 256).alias("context_sha256"), F.when(F.col("n") % 3 == 0, "error").otherwise("answered").alias("stage"))
    return context.authoritative(attempts, done).select("question_id", "context_sha256", F.col("attempt").cast("long").alias("attempt"))


# --- items and scalar functions


@query("kind_mapping", """, m AS (SELECT * FROM (VALUES ('slack', 'message', 'slack'), ('gmail', 'email', 'gmail'), ('jira', 'ticket', 'jira'), ('linear', 'ticket', 'linear'), ('github', 'ticket', 'github'), ('confluence', 'knowledge_base', 'notion'), ('google_drive', 'knowledge_base', 'google_drive'), ('fireflies', 'knowledge_base', 'fireflies'), ('hubspot', 'custom', 'hubspot')) v(s, k, p)),
    n AS (SELECT doc_id, ['slack', 'gmail', 'jira', 'linear', 'github', 'confluence', 'google_drive', 'fireflies', 'hubspot', 'other'][content_len % 10 + 1] AS s FROM corpus)
    SELECT doc_id, coalesce(k, 'custom') AS kind, coalesce(p, n.s) AS provider FROM n LEFT JOIN m USING (s)""", "corpus")
def kind_mapping(spark, sf_dir):
    names = F.array(*map(F.lit, [*ft.KINDS, "other"]))
    own = ad.corpus(spark, sf_dir).select("doc_id", F.element_at(names, F.col("content_len") % 10 + 1).alias("s"))
    return own.withColumn("k", ft.kind_of(F.col("s"))).select("doc_id", "k.kind", "k.provider")


@query("thread_messages", """SELECT doc_id || '_m' || lpad(CAST(n AS VARCHAR), 4, '0') AS id, doc_id || '_m0000' AS thread_id, CASE WHEN n = 0 THEN '' ELSE doc_id || '_m' || lpad(CAST(n - 1 AS VARCHAR), 4, '0') END AS parent_id,
    strftime(make_timestamp((1735689600 + 45 * n) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(1735689600 + 45 * n AS VARCHAR) || '.' || lpad(CAST(n AS VARCHAR), 6, '0') AS stamp, '#' || doc_id || ' — message ' || (n + 1) || '/' || total AS title
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, author, body) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM threads)""", "threads")
def thread_messages(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("i", "author", "body")
    t = ad.threads(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    t = t.withColumn("id", F.format_string("%s_m%04d", "doc_id", "n"))
    epoch = F.lit(ft.THREAD_EPOCH) + ft.THREAD_STEP * F.col("n")
    return t.select(
        "id", F.first("id").over(w).alias("thread_id"), F.coalesce(F.lag("id").over(w), F.lit("")).alias("parent_id"), ft.iso(epoch).alias("at"), F.format_string("%d.%06d", epoch, "n").alias("stamp"),
        F.concat(F.lit("#"), "doc_id", F.lit(" — message "), (F.col("n") + 1).cast("string"), F.lit("/"), F.col("total").cast("string")).alias("title"),
    )


@query("title_cap", "SELECT doc_id, CASE WHEN content_len <= 80 THEN content ELSE rtrim(substring(content, 1, 79), e' \\t\\n\\r') || '…' END AS capped FROM corpus", "corpus")
def title_cap(spark, sf_dir):
    return ad.corpus(spark, sf_dir).select("doc_id", ft.cap(F.col("content"), ft.CHANNEL_MAX).alias("capped"))


@query("unescape", r"""SELECT doc_id, md5(CASE WHEN n >= 3 AND n > (length(t) - length(replace(t, chr(10), ''))) THEN replace(t, '\n', chr(10)) ELSE t END) AS text_md5
    FROM (SELECT doc_id, t, (length(t) - length(replace(t, '\n', ''))) // 2 AS n FROM (SELECT doc_id, CASE WHEN content_len % 2 = 0 THEN replace(content, chr(10), '\n') ELSE content END AS t FROM corpus))""", "corpus")
def unescape(spark, sf_dir):
    t = F.when(F.col("content_len") % 2 == 0, F.replace("content", F.lit("\n"), F.lit("\\n"))).otherwise(F.col("content"))
    return ad.corpus(spark, sf_dir).select("doc_id", F.md5(ft.unescape(t)).alias("text_md5"))


@query("address_split", """SELECT c_custkey, array_to_string([lower(c_name) || '@example.org', c_mktsegment], '|') AS parts, CAST(2 AS BIGINT) AS n FROM customer""")
def address_split(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.lower("c_name"), F.lit("@example.org ,, "), "c_mktsegment", F.lit("\t,"))
    parts = ft.listed(raw)
    return ad.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("metadata_flatten", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n, string_agg(author || CASE WHEN i % 2 = 0 THEN ': ' || i ELSE '' END, ',' ORDER BY i, author) AS flat FROM threads GROUP BY 1", "threads")
def metadata_flatten(spark, sf_dir):
    part = F.struct("author", F.when(F.col("i") % 2 == 0, F.col("i")).alias("at"))
    t = ad.threads(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("i", "author", part.alias("v")))).alias("all"))
    return t.select("doc_id", "n", F.array_join(F.transform("all", lambda x: ft.flat(x["v"], "author", "at")), ",").alias("flat"))


@query("endpoint_normalise", "SELECT page_id, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')) AS endpoint FROM pages WHERE contains(url, '://')")
def endpoint_normalise(spark, sf_dir):
    return ad.table(spark, sf_dir, "pages").where(F.contains("url", F.lit("://"))).select("page_id", ft.endpoint(F.concat(F.upper(F.substring("url", 1, 4)), F.expr("substring(url, 5)"), F.lit("/?q=1#x"))).alias("endpoint"))


@query("retry_hint", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 60 END AS INTEGER) AS seconds FROM events")
def retry_hint(spark, sf_dir):
    told = F.concat(F.lit("Rate limited. Retry in "), F.col("event_id") % 60, F.lit(" seconds"))
    return ad.table(spark, sf_dir, "events").select("event_id", ft.retry_seconds(F.when(F.col("event_id") % 2 == 0, told).otherwise("no hint")).alias("seconds"))


@query("item_suffix", "SELECT doc_id, doc_id AS stripped FROM corpus", "corpus")
def item_suffix(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("_m0001"), F.lit("_e07"), F.lit("_c12"), F.lit("")), F.col("content_len") % 4 + 1)
    return ad.corpus(spark, sf_dir).select("doc_id", ft.document_of(F.concat("doc_id", kind)).alias("stripped"))


@query("thread_items", """SELECT id, kind, doc_id FROM (SELECT doc_id || '_m' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, author, body) - 1 AS VARCHAR), 4, '0') AS id, 'message' AS kind, doc_id FROM threads)""", "threads")
def thread_items(spark, sf_dir):
    """conversations written as chat exports and read back by the chat parser."""
    said = F.concat(F.lit("\n\n"), F.initcap("author"), F.lit(" Speaker: "), F.regexp_replace("body", r"\s+", " "))
    docs = ad.threads(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "author", "body", said.alias("t")))).alias("all"))
    docs = docs.select("doc_id", F.lit("slack").alias("source_type"), F.col("doc_id").alias("title"), F.array_join(F.transform("all", lambda x: x["t"]), "").alias("content"))
    return items.typed_items(docs).select("id", "kind", "doc_id")


def _exports(messages, kind, line):
    """One export for each thread: its messages, each written as line (a column), in order."""
    docs = messages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "author", "body", line.alias("t")))).alias("all"))
    return docs.select("doc_id", F.lit(kind).alias("source_type"), F.col("doc_id").alias("title"), F.array_join(F.transform("all", lambda x: x["t"]), "\n\n" if kind == "gmail" else "\n").alias("content"))


_field = lambda path: F.get_json_object("fields", f"$.{path}")
_one_line = lambda c: F.regexp_replace(c, r"\s+", " ")


@query("mail_items", """SELECT CASE WHEN total > 1 THEN doc_id || '_e' || printf('%02d', n) ELSE doc_id END AS id, doc_id, author || '@example.org' AS sender, CASE WHEN n > 0 THEN doc_id || '_e' || printf('%02d', n - 1) END AS reply_to
    FROM (SELECT doc_id, author, row_number() OVER (PARTITION BY doc_id ORDER BY i, author, body) - 1 AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM threads)""", "threads")
def mail_items(spark, sf_dir):
    """conversations written as mails in a row and read back by the mail parser."""
    line = F.concat(F.lit("From: "), "author", F.lit("@example.org\nSubject: s\n\n"), _one_line("body"))
    return items.typed_items(_exports(ad.threads(spark, sf_dir), "gmail", line)).select("id", "doc_id", _field("from").alias("sender"), _field("in_reply_to").alias("reply_to"))


@query("ticket_items", """SELECT doc_id AS id, doc_id, NULL AS author, NULL AS created_at FROM threads GROUP BY doc_id
    UNION ALL SELECT doc_id || '_c' || printf('%02d', row_number() OVER (PARTITION BY doc_id ORDER BY i, author, body) - 1), doc_id, upper(author[1]) || author[2:] || ' Writer', '2024-01-' || printf('%02d', i % 28 + 1) || 'T00:00:00Z' FROM threads WHERE NOT regexp_full_match(body, '\\s*')""", "threads")
def ticket_items(spark, sf_dir):
    """conversations written as comments of a ticket and read back by the ticket parser."""
    line = F.concat(F.format_string("2024-01-%02d - ", F.col("i") % 28 + 1), F.initcap("author"), F.lit(" Writer: "), _one_line("body"))
    docs = _exports(ad.threads(spark, sf_dir), "jira", line).withColumn("content", F.concat(F.lit("What happened.\ncomments:\n"), "content"))
    return items.typed_items(docs).select("id", "doc_id", _field("author").alias("author"), _field("created_at").alias("created_at"))


@query("page_revisions", "SELECT doc_id, CAST(2 AS BIGINT) AS revision_count, '2024-02-' || printf('%02d', content_len % 28 + 1) || 'T00:00:00Z' AS latest FROM corpus", "corpus")
def page_revisions(spark, sf_dir):
    """documents as pages that end in a revision history."""
    day = (F.col("content_len") % 28 + 1).cast("int")
    text = F.concat("content", F.lit("\n\nRevision history\n"), F.format_string("- 2024/01/%02d (Ann): first\n- 2024-02-%02d: second", day, day))
    docs = ad.corpus(spark, sf_dir).select("doc_id", F.lit("confluence").alias("source_type"), "title", text.alias("content"))
    return items.typed_items(docs).select("doc_id", F.get_json_object("metadata", "$.revision_count").cast("long").alias("revision_count"), F.col("timestamp").alias("latest"))


@query("section_map", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name AS body, c_mktsegment AS market_segment FROM customer")
def section_map(spark, sf_dir):
    """customers as records with labelled sections; of a label that stands twice the last counts."""
    text = F.concat("c_name", F.lit("\nmarket segment:\nnone\nmarket segment:\n"), "c_mktsegment")
    docs = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), F.lit("hubspot").alias("source_type"), F.col("c_name").alias("title"), text.alias("content"))
    return items.typed_items(docs).select("doc_id", _field("data.body").alias("body"), _field("data.market_segment").alias("market_segment"))


@query("kind_counts", "SELECT 'custom' AS kind, count(*) AS n FROM corpus WHERE NOT regexp_full_match(content, '\\s*') HAVING count(*) > 0", "corpus")
def kind_counts(spark, sf_dir):
    return items.kind_counts(items.typed_items(ad.corpus(spark, sf_dir)))


# --- validation and corrections


@query("group_stats", """SELECT question_type AS grp, grouping(question_type) = 1 AS is_total, count(*) AS n, round(100.0 * avg(CASE WHEN answer_correct THEN 1.0 ELSE 0.0 END), 6) AS correctness, round(avg(completeness_pct), 6) AS completeness,
    round(avg(CASE WHEN answer_correct THEN completeness_pct ELSE 0 END), 6) AS combined, round(coalesce(avg(document_recall_pct), 0), 6) AS recall, round(coalesce(avg(invalid_extra_docs), 0), 6) AS invalid_extra FROM results GROUP BY GROUPING SETS ((), (question_type))""", "results")
def group_stats(spark, sf_dir):
    return metrics.group_stats(ad.results(spark, sf_dir)).select("grp", "is_total", "n", *[F.round(c, 6).alias(c) for c in validation.CHECKED])


@query("dup_ids", "SELECT question_type AS key, count(*) || ' rows' AS problem FROM results GROUP BY 1 HAVING count(*) > 1", "results")
def dup_ids(spark, sf_dir):
    return validation.duplicates(ad.results(spark, sf_dir), "question_type").select("key", "problem")


@query("coverage_diff", "SELECT coalesce(a.id, b.id) AS key, CASE WHEN a.id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT 'd' || doc_id AS id FROM labels WHERE quality = 1) a FULL JOIN (SELECT doc_id AS id FROM corpus WHERE content_len % 2 = 0) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL", "corpus")
def coverage_diff(spark, sf_dir):
    a = ad.table(spark, sf_dir, "labels").where("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("question_id"))
    e = ad.corpus(spark, sf_dir).where("content_len % 2 = 0").select(F.col("doc_id").alias("question_id"))
    return validation.coverage(a, e).select("key", "problem")


@query("metric_bounds", "SELECT question_id AS key, 'completeness_pct' || CASE WHEN document_recall_pct = 100 THEN ',document_recall_pct' ELSE '' END AS problem FROM results WHERE completeness_pct > 50 UNION ALL SELECT question_id, 'document_recall_pct' FROM results WHERE completeness_pct <= 50 AND document_recall_pct = 100", "results")
def metric_bounds(spark, sf_dir):
    """Results that were tampered with: completeness doubled, full recall made NaN."""
    r = ad.results(spark, sf_dir).withColumn("completeness_pct", F.col("completeness_pct") * 2).withColumn("document_recall_pct", F.when(F.col("document_recall_pct") == 100, float("nan")).otherwise(F.col("document_recall_pct")))
    return validation.metric_bounds(r).select("key", "problem")


@query("stored_stats_check", "SELECT question_type AS key, 'completeness' AS problem FROM results GROUP BY 1 HAVING count(*) % 2 = 0", "results")
def stored_stats_check(spark, sf_dir):
    own = metrics.group_stats(ad.results(spark, sf_dir))
    off = own.withColumn("completeness", F.when(~F.col("is_total") & (F.col("n") % 2 == 0), F.col("completeness") + 1).otherwise(F.round("completeness", 2)))
    return validation.stored_stats(off, own).select("key", "problem")


#: The same as _corrections tells: what records declare is tampered with in every eleventh (set flag) and thirteenth (before).
CORRECTED = """, c0 AS (SELECT question_id, length(question) AS n, ids, len(ids) AS g, CASE WHEN length(question) % 4 = 2 THEN ids[2:] ELSE ids END AS after FROM questions JOIN gold USING (question_id)),
    c AS (SELECT *, n % 2 = 0 AS recorded, (n % 4 = 2 AND g > 0) <> (n % 11 = 0) AS set_flag, n % 3 = 0 AS answer_flag FROM c0)"""


def _corrections(spark, sf_dir):
    """(questions, plan, records): synthetic corrections of questions with an even number of characters.

    In every other one the first gold document goes, in the others the sets stay and a valid document is added; the
    answer changes in every third; every seventh has no reasons.
    """
    q = ad.questions(spark, sf_dir).withColumn("gold_answer", F.md5("question")).withColumn("answer_facts", F.array("question")).join(_gold(spark, sf_dir), "question_id").withColumn("n", F.length("question"))
    q = kept(q, "originals")
    gold, reasons = F.col("expected_doc_ids"), F.when(F.col("n") % 7 != 0, F.array(F.lit("r"))).otherwise(F.expr(judging.EMPTY))
    after = F.when(F.col("n") % 4 == 2, F.slice(gold, F.lit(2), F.size(gold))).otherwise(gold)
    up = q.where("n % 2 = 0").select("question_id", F.lit(True).alias("updated"), after.alias("expected_doc_ids"), F.slice(gold, 1, 1).alias("valid_doc_ids"), F.when(F.col("n") % 3 == 0, "other").otherwise(F.col("gold_answer")).alias("gold_answer"), "answer_facts", reasons.alias("update_reasons"))
    plan = judging.shard_plan(q, 4)
    return q, plan, judging.correction_records(q, up.join(plan.select("shard", "question_id"), "question_id"), plan)


@query("correction_overlay", "SELECT question_id, array_to_string(CASE WHEN length(question) % 4 = 2 THEN ids[2:] ELSE ids END, ',') AS gold, array_to_string(CASE WHEN length(question) % 2 = 0 THEN ids[1:1] ELSE [] END, ',') AS valid, length(question) % 2 = 0 AS corrected FROM questions JOIN gold USING (question_id)", "questions gold")
def correction_overlay(spark, sf_dir):
    q, _, c = _corrections(spark, sf_dir)
    return judging.overlaid(q, c).select("question_id", F.array_join("expected_doc_ids", ",").alias("gold"), F.array_join("valid_doc_ids", ",").alias("valid"), "corrected")


@query("correction_audit", CORRECTED + """
    SELECT question_id, 'flagged without record' AS problem FROM c WHERE n % 5 = 0 AND NOT recorded UNION ALL SELECT question_id, 'changes gold without flag' FROM c WHERE recorded AND n % 5 <> 0 AND (set_flag OR answer_flag)
    UNION ALL SELECT question_id, 'changes nothing' FROM c WHERE recorded AND NOT set_flag AND NOT answer_flag AND g = 0 UNION ALL SELECT question_id, 'wrong set flag' FROM c WHERE recorded AND n % 11 = 0
    UNION ALL SELECT question_id, 'wrong answer flag' FROM c WHERE recorded AND n % 13 = 0 AND NOT answer_flag UNION ALL SELECT question_id, 'before is not the original' FROM c WHERE recorded AND n % 13 = 0
    UNION ALL SELECT question_id, 'recall not reproduced' FROM c WHERE recorded AND n % 8 <> 0 AND n % 9 = 0 AND len(after) > 0
    UNION ALL SELECT question_id, 'after is incomplete' FROM c WHERE recorded AND len(after) = 0 UNION ALL SELECT question_id, 'no reasons' FROM c WHERE recorded AND n % 7 = 0""", "questions gold")
def correction_audit(spark, sf_dir):
    """Results tell another recall in every ninth question; questions of a multiple of eight characters have no answer."""
    q, _, c = _corrections(spark, sf_dir)
    n = F.length("question")
    c = c.join(q.select("question_id", "question"), "question_id")
    c = c.withColumn("doc_set_changed", F.col("doc_set_changed") != (n % 11 == 0)).withColumn("before_answer", F.when(n % 13 == 0, "x").otherwise(F.col("before_answer"))).drop("question")
    submitted = q.select("question_id", "n", F.slice("expected_doc_ids", 1, 3).alias("document_ids"))
    gold = judging.overlaid(q, c).select("question_id", F.col("expected_doc_ids").alias("after"))
    told = submitted.join(gold, "question_id").withColumn("recall", F.when(F.size("after") > 0, 100.0 * F.size(F.array_intersect("document_ids", "after")) / F.size("after")))
    results = told.select("question_id", (F.col("n") % 5 == 0).alias("corrected"), (F.col("recall") + F.when(F.col("n") % 9 == 0, 1.0).otherwise(0.0)).alias("document_recall_pct"))
    return judging.audit_corrections(results, c, q, submitted.where("n % 8 <> 0"))


@query("correction_counts", CORRECTED + """
    SELECT CAST(count(*) FILTER (n % 4 = 2 AND g > 0) AS BIGINT) AS doc_set_changed, CAST(count(*) FILTER (recorded AND answer_flag) AS BIGINT) AS gold_answer_changed, CAST(count(*) FILTER (recorded) AS BIGINT) AS records, CAST(count(*) FILTER (n % 5 <> 0) AS BIGINT) AS uncorrected FROM c""", "questions gold")
def correction_counts(spark, sf_dir):
    q, _, c = _corrections(spark, sf_dir)
    return judging.correction_counts(q.select((F.col("n") % 5 == 0).alias("corrected")), c)


@query("retrieval_metrics_check", "SELECT g.question_id, CASE WHEN len(g.ids) > 0 THEN round(100.0 * len(list_intersect(coalesce(r.ids, [])[1:10], g.ids)) / len(g.ids), 6) END AS recall_pct, CASE WHEN len(g.ids) > 0 THEN CAST(len(list_filter(r.ids[1:10], lambda x: NOT list_contains(g.ids, x) AND x <> r.ids[2])) AS BIGINT) END AS invalid_extra FROM gold g JOIN ranked r USING (question_id)", "gold ranked")
def retrieval_metrics_check(spark, sf_dir):
    r = _ranked(_hits(spark, sf_dir))
    gold = _gold(spark, sf_dir).join(r.select("question_id", F.slice("document_ids", 2, 1).alias("valid_doc_ids")), "question_id")
    return validation.retrieval_metrics(gold, r.select("question_id", F.slice("document_ids", 1, 10).alias("document_ids"))).select("question_id", F.round("recall_pct", 6).alias("recall_pct"), "invalid_extra")


def _checkpoint(spark, sf_dir):
    """Synthetic checkpoint rows of documents: ids of neighbours, submitted ones broken in every fourth."""
    c = ad.corpus(spark, sf_dir).withColumn("id", F.substring("doc_id", 2, 20).cast("long"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.lit("d"), (F.col("id") + k).cast("string")))
    sub = F.when(F.col("id") % 4 == 0, F.slice(ids, 2, 2)).otherwise(F.slice(ids, 1, 3))
    return c.select(F.col("doc_id").alias("question_id"), "id", F.lit("answered").alias("stage"), ids.alias("retrieved_doc_ids"), sub.alias("document_ids"), F.col("title").alias("answer"), F.col("content").alias("context"), F.sha2("content", 256).alias("context_sha256"), F.length("content").alias("context_chars"), F.slice(ids, 1, 2).alias("context_docs"))


@query("prefix_check", "SELECT 'd' || doc_id AS key, 'no prefix of the ranking' AS problem FROM documents WHERE doc_id % 4 = 0")
def prefix_check(spark, sf_dir):
    return validation.checkpoint(_checkpoint(spark, sf_dir)).select("key", "problem")


@query("context_checks", "SELECT 'd' || doc_id AS key, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'hash' END, CASE WHEN doc_id % 5 = 0 THEN 'length' END, CASE WHEN doc_id % 7 = 0 THEN 'repeated document' END], lambda x: x IS NOT NULL), ',') AS problem FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0")
def context_checks(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    bad = lambda n: F.col("id") % n == 0
    c = c.withColumn("context_sha256", F.when(bad(3), "0").otherwise(F.col("context_sha256"))).withColumn("context_chars", F.col("context_chars") + F.when(bad(5), 1).otherwise(0)).withColumn("context_docs", F.when(bad(7), F.array(F.lit("a"), F.lit("a"))).otherwise(F.col("context_docs")))
    return validation.contexts(c).select("key", "problem")


@query("context_checkpoint_join", "SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'no context' WHEN doc_id % 3 = 0 THEN 'other text' ELSE 'other documents' END AS problem FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0")
def context_checkpoint_join(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    bad = lambda n: F.col("id") % n == 0
    rows = c.where(~bad(5)).withColumn("context_sha256", F.when(bad(3), "0").otherwise(F.col("context_sha256"))).withColumn("context_docs", F.when(bad(7), F.array(F.lit("a"))).otherwise(F.col("context_docs")))
    return validation.contexts_against_checkpoint(rows, c).select("key", "problem")


@query("answer_checkpoint_join", "SELECT 'd' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'other answer' ELSE 'other documents' END AS problem FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")
def answer_checkpoint_join(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    own = c.select("question_id", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("answer")).alias("answer"), F.when(F.col("id") % 7 == 0, F.array(F.lit("x"))).otherwise(F.col("document_ids")).alias("document_ids"))
    return validation.answers_against_checkpoint(own, c).select("key", "problem")


@query("answer_preflight", "SELECT 'd' || doc_id AS key, 'no answer' AS problem FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'd' || doc_id, 'unknown question' FROM documents WHERE doc_id % 5 = 0")
def answer_preflight(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    own = c.select("question_id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("answer")).alias("answer"), "document_ids")
    return validation.answers(own, c.where("id % 5 <> 0")).select("key", "problem")


@query("run_verdict", "SELECT * FROM (VALUES ('prefix', 'fail', (SELECT count(*) FROM documents WHERE doc_id % 4 = 0)), ('checkpoint', 'ok', 0), ('judging', 'incomplete', 0)) v(\"check\", state, problems)")
def run_verdict(spark, sf_dir):
    return validation.verdict(validation.checkpoint(_checkpoint(spark, sf_dir)), ["prefix", "checkpoint"], ["judging"])


@query("slack_only", "SELECT source, count(*) AS n FROM results WHERE source = 'src0' GROUP BY 1", "results")
def slack_only(spark, sf_dir):
    r = ad.results(spark, sf_dir).withColumn("source_types", F.array("source"))
    return r.where(F.col("source_types") == F.array(F.lit("src0"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("shard_plan", "SELECT question_id, CAST(floor((row_number() OVER (ORDER BY question_id) - 1) / ceil(count(*) OVER () / 7.0)) AS INTEGER) AS shard FROM questions", "questions")
def shard_plan(spark, sf_dir):
    return judging.shard_plan(ad.questions(spark, sf_dir), 7).select("question_id", "shard")


def _shards(spark, sf_dir):
    q = ad.questions(spark, sf_dir).withColumn("n", F.length("question"))
    plan = judging.shard_plan(q, 7)
    rows = plan.join(q, "question_id")
    parts = rows.where("n % 4 <> 0").select("shard", "question_id").union(rows.where("n % 5 = 0").select(F.col("shard") + 1, "question_id"))
    return plan, parts


@query("shard_merge", "SELECT question_id, 'missing' AS problem FROM questions WHERE length(question) % 4 = 0 UNION ALL SELECT question_id, 'not this shard''s' FROM questions WHERE length(question) % 5 = 0", "questions")
def shard_merge(spark, sf_dir):
    plan, parts = _shards(spark, sf_dir)
    return judging.merge(parts, plan)[1]


@query("shard_owned", "SELECT question_id, CAST(floor((r - 1) / e) AS INTEGER) AS shard FROM (SELECT *, row_number() OVER (ORDER BY question_id) AS r, ceil(count(*) OVER () / 7.0) AS e FROM questions) WHERE length(question) % 4 <> 0", "questions")
def shard_owned(spark, sf_dir):
    plan, parts = _shards(spark, sf_dir)
    return judging.merge(parts, plan)[0].select("question_id", "shard")


@query("shard_complete", "SELECT CAST(shard AS INTEGER) AS shard, bool_and(n % 4 <> 0) AS complete FROM (SELECT floor((row_number() OVER (ORDER BY question_id) - 1) / ceil(count(*) OVER () / 7.0)) AS shard, length(question) AS n FROM questions) GROUP BY 1", "questions")
def shard_complete(spark, sf_dir):
    plan, parts = _shards(spark, sf_dir)
    return judging.complete_shards(parts, plan)


@query("target_selection", "SELECT question_id FROM (SELECT question_id FROM questions WHERE length(question) % 2 = 0 ORDER BY question_id DESC LIMIT 7) UNION ALL SELECT max(question_id) FROM questions WHERE length(question) % 2 = 0 HAVING count(*) > 0", "questions")
def target_selection(spark, sf_dir):
    """The first eight of a list that begins with its first question twice."""
    q = ad.questions(spark, sf_dir)
    w = Window.orderBy(F.desc("question_id"))
    listed = q.where(F.length("question") % 2 == 0).select((F.row_number().over(w) * 2).alias("ordinal"), "question_id")
    return judging.select_questions(q, listed.union(listed.where("ordinal = 2").withColumn("ordinal", F.lit(1))), 8).select("question_id")


@query("resume_forced", "SELECT 'd' || doc_id AS key, 'left out and not complete' AS problem FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0 AND doc_id % 5 = 0")
def resume_forced(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    saved = c.where("id % 2 = 0").withColumn("stage", F.when(F.col("id") % 5 == 0, "retrieved").otherwise(F.col("stage")))
    return validation.selection(saved, c.where("id % 3 <> 0"), force=True).select("key", "problem")


@query("answer_shapes", """SELECT CAST(count(*) AS BIGINT) AS n, problem FROM (SELECT CASE page_id % 4 WHEN 1 THEN 'OBJECT<answer: STRING, document_ids: STRING, question_id: STRING>' WHEN 2 THEN 'OBJECT<answer: STRING, document_ids: ARRAY<STRING>, extra: BOOLEAN, question_id: STRING>' WHEN 3 THEN 'no JSON' END AS problem FROM pages) WHERE problem IS NOT NULL GROUP BY 2""")
def answer_shapes(spark, sf_dir):
    """Lines of answers made of pages, three of four broken."""
    p = ad.table(spark, sf_dir, "pages").withColumn("m", F.col("page_id") % 4)
    text, ids = F.concat(F.lit("p"), F.col("page_id")), F.array(F.lit("d1"))
    shapes = (F.struct(text.alias("question_id"), text.alias("answer"), ids.alias("document_ids")), F.struct(text.alias("question_id"), text.alias("answer"), text.alias("document_ids")), F.struct(text.alias("question_id"), text.alias("answer"), ids.alias("document_ids"), F.lit(True).alias("extra")))
    lines = p.select(F.when(F.col("m") == 0, F.to_json(shapes[0])).when(F.col("m") == 1, F.to_json(shapes[1])).when(F.col("m") == 2, F.to_json(shapes[2])).otherwise(F.concat(F.lit("{broken "), text)).alias("value"))
    return validation.answer_shape(lines).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("resume_selection", "SELECT 'd' || doc_id AS key, 'left out' AS problem FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def resume_selection(spark, sf_dir):
    c = _checkpoint(spark, sf_dir)
    return validation.selection(c.where("id % 2 = 0"), c.where("id % 3 <> 0")).select("key", "problem")


# --- ingestion


@query("status_dedup", "SELECT batch, id, arg_max(status, seq) AS status, max(seq) AS seq FROM log GROUP BY ALL", "log")
def status_dedup(spark, sf_dir):
    return ledger.latest_status(ad.status_log(spark, sf_dir))


@query("adopted_statuses", "SELECT batch, id, arg_max(status, seq) AS status FROM log WHERE batch >= '2024-01-10' GROUP BY ALL HAVING arg_max(status, seq) <> 'pending'", "log")
def adopted_statuses(spark, sf_dir):
    log = ad.status_log(spark, sf_dir)
    return ledger.adopted(log, log.where("batch >= '2024-01-10'").select("batch", "id").distinct()).select("batch", "id", "status")


@query("readiness", """, last AS (SELECT id, arg_max(status, seq) AS status FROM log GROUP BY 1), n AS (SELECT count(*) AS items_sent, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS settled, CAST(count(*) FILTER (status = 'errored') AS BIGINT) AS errored, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending FROM last)
    SELECT *, CAST(0 AS BIGINT) AS unresolved, pending = 0 AS resolved, pending = 0 AND errored = 0 AS ready FROM n""", "log")
def readiness(spark, sf_dir):
    log = ad.status_log(spark, sf_dir)
    return ledger.readiness(log.select("id"), log)


@query("readiness_accepting", """, last AS (SELECT id, arg_max(status, seq) AS status FROM log WHERE status <> 'pending' GROUP BY 1), n AS (SELECT count(*) AS items_sent, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS settled, CAST(count(*) FILTER (status = 'errored') AS BIGINT) AS errored, CAST(0 AS BIGINT) AS pending FROM last)
    SELECT *, unresolved = 0 AS resolved, unresolved = 0 AS ready FROM n, (SELECT count(DISTINCT batch) AS unresolved FROM log WHERE batch >= '2024-01-25')""", "log")
def readiness_accepting(spark, sf_dir):
    """Failures are accepted, batches from a day on are still open."""
    log = ad.status_log(spark, sf_dir)
    final = log.where("status <> 'pending'")
    return ledger.readiness(final.select("id"), final, accept_failures=True, open_batches=log.where("batch >= '2024-01-25'"))


BATCH_STATES = """, last AS (SELECT batch, id, arg_max(status, seq) AS status FROM log GROUP BY ALL), n AS (SELECT batch, count(*) AS n_items, CAST(count(*) FILTER (status = 'completed') AS BIGINT) AS settled, CAST(count(*) FILTER (status = 'errored') AS BIGINT) AS errored FROM last GROUP BY 1),
    j AS (SELECT batch, CASE WHEN max(seq) % 3 = 0 THEN 'sending' ELSE 'sent' END AS state FROM log GROUP BY 1)
    SELECT batch, CASE WHEN state = 'sent' AND settled + errored = n_items THEN 'settled' ELSE state END AS state, n_items, settled, errored FROM j JOIN n USING (batch)"""


def _batch_journal(log):
    """A batch is still being sent if its last event's number is a multiple of three."""
    return log.groupBy("batch").agg(F.max("seq").alias("seq")).withColumn("state", F.when(F.col("seq") % 3 == 0, "sending").otherwise("sent"))


@query("batch_states", BATCH_STATES, "log")
def batch_states(spark, sf_dir):
    log = ad.status_log(spark, sf_dir)
    return ledger.batch_states(_batch_journal(log), log, log)


@query("stream_batch_states", BATCH_STATES, "log")
def stream_batch_states(spark, sf_dir):
    """The same from events that are streamed as files, and a streamed journal; no batch is old enough to be called stalled."""
    from ..streaming import ledger as streamed
    from .workspace import fresh

    root = fresh(spark, "ledger")
    raw = spark.readStream.schema(ad.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    streamed.settle_items(ad.statuses(raw), root).awaitTermination()
    log = ad.status_log(spark, sf_dir)
    _batch_journal(log).withColumn("ts", F.col("batch").cast("timestamp")).write.parquet(f"{root}/journal")
    journal = spark.readStream.schema("batch string, seq long, state string, ts timestamp").parquet(f"{root}/journal")
    streamed.settle_batches(spark, journal, root, patience_ms=10**12).awaitTermination()
    return streamed.batch_states(spark, root)


@query("journal_source", """SELECT batch, seq, CASE WHEN seq % 3 = 0 THEN 'sending' ELSE 'sent' END AS state, CAST(row_number() OVER (ORDER BY batch) AS BIGINT) AS place FROM (SELECT batch, max(seq) AS seq FROM log GROUP BY 1)""", "log")
def journal_source(spark, sf_dir):
    """The batches' journal as a file of lines, a batch a line, read in small splits; place follows from where a line begins."""
    from ..operators.ordering import row_numbers
    from .workspace import fresh

    path = fresh(spark, "journal")
    lines = _batch_journal(ad.status_log(spark, sf_dir)).orderBy("batch").select(F.to_json(F.struct("batch", "seq", "state")))
    lines.coalesce(1).write.text(path)
    rows = journal.read(spark, spark.read.text(path).inputFiles()[0], "batch string, seq long, state string", 256)
    return row_numbers(rows, "at", out="place").select("batch", "seq", "state", (F.col("place") + 1).alias("place"))


@query("next_attempts", "SELECT CAST(shard AS INTEGER) AS shard, CAST(1 + max(CASE WHEN n % 2 = 0 THEN n % 5 ELSE 0 END) AS INTEGER) AS attempt FROM (SELECT floor((row_number() OVER (ORDER BY question_id) - 1) / ceil(count(*) OVER () / 7.0)) AS shard, length(question) AS n FROM questions) GROUP BY 1", "questions")
def next_attempts(spark, sf_dir):
    q = ad.questions(spark, sf_dir).withColumn("n", F.length("question"))
    plan = judging.shard_plan(q, 7)
    tried = plan.join(q.where("n % 2 = 0").select("question_id", (F.col("n") % 5).alias("attempt")), "question_id")
    return ledger.next_attempt(tried, plan)


@query("failed_ledger", """, f AS (SELECT *, coalesce(max(CASE WHEN status = 'completed' THEN seq END) OVER (PARTITION BY id), -1) AS good FROM log WHERE status <> 'pending')
    SELECT id, CAST(count(*) AS BIGINT) AS attempts, max(seq) AS seq FROM f WHERE status = 'errored' AND seq > good GROUP BY 1""", "log")
def failed_ledger(spark, sf_dir):
    return ledger.failed_items(ad.status_log(spark, sf_dir))


@query("retry_documents", """, f AS (SELECT *, coalesce(max(CASE WHEN status = 'completed' THEN seq END) OVER (PARTITION BY id), -1) AS good FROM log WHERE status <> 'pending')
    SELECT id AS doc_id, CAST(1 AS BIGINT) AS n FROM f WHERE status = 'errored' AND seq > good AND NOT ends_with(id, '7') GROUP BY 1""", "log")
def retry_documents(spark, sf_dir):
    failed = ledger.failed_items(ad.status_log(spark, sf_dir)).select(F.concat("id", F.lit("_c01")).alias("id"))
    return ledger.failed_documents(failed, failed.where("id like '%7\\\\_c01'")).select("doc_id", F.size("ids").cast("long").alias("n"))


@query("aligned_batches", """, o AS (SELECT source_type, doc_id, content_len AS size, row_number() OVER (PARTITION BY source_type ORDER BY doc_id) AS r FROM corpus),
    b AS (SELECT source_type, doc_id, r, 0 AS batch, CAST(CASE WHEN size >= 20000 THEN 0 ELSE size END AS BIGINT) AS n, CASE WHEN size >= 20000 THEN 1 ELSE 0 END AS next FROM o WHERE r = 1
    UNION ALL SELECT o.source_type, o.doc_id, o.r, b.next, CASE WHEN b.n + o.size >= 20000 THEN 0 ELSE b.n + o.size END, CASE WHEN b.n + o.size >= 20000 THEN b.next + 1 ELSE b.next END FROM b JOIN o ON o.source_type = b.source_type AND o.r = b.r + 1)
    SELECT source_type, doc_id, batch FROM b""", "corpus")
def aligned_batches(spark, sf_dir):
    return ledger.aligned_batches(ad.corpus(spark, sf_dir).select("source_type", "doc_id", F.col("content_len").alias("size")), 20_000, "source_type")


@query("journal_fold", "SELECT batch, arg_max(status, seq) AS state, max(seq) AS seq FROM log GROUP BY 1", "log")
def journal_fold(spark, sf_dir):
    journal = ad.status_log(spark, sf_dir).select("batch", "seq", F.col("status").alias("state"))
    return ledger.latest_batches(journal)


# --- comparison


def _pairs(spark, sf_dir):
    a = ad.results(spark, sf_dir)
    return metrics.paired(a, ad.other_results(a))


@query("paired_compare", """SELECT question_type AS grp, grouping(question_type) = 1 AS is_total, count(*) AS n, round(avg(a_score), 6) AS a_combined, round(avg(b_score), 6) AS b_combined, round(avg(b_score - a_score), 6) AS delta,
    round(100.0 * avg(CAST(a_ok AS INTEGER)), 6) AS a_correct, round(100.0 * avg(CAST(b_ok AS INTEGER)), 6) AS b_correct, round(avg(a_complete), 6) AS a_completeness, round(avg(b_complete), 6) AS b_completeness FROM pairs GROUP BY ROLLUP (question_type)""", "pairs")
def paired_compare(spark, sf_dir):
    out = metrics.compare(_pairs(spark, sf_dir))
    return out.select("grp", "is_total", "n", *[F.round(c, 6).alias(c) for c in out.columns[3:]] if out.columns[0] == "grp" else [])


@query("flips", "SELECT CASE WHEN a_ok THEN 'T' ELSE 'F' END || '->' || CASE WHEN b_ok THEN 'T' ELSE 'F' END AS flip, count(*) AS n FROM pairs GROUP BY 1", "pairs")
def flips(spark, sf_dir):
    return metrics.flips(_pairs(spark, sf_dir))


@query("flipped", "SELECT question_id, CASE WHEN a_ok THEN 'T->F' ELSE 'F->T' END AS flip FROM pairs WHERE a_ok <> b_ok", "pairs")
def flipped(spark, sf_dir):
    return metrics.flipped(_pairs(spark, sf_dir))


@query("summary_subset", "SELECT count(*) AS n, round(avg(CASE WHEN answer_correct THEN completeness_pct ELSE 0 END), 6) AS combined, round(100.0 * avg(CAST(answer_correct AS INTEGER)), 6) AS correctness, round(avg(completeness_pct), 6) AS completeness FROM results WHERE source = 'src0'", "results")
def summary_subset(spark, sf_dir):
    r = ad.results(spark, sf_dir)
    out = metrics.summary(r, r.where("source = 'src0'"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("combined", "correctness", "completeness")])


@query("compare_problems", "SELECT question_id AS key, 'missing' AS problem FROM results WHERE source = 'src1'", "results")
def compare_problems(spark, sf_dir):
    """Of a comparison whose first run lacks a source's questions."""
    a = ad.results(spark, sf_dir)
    return metrics.compare_runs(a.where("source <> 'src1' or source is null"), ad.other_results(a))["problems"].select("key", "problem")


@query("bootstrap_ci", """, e AS (SELECT row_number() OVER (ORDER BY question_id) - 1 AS place, b_score - a_score AS delta, count(*) OVER () AS n FROM pairs),
    r AS (SELECT draw, CAST(('0x' || substring(md5('0|' || draw || '|' || place), 1, 8)) AS BIGINT) % n AS place FROM e, (SELECT unnest(range(1000)) AS draw)),
    m AS (SELECT draw, avg(delta) AS mean FROM r JOIN e USING (place) GROUP BY 1), o AS (SELECT mean, row_number() OVER (ORDER BY mean, draw) - 1 AS k FROM m)
    SELECT round(max(CASE WHEN k = 25 THEN mean END), 6) AS low, round(max(CASE WHEN k = 975 THEN mean END), 6) AS high, (SELECT count(*) FROM e) AS n, (SELECT round(avg(delta), 6) FROM e) AS delta_mean FROM o""", "pairs")
def bootstrap_ci(spark, sf_dir):
    out = metrics.bootstrap(_pairs(spark, sf_dir), 1000, 0)
    return out.select(*[F.round(c, 6).alias(c) for c in ("low", "high")], "n", F.round("delta_mean", 6).alias("delta_mean"))


@query("bootstrap_sketch", f""", h AS (SELECT b_score - a_score AS delta, draw, substring(md5('0|' || question_id || '|' || (draw // 4)), 8 * (draw % 4)::INT + 1, 8) AS h FROM pairs, (SELECT unnest(range(1000)) AS draw)),
    m AS (SELECT draw, sum(t * delta) / sum(t) AS mean FROM (SELECT draw, delta, {" + ".join(f"(h >= '{t}')::INT" for t in metrics.OCCURS)} AS t FROM h) GROUP BY 1), o AS (SELECT mean, row_number() OVER (ORDER BY mean, draw) - 1 AS k FROM m)
    SELECT round(max(CASE WHEN k = 25 THEN mean END), 6) AS low, round(max(CASE WHEN k = 975 THEN mean END), 6) AS high FROM o""", "pairs")
def bootstrap_sketch(spark, sf_dir):
    return metrics.interval(metrics.sketch(_pairs(spark, sf_dir), 1000, 0), 1000).select(*[F.round(c, 6).alias(c) for c in ("low", "high")])


@query("corpus_hash", "SELECT source_type, count(*) AS n, sha256(string_agg(doc_id || chr(31) || title || chr(31) || content || chr(10), '' ORDER BY doc_id)) AS sha256 FROM corpus GROUP BY 1", "corpus")
def corpus_hash(spark, sf_dir):
    return identity.content_hash(ad.corpus(spark, sf_dir), "source_type")


@query("corpus_merkle", """, h AS (SELECT sha256(coalesce(source_type, '') || chr(31) || doc_id || chr(31) || title || chr(31) || content || chr(10)) AS h FROM corpus), b AS (SELECT h[1:3] AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY b)) AS sha256 FROM b""", "corpus")
def corpus_merkle(spark, sf_dir):
    return identity.content_merkle(ad.corpus(spark, sf_dir))


@query("corpus_changed", "SELECT source_type AS part, 'changed' AS problem FROM corpus GROUP BY 1 HAVING count(*) FILTER (content_len % 50 = 0) > 0", "corpus")
def corpus_changed(spark, sf_dir):
    """The corpus before and after a run that made some titles longer."""
    c = ad.corpus(spark, sf_dir)
    after = c.withColumn("title", F.when(F.col("content_len") % 50 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return identity.changed(identity.content_hash(c, "source_type"), identity.content_hash(after, "source_type"))


@query("corpus_tree_changes", "SELECT doc_id, CASE content_len % 50 WHEN 0 THEN 'changed' WHEN 1 THEN 'vanished' ELSE 'appeared' END AS problem FROM corpus WHERE content_len % 50 < 3", "corpus")
def corpus_tree_changes(spark, sf_dir):
    """Documents that a later version of the corpus changes, takes out and adds, told by two trees' nodes."""
    from .workspace import fresh

    c = ad.corpus(spark, sf_dir)
    longer = c.withColumn("title", F.when(F.col("content_len") % 50 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    before, after = (merkle.Tree(fresh(spark, "tree"), 1) for _ in range(2))
    before.update(c.where("content_len % 50 <> 2"))
    after.update(longer.where("content_len % 50 <> 1"))
    return merkle.changes(spark, before, after)


@query("inspect_question", "SELECT question_id, question_type, answer_correct, CAST(length(d.text) AS BIGINT) AS context_chars, l.toxic FROM results JOIN documents d ON question_id = 'd' || d.doc_id JOIN labels l USING (doc_id) WHERE question_id = 'd1'", "results")
def inspect_question(spark, sf_dir):
    """All that artifacts hold of one question."""
    one = lambda df: df.where("question_id = 'd1'")
    lab = ad.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("question_id"), "toxic")
    out = one(ad.results(spark, sf_dir)).join(one(_checkpoint(spark, sf_dir)).select("question_id", "context_chars"), "question_id", "left").join(one(lab), "question_id", "left")
    return out.select("question_id", "question_type", "answer_correct", F.col("context_chars").cast("long").alias("context_chars"), "toxic")


@query("tool_calls", """SELECT 'c' || conv_id || '-' || turn AS call_id, role AS name, '{"md5":"' || md5(coalesce(text, '')) || '"}' AS args, CAST(length(coalesce(text, '')) AS BIGINT) AS n_text FROM conversations""")
def tool_calls(spark, sf_dir):
    """Each message as the pieces of a call, in one of two shapes by its turn, after its text in pieces; and folded again."""
    c = ad.table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"))
    text, args = F.coalesce("text", F.lit("")), F.concat(F.lit('{"md5":"'), F.md5(F.coalesce("text", F.lit(""))), F.lit('"}'))
    cut = lambda x, n: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(x) - 1) / n).cast("int"))), lambda i: F.substring(x, i * n + 1, F.lit(n)))
    js, none = F.to_json, F.lit(None)
    named = F.concat(
        F.transform(cut(text, 40), lambda p: js(F.struct(F.lit("response.output_text.delta").alias("type"), p.alias("delta")))),
        F.array(js(F.struct(F.lit("response.output_item.added").alias("type"), F.struct(F.lit("function_call").alias("type"), F.col("id").alias("call_id"), F.col("role").alias("name")).alias("item")))),
        F.transform(cut(args, 7), lambda p: js(F.struct(F.lit("response.function_call_arguments.delta").alias("type"), p.alias("delta")))),
        F.array(js(F.struct(F.lit("response.output_item.done").alias("type"))), js(F.struct(F.lit("response.completed").alias("type")))),
    )
    chunk = lambda **d: js(F.struct(F.array(F.struct(F.struct(*[v.alias(k) for k, v in d.items()]).alias("delta"))).alias("choices")))
    piece = lambda id_, name, a: F.array(F.struct(F.lit(0).alias("index"), id_.alias("id"), F.struct(name.alias("name"), a.alias("arguments")).alias("function")))
    chat = F.concat(
        F.array(chunk(reasoning=F.lit("hm"))), F.transform(cut(text, 40), lambda p: chunk(content=p)), F.array(chunk(tool_calls=piece(F.col("id"), F.col("role"), none.cast("string")))),
        F.transform(cut(args, 5), lambda p: chunk(tool_calls=piece(none.cast("string"), none.cast("string"), p))),
    )
    events = c.select(F.col("id").alias("response"), F.posexplode(F.when(F.col("turn") % 2 == 0, named).otherwise(chat)).alias("seq", "event"))
    return calls.whole(events).select(F.explode("calls").alias("c"), F.length("text").cast("long").alias("n_text")).select("c.*", "n_text")


@query("answer_stub")
def answer_stub(spark, sf_dir):
    return generate(_contexts(spark, sf_dir).join(ad.questions(spark, sf_dir), "question_id"))


@query("stream_ingest", "SELECT doc_id AS id, 'custom' AS kind FROM corpus WHERE NOT regexp_full_match(content, '\\s*')", "corpus")
def stream_ingest(spark, sf_dir):
    """documents streamed as files into a table of items."""
    from ..streaming.ingest import start
    from ..streaming.table import KeyedSink
    from .workspace import fresh

    root = fresh(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    text = F.coalesce("text", F.lit(""))
    docs = raw.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), F.col("source").alias("source_type"), F.substring(text, 1, 40).alias("title"), text.alias("content"))
    sink = KeyedSink(f"{root}/items", 16)
    start(docs, sink, f"{root}/checkpoint", f"{root}/journal").awaitTermination()
    return sink.current(spark).select("id", "kind")
