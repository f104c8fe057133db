"""Sources and sinks of documents, questions, results and journals."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DOCUMENT = "doc_id string, source_type string, title string, content string, content_len int"
#: Why a raw document is rejected, in the order of the checks.
REJECTS = ("no title label", "title field absent", "no content labels", "content labels are no list", "content labels are empty", "content field absent")
RESULT = "question_id string, question_type string, answer_correct boolean, completeness_pct double, document_recall_pct double, invalid_extra_docs int, corrected boolean, correctness_reasoning string"
ANSWER = "question_id string, answer string, document_ids array<string>"


def normalised(rows: DataFrame) -> DataFrame:
    """Corpus rows of (doc_id, source_type, title, content): null content is empty, content_len counts code points."""
    content = F.coalesce("content", F.lit(""))
    return rows.select("doc_id", "source_type", "title", content.alias("content"), F.length(content).alias("content_len"))


def extracted(raw: Column) -> tuple[Column, Column, Column]:
    """(title, content, reject_reason) of a raw document's JSON, whose own labels name the title and content fields.

    One content field is taken as it is; several become blocks of name and value, lists one element a line.
    """
    fields = F.from_json(raw, "map<string,string>")
    names = F.from_json(F.try_element_at(fields, F.lit("content_field_names")), "array<string>")
    has = lambda k: F.coalesce(F.array_contains(F.map_keys(fields), k), F.lit(False))
    value = lambda k: F.coalesce(F.try_element_at(fields, k), F.lit("None"))

    def lines(v: Column) -> Column:
        parts = F.from_json(v, "array<string>")
        return F.when(v.startswith("[") & parts.isNotNull(), F.array_join(parts, "\n", "None")).otherwise(v)

    title_label = F.try_element_at(fields, F.lit("title_field_name"))
    reason = (
        F.when(~has(F.lit("title_field_name")), REJECTS[0])
        .when(~has(title_label), REJECTS[1])
        .when(~has(F.lit("content_field_names")), REJECTS[2])
        .when(names.isNull(), REJECTS[3])
        .when(F.size(names) == 0, REJECTS[4])
        .when(F.exists(names, lambda n: ~has(n)), REJECTS[5])
    )
    one = value(F.try_element_at(names, F.lit(1)))
    several = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(":\n"), lines(value(n)))), "\n\n")
    keep = lambda c: F.when(reason.isNull(), c)
    return keep(value(title_label)), keep(F.when(F.size(names) == 1, one).otherwise(several)), reason


def read_checkout(spark: SparkSession, root: str, source_types: list[str] | None = None) -> DataFrame:
    """Corpus rows of JSON files below root, a folder for each source type; unreadable and rejected files are skipped.

    Of files with the same id the first by path counts.
    """
    paths = [f"{root}/{s}" for s in source_types] if source_types else [root]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(paths)
    raw = files.select("path", F.decode("content", "UTF-8").alias("raw"))
    rest = F.regexp_replace("path", f"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    title, content, reason = extracted(F.col("raw"))
    id_ = F.try_element_at(F.from_json("raw", "map<string,string>"), F.lit("dataset_doc_uuid"))
    rows = raw.select("path", id_.alias("doc_id"), F.split(rest, "/")[0].alias("source_type"), title.alias("title"), content.alias("content"), reason.alias("reason"))
    rows = rows.where("doc_id is not null and reason is null")
    return normalised(first_by(rows, ["doc_id"], ["path"]))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def scan(corpus: DataFrame, source_types: list[str] | None = None, after: str | None = None, limit: int = -1) -> DataFrame:
    """Documents in id order after a cursor; limit -1 is no limit. Predicates reach the scan."""
    out = corpus
    if source_types is not None:
        out = out.where(F.col("source_type").isin(source_types))
    if after is not None:
        out = out.where(F.col("doc_id") > after)
    out = out.orderBy("doc_id")
    return out.limit(limit) if limit >= 0 else out


def fetch(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is among ids; ids that are nowhere are absent."""
    return corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def fetch_with_fallback(ids: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Each id with its document in the first store, else in the second; found_in tells which, null: neither."""
    a = first.select("doc_id", F.struct("source_type", "title", "content").alias("a"))
    b = second.select("doc_id", F.struct("source_type", "title", "content").alias("b"))
    out = ids.select("doc_id").distinct().join(a, "doc_id", "left").join(b, "doc_id", "left")
    return out.select("doc_id", F.coalesce("a", "b").alias("d"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").alias("found_in")).select("doc_id", "d.*", "found_in")


def append_new(rows: DataFrame, existing: DataFrame | None, path: str) -> None:
    """Appends the documents whose id is not there yet; of new ones with one id the first by (priority, content)."""
    new = first_by(rows, ["doc_id"], [c for c in ("priority", "source_type", "content") if c in rows.columns]).drop("priority")
    if existing is not None:
        new = new.join(existing.select("doc_id"), "doc_id", "left_anti")
    new.write.mode("append").partitionBy("source_type").parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict JSON lines, gzip by suffix: a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """Rows of an append-only journal, and whether its last line was torn. A malformed line elsewhere raises."""
    wide = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), "value").where("trim(value) <> ''")
    rows = lines.select("at", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = rows.where("r is null or r._bad is not null").agg(F.min("at"), F.max("at"), F.count(F.lit(1))).first()
    last = lines.agg(F.max("at")).first()[0]
    if bad[2] and (bad[2] > 1 or bad[0] != last):
        raise ValueError(f"journal {path}: malformed line before the end")
    return rows.where("r is not null and r._bad is null").select("r.*").drop("_bad"), bool(bad[2])


def read_results(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """Question rows of a results file, one JSON document; placed: with ordinal, a row's place in it."""
    rows = spark.read.schema(f"questions array<struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>>").option("multiLine", True).json(path).select(F.posexplode("questions").alias("ordinal", "q"))
    return rows.select("q.*", "ordinal") if placed else rows.select("q.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, question_id) of a file with an id a line; blank lines are skipped."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("ordinal"), F.trim("value").alias("question_id")).where("question_id <> ''")


def write_answers(answers: DataFrame, path: str) -> None:
    """Exactly the three columns of an answer, as JSON lines; the job's commit makes them visible at once."""
    answers.select("question_id", "answer", "document_ids").write.mode("overwrite").json(path)


def chosen_retrieval(checkpoint: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """(question_id, document_ids, provenance): the saved ranking if all rows have it, else the submitted ids if all have those, else those of answers.

    A repeated question in the checkpoint is an error.
    """
    if found := [r[0] for r in checkpoint.groupBy("question_id").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"repeated questions: {', '.join(found)}")
    full = lambda c: F.coalesce(F.min(F.col(c).isNotNull()), F.lit(False))
    saved, submitted = checkpoint.agg(full("retrieved_doc_ids"), full("document_ids")).first()
    for there, column, name in ((saved, "retrieved_doc_ids", "saved ranking"), (submitted, "document_ids", "submitted ids")):
        if there:
            return checkpoint.select("question_id", F.col(column).alias("document_ids"), F.lit(name).alias("provenance"))
    own = checkpoint.select("question_id", "document_ids").limit(0) if answers is None else answers.select("question_id", F.coalesce("document_ids", F.expr("cast(array() as array<string>)")).alias("document_ids"))
    return own.withColumn("provenance", F.lit("answers"))


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "question_id") -> DataFrame:
    """Rows of a JSON lines file by key, the last of each; a malformed line fails the read."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("at"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return lines.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> tuple[dict, DataFrame]:
    """A checkpoint's configuration, {} if it has none, and its rows: a JSON list whose first element may be the header."""
    rows = spark.read.schema(f"_config string, {schema}").option("multiLine", True).json(path)
    header = rows.where("_config is not null").select("_config").first()
    return json.loads(header[0]) if header else {}, rows.where("question_id is not null").drop("_config")


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of all files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def keep_identity(spark: SparkSession, path: str, identity: dict) -> None:
    """Writes the identity of a corpus or a run beside it at the first call; refuses another one later."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/identity")
    if at.getFileSystem(conf).exists(at):
        before = json.loads(spark.read.text(f"{path}/identity").first()[0])
        for k in sorted({*before, *identity}):
            if before.get(k) != identity.get(k):
                raise ValueError(f"cannot resume: {k} was {before.get(k)!r}, now {identity.get(k)!r}")
    else:
        spark.createDataFrame([(json.dumps(identity, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/identity")
