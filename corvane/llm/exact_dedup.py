"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text, freed of white space, is cut into fixed-size blocks. The distinct blocks are sorted and named by their
place. Then adjacent names are paired, and the distinct pairs are sorted and named in turn, until each document
has one name. Two documents have the same name at the same level exactly if their texts are equal: names stand
for contents, never for hashes.

Scale: texts are read twice and shuffled once, as distinct blocks after map-side combining. A block meets its
name by a 64-bit hash; where a hash stands for two different blocks, those are named by their contents in a pass
of their own. A document with n blocks takes part in log2(n) further levels of two integers a pair.

Defined results: a null text counts as empty; empty and white-space-only texts are equal; a null doc_id sorts
after others and its row stays a row; equal rows are separate members of their group; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Shelf, loosened, numbered, read, spare

BLOCK = 2048
#: Blocks of a piece, in which places are found from its start.
GRAIN = 16


def normalised(text):
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def _named(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct values of by, with name: their place in the sorted partitions."""
    return df.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _places(length: Column, block: int) -> Column:
    """0 to the number of blocks of so many characters, exclusive; no characters are one empty block."""
    return F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(length / block).cast("int")) - 1)


def _pieces(norm: str, length: Column, size: int) -> Column:
    """norm in pieces of size characters. A place in a string is found from its start, so a long one is cut in one pass of a pattern."""
    return F.when(length <= size, F.array(norm)).otherwise(F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}+"), F.lit(0)))


def _blocks(docs: DataFrame, text: str, block: int) -> DataFrame:
    """docs with __norm, the normalised text, and __blocks: it in pieces of block characters."""
    out = docs.withColumn("__norm", normalised(F.col(text))).withColumn("__n", F.length("__norm"))
    few = F.transform(_places(F.col("__n"), block), lambda i: F.substring(F.col("__norm"), i * block + 1, F.lit(block)))
    return out.withColumn("__blocks", F.when(F.col("__n") <= GRAIN * block, few).otherwise(_pieces("__norm", F.col("__n"), block))).drop("__n")


def _block_rows(docs: DataFrame, text: str, block: int) -> DataFrame:
    """(__rid, __n, i, block): a row for each block of __blocks, and their number."""
    out = docs.withColumn("__norm", normalised(F.col(text))).select("__rid", F.length("__norm").alias("__chars"), "__norm")
    # outer, so that Spark does not evaluate the pieces once more to leave out rows without any
    out = out.select("__rid", "__chars", F.posexplode_outer(_pieces("__norm", F.col("__chars"), GRAIN * block)).alias("p", "piece"))
    out = out.select("__rid", "__chars", "p", "piece", F.explode_outer(_places(F.length("piece"), block)).alias("j"))
    return out.select("__rid", F.size(_places(F.col("__chars"), block)).alias("__n"), (F.col("p") * GRAIN + F.col("j")).alias("i"), F.substring("piece", F.col("j") * block + 1, F.lit(block)).alias("block"))


def name_texts(shelf: Shelf, docs: DataFrame, text: str = "text", block: int = BLOCK, digest=lambda blk: F.xxhash64(blk), also: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(facts, names): columns also of docs and __norm, the normalised text, by __rid, and level and name by __rid, which are equal exactly for equal normalised texts.

    docs needs a unique column __rid. digest: the hash by which blocks meet their names; any function will do,
    a weak one only makes the pass over colliding blocks larger.
    """
    facts = _blocks(docs, text, block).select("__rid", *also, F.transform("__blocks", digest).alias("__h"))
    facts = shelf.keep(facts, "facts")
    rows = facts.select("__rid", F.size("__h").alias("__n"), F.posexplode("__h").alias("i", "h"))
    # level 0: distinct blocks, sorted into names. One row for a hash; first and last tell whether it stands for one block.
    blocks = _block_rows(docs.select("__rid", text), text, block).withColumn("h", digest(F.col("block")))
    first = blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).sortWithinPartitions("lo", "h")
    first = first.select("h", F.monotonically_increasing_id().alias("name"), (F.col("lo") != F.col("hi")).alias("shared"))
    first = shelf.keep(first, "names-0")
    if first.where("shared").isEmpty():
        level = rows.join(first.select("h", "name"), "h").select("__rid", "__n", "i", "name")
    else:
        clear = rows.join(first.where("not shared").select("h", "name"), "h").select("__rid", "__n", "i", "name")
        mixed = blocks.join(loosened(first.where("shared").select("h"), "h"), "h", "left_semi")
        exact = shelf.keep(_named(mixed, ["block"]).withColumn("name", -1 - F.col("name")), "names-0-exact")
        level = clear.union(mixed.join(loosened(exact, "block"), "block").select("__rid", "__n", "i", "name"))
    level, done, turn = shelf.keep(level, "level-0"), [], 0
    left = level.agg(F.max("__n")).first()[0] or 1
    while True:
        done.append(level.where("__n = 1").select("__rid", F.lit(turn).alias("level"), "name"))
        if left == 1:
            break
        # an adjacent pair meets in one row; the last of an odd number pairs with -1 - level, which names nothing
        pair = level.where("__n > 1").groupBy("__rid", "__n", F.shiftright("i", 1).alias("j")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("r"))
        pair = shelf.keep(pair.select("__rid", ((F.col("__n") + 1) / 2).cast("int").alias("__n"), F.col("j").alias("i"), "l", F.col("r").isNull().alias("odd"), F.coalesce("r", F.lit(0)).alias("r")), f"pairs-{turn}")
        names = shelf.keep(_named(pair, ["l", "odd", "r"]), f"names-{turn + 1}")
        turn, left = turn + 1, (left + 1) // 2
        level = shelf.keep(pair.join(names, ["l", "odd", "r"]).select("__rid", "__n", "i", "name"), f"level-{turn}")
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return facts.drop("__h"), out


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK, digest=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Of equal texts the one with the most code points stays, then the one with the smallest doc_id; among rows
    equal in both, one.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "exact-dedup")
    own = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "__rid")
    also = F.col("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.sha2("__norm", 256).alias("text_sha256")
    facts, names = name_texts(shelf, own, "text", block, digest or (lambda blk: F.xxhash64(blk)), also)
    rows = shelf.keep(facts.join(names, "__rid"), "rows")
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c"), F.col("__rid").alias("d"))
    groups = rows.groupBy("level", "name").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    out = rows.join(loosened(groups, "level", "name"), ["level", "name"])
    return out.select("doc_id", F.col("best.c").alias("keep_id"), "group_size", (F.col("__rid") == F.col("best.d")).alias("kept"), "text_sha256", "n_chars")


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    spark = docs.sparkSession
    shelf, rid = Shelf(spark, "exact-dedup"), spare(docs, "__rid")
    own = numbered(docs, rid)
    slim = own.select(F.col(rid).alias("__rid"), F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    facts, names = name_texts(shelf, slim, "text", block, also=(F.col("__id"), F.length(F.coalesce("text", F.lit(""))).alias("__chars")))
    rows = shelf.keep(facts.join(names, "__rid"), "rows")
    best = F.struct((-F.col("__chars")).alias("a"), F.col("__id").isNull().alias("b"), F.col("__id").alias("c"), F.col("__rid").alias("d"))
    stay = rows.groupBy("level", "name").agg(F.min(best).alias("best")).select(F.col("best.d").alias(rid))
    return own.join(stay, rid, "left_semi").select(docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents", ["doc_id", "text"])).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS k, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, s AS text_sha256 FROM r
"""
