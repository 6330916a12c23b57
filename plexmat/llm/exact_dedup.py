"""Operator 2: exact deduplication by progressive refinement, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common

#: Characters of the text that the second refinement hashes.
PREFIX_CHARS = 64
#: Rows up to which narrow tables of ids are broadcast (under 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000
SPACE = r"[\x20\x09-\x0D]+"


def normalised(col: str = "text"):
    """The text (null: empty) with each run of white space as one space."""
    return F.regexp_replace(common.text_of(col), SPACE, " ")


def _decided(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_CHARS, broadcast_rows: int = BROADCAST_ROWS, digest_all: bool = False) -> DataFrame:
    """exact_dedup() with _x, the hash of the raw text, as a further column."""
    text, clean = common.text_of(text_col), normalised(text_col)
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_x"), clean.alias("_n"))
    digest = F.sha2("_n", 256)
    sketch = base.select("_id", "_x", F.length("_n").alias("_len"), F.xxhash64(F.substring("_n", 1, prefix)).alias("_p"), (digest if digest_all else F.lit(None).cast("string")).alias("_d"))
    sketch = common.stored(sketch.withColumn("_r", F.monotonically_increasing_id()), "sketch")
    by_prefix = sketch.groupBy("_len", "_p").agg(F.count(F.lit(1)).alias("_c"))
    by_len = by_prefix.groupBy("_len").agg(F.sum("_c").alias("_l")).where(F.col("_l") > 1).select(F.col("_len").alias("_len1"))
    live = by_prefix.where(F.col("_c") > 1).join(by_len, F.col("_len") == F.col("_len1"), "left_semi").select(F.col("_len").alias("_len2"), F.col("_p").alias("_p2"), F.lit(True).alias("_live"))
    live = common.small(common.stored(live, "live"), broadcast_rows)
    rows = sketch.join(live, (F.col("_len") == F.col("_len2")) & (F.col("_p") == F.col("_p2")), "left").select("_id", "_x", "_r", "_d", F.coalesce("_live", F.lit(False)).alias("_live"))
    if not digest_all:
        ids = rows.where("_live").select(F.col("_id").alias("_i"), F.col("_x").alias("_h")).distinct()
        ids = common.small(common.stored(ids, "survivors"), broadcast_rows)
        content = base.join(ids, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_x") == F.col("_h")), "left_semi").select(F.col("_id").alias("_i"), F.col("_x").alias("_h"), digest.alias("_own")).distinct()
        content = common.small(common.stored(content, "digests"), broadcast_rows)
        rows = rows.join(content, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_x") == F.col("_h")), "left").select("_id", "_x", "_r", F.col("_own").alias("_d"), "_live")
    groups = rows.where("_live").groupBy("_d").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_r").alias("r"))).alias("_k"), F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    # Named by an expression, the key is dealt anew for the join, on both sides, and a hot group's rows can be split.
    groups = groups.select(F.concat("_d", F.lit("")).alias("_g"), F.col("_k.i").alias("_keep"), F.col("_k.r").alias("_kr"), "_size").hint("merge")
    joined = rows.where("_live").join(groups, F.col("_d") == F.col("_g"), "left")
    alone = F.col("_size").isNull()
    out = joined.select(F.col("_id"), F.when(alone, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("_kr") == F.col("_r"), F.lit(True)).alias("kept"), F.col("_d").alias("digest"), "_x")
    rest = rows.where(~F.col("_live")).select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_d").alias("digest"), "_x")
    return out.unionByName(rest).withColumnRenamed("_id", id_col)


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows (id, keep_id, group_size, kept, digest), one per row of docs, for texts equal after normalised().

    1. length: a text whose normalised length no other has is settled;
    2. prefix: of the rest, a text whose (length, hash of the prefix) no other has is settled;
    3. content: only for the rest the full SHA-256 is taken and grouped (with digest_all it is asked for of every row,
       so the first reading takes it, but still only the survivors are grouped).
    The texts are read once for lengths and hashes, and again for the survivors' content. Only these are shuffled;
    counts are combined before the shuffle, so a group of a third of all rows costs one row per task. The members of a large group meet its summary in a sort-merge join whose
    partitions adaptive execution can split. Survivors' ids reach stage 3 by broadcast while they are at most
    broadcast_rows rows, by a shuffled join beyond.

    Null text counts as empty. keep_id is the smallest id of a group; null ids come last, and a group of null ids
    alone has keep_id null. Of rows that repeat an id and a text, one is kept. Long texts are hashed whole. An empty
    table gives an empty result. Ids may be of any type that has an order; other columns, whatever their names, are ignored.
    """
    return _decided(docs, id_col=id_col, text_col=text_col, **options).drop("_x")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    Null and empty texts are equal; of rows that repeat an id and a text one stays; an empty table gives an empty result.
    """
    found = _decided(docs, id_col=id_col, text_col=text_col, **options).where(F.col("group_size") > 1)
    return common.keep_rows(docs, found.select(F.col(id_col).alias("_i"), "_x", F.col("kept").alias("_k")), id_col, text_col, BROADCAST_ROWS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(common.table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256 AS s, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g ON s = text_sha256
"""
