"""What the operators share: reading tables, shared storage, bounded sampling and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.sources.shared import Scratch, shared_dir, small, small_batches, stored  # noqa: F401  used by the operators as common.*

#: Bytes of text that one kernel call works on; a single longer text is worked on alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_anew(col: str) -> Column:
    """The whole number itself, by an expression that the optimizer keeps: a join on it deals its rows anew, so that hot keys can be split."""
    return F.col(col).bitwiseXOR(F.lit(0))


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from all columns of docs."""
    used, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """The rows of docs without those that verdicts (_i, _x = xxhash64 of the text, _k = kept) drop.

    Rows without a verdict stay. Of rows that repeat an id and a text and have a verdict, one stays at most. Only
    ids and hashes are joined; the verdicts are broadcast up to `most` rows. The columns of docs may have any names.
    """
    i, x, k, m, tx = free_names(docs, "_i", "_x", "_k", "_m", "_tx")
    state = verdicts.groupBy(F.col("_i").alias(i), F.col("_x").alias(x)).agg(F.max("_k").alias(k), F.count(F.lit(1)).alias(m)).where(~F.col(k) | (F.col(m) > 1))
    state = small(stored(state, "verdicts"), most)
    hashed = docs.withColumn(tx, F.xxhash64(text_of(text_col)))
    match = F.col(id_col).eqNullSafe(F.col(i)) & (F.col(tx) == F.col(x))
    stay = hashed.join(state, match, "left_anti")
    if state.where(k).limit(1).count():
        stay = stay.unionByName(hashed.join(state.where(k), match, "left_semi").dropDuplicates([id_col, tx]))
    return stay.drop(tx)


def text_of(col: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_of(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; -1 where the id is null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, tuple[int, int]]:
    """A stored table (_k, _y, _t) of whole distinct texts of at most per_class training rows of either class, and how many
    training rows each class has in all.

    The rows are picked by a hash _k of their id from the narrow label table (a top-k, so at most 2 * per_class ids
    reach the driver and the broadcast); only their texts are read after that, and these stay in Spark. A row
    without label, id or document is not picked; of rows that repeat an id the larger label and the smaller text
    count, of equal texts the one of the smallest _k.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    lab = labels.select(F.col(id_col).cast(kind).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & train)
    present = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull())
    lab = stored(lab.groupBy("_id").agg(F.max("_y").alias("_y")).join(present, "_id", "left_semi").withColumn("_k", F.md5(F.col("_id").cast("string").cast("binary"))), "labelled")
    shares = dict(lab.groupBy("_y").count().collect())
    rows = [tuple(r) for y in sorted(shares) for r in lab.where(F.col("_y") == y).orderBy("_k").limit(per_class).collect()]
    picked = spark.createDataFrame(rows, lab.schema)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(F.broadcast(picked), "_id").groupBy("_id", "_y", "_k").agg(F.min("_t").alias("_t"))
    texts = texts.groupBy(F.sha2("_t", 256).alias("_d")).agg(F.min(F.struct("_k", "_y", "_t")).alias("_r")).select("_r.*")
    return stored(texts, "sample"), (shares.get(0, 0), shares.get(1, 0))


def slices(batch: pa.RecordBatch, col: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


def map_text(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, col: str = "_t") -> DataFrame:
    """mapInArrow of a function from a slice of rows to the columns of schema."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, col):
                out = fn(part)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)
