"""Ranks, places and z-scores over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.sources.shared import stored


def average_rank(group: list[str], value: str) -> Column:
    """The rank of value in its group, ties sharing their mean rank."""
    ordered = Window.partitionBy(*group).orderBy(value)
    ties = Window.partitionBy(*group, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2


def percent_rank(group: list[str], value: str) -> Column:
    """Average rank over the number of values."""
    return average_rank(group, value) / F.count(F.lit(1)).over(Window.partitionBy(*group))


def rank_zscores(values: DataFrame, sign: int = 1) -> DataFrame:
    """(cell_id, feat_id, z): per cell, percent ranks of the features' values as z-scores (sample deviation), times sign.

    z . z' is (n - 1) times Spearman's correlation. A cell of equal values has z null.
    """
    cell = Window.partitionBy("cell_id")
    ranked = values.select("cell_id", "feat_id", percent_rank(["cell_id"], "value").alias("p"))
    z = (F.col("p") - F.avg("p").over(cell)) / F.nullif(F.stddev_samp("p").over(cell), F.lit(0.0))
    return ranked.select("cell_id", "feat_id", (z * sign).alias("z"))


def sparse_rank_zscores(values: DataFrame, n_features: int, sign: int = 1) -> DataFrame:
    """(cell_id, feat_id, z, zero): rank_zscores() of the values that aren't zero, and the z-score that a cell's zeros share.

    A cell has n_features values, of which those that aren't in the table are zero. Negative values rank first, then the zeros,
    which share one rank, then the positive values; the ranks' mean is that of 1 to n_features. Zeros need no row. A
    cell without a value other than zero has no row, and as one of equal values no z-score either.
    """
    cell = Window.partitionBy("cell_id")
    own = values.where(F.col("value") != 0).select("cell_id", "feat_id", "value", average_rank(["cell_id"], "value").alias("r"), F.sum((F.col("value") < 0).cast("long")).over(cell).alias("low"), (F.lit(n_features) - F.count(F.lit(1)).over(cell)).alias("nought"))
    mean = (n_features + 1) / (2.0 * n_features)
    p = (F.col("r") + F.when(F.col("value") > 0, F.col("nought")).otherwise(0)) / n_features
    p0 = (F.col("low") + (F.col("nought") + 1) / 2) / n_features
    own = own.select("cell_id", "feat_id", "nought", (p - mean).alias("d"), (p0 - mean).alias("d0"))
    deviation = F.nullif(F.sqrt((F.sum(F.col("d") * F.col("d")).over(cell) + F.col("nought") * F.col("d0") * F.col("d0")) / max(n_features - 1, 1)), F.lit(0.0))
    return own.select("cell_id", "feat_id", (F.col("d") / deviation * sign).alias("z"), (F.col("d0") / deviation * sign).alias("zero"))


def positions(df: DataFrame, keys: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's place (from 1) in the order of the keys, without one task that has all rows.

    The rows are dealt by ranges of the keys and stored; a row's place is the number of rows in the ranges before (as many
    sums as ranges) and its place in its own range.
    """
    part, own, before = (f"_{name}_{x}" for x in ("range", "own", "before"))
    dealt = stored(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.select(F.col(part).alias("_part"), (F.sum("_n").over(Window.orderBy(part)) - F.col("_n")).alias(before))
    inner = dealt.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    return inner.join(F.broadcast(upto), F.col(part) == F.col("_part")).withColumn(name, F.col(own) + F.col(before)).drop(part, own, before, "_part")
