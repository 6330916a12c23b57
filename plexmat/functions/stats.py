"""Moments and the Kruskal-Wallis test over long tables (cell_id, feat_id, value)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.sources.shared import small, stored

#: Clusters up to which their sizes are broadcast.
CLUSTERS = 100_000
_KEY = {0: "cell_id", 1: "feat_id"}


def moments(values: DataFrame, axis: int | None) -> DataFrame:
    """Mean and population deviation for each cell (axis 0), each feature (1), or over all values (None) of a table without absent values."""
    if axis not in (0, 1, None):
        raise ValueError(f"no such axis: {axis}")
    stats = [F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n")]
    return values.agg(*stats) if axis is None else values.groupBy(_KEY[axis]).agg(*stats)


def sparse_moments(values: DataFrame, axis: int | None, cells: DataFrame, features: DataFrame) -> DataFrame:
    """moments() where values that are absent are zero: of every cell (axis 0) or feature (1), or of the whole matrix (None).

    The deviation of the values that are there is merged with that of the zeros, so large means lose no digits.
    """
    if axis not in (0, 1, None):
        raise ValueError(f"no such axis: {axis}")
    ids, other = (cells.select("cell_id"), features) if axis == 0 else (features.select("feat_id"), cells)
    stats = [F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("value").alias("k")]
    total = other.count() * (features.count() if axis is None else 1)
    found = values.agg(*stats) if axis is None else ids.join(values.groupBy(_KEY[axis]).agg(*stats), _KEY[axis], "left")
    n, k, m = F.lit(float(total)), F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0))
    mean = F.try_divide(k * m, n)
    var = F.try_divide(k * F.coalesce("v", F.lit(0.0)) + k * m * m * (n - k) / F.nullif(n, F.lit(0.0)), n)
    return found.select(*([] if axis is None else [_KEY[axis]]), mean.alias("mean"), F.sqrt(var).alias("std"), F.lit(total).cast("long").alias("n"))


def sparse_feature_moments(values: DataFrame, features: DataFrame, n_cells: int) -> DataFrame:
    """Mean and population deviation of each feature of n_cells cells where values that are absent are zero."""
    cells = features.sparkSession.range(n_cells).withColumnRenamed("id", "cell_id")
    return sparse_moments(values, 1, cells, features).drop("n")


def _ranked(values: DataFrame, clusters: DataFrame) -> DataFrame:
    """(feat_id, cluster, value, c, t, r): how often each value of a feature is in a cluster and in all, and its average rank.

    Equal values of a feature and cluster are counted before anything is shuffled or ranked, so that repeated values cost one row.
    """
    c = values.join(clusters.select("cell_id", "cluster"), "cell_id").groupBy("feat_id", "value", "cluster").agg(F.count(F.lit(1)).cast("double").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("feat_id").orderBy("value"))
    c = c.select("*", F.sum("c").over(Window.partitionBy("feat_id", "value")).alias("t"), upto.alias("u"))
    return c.select("feat_id", "cluster", "value", "c", "t", (F.col("u") - (F.col("t") - 1) / 2).alias("r"))


def kruskal(values: DataFrame, clusters: DataFrame, n_groups: int | None = None) -> DataFrame:
    """(feat_id, h, pval, n_groups) of values, with clusters (cell_id, cluster); a feature of equal values has h 0 and p 1.

    Every cell has a value of every feature here; see kruskal_sparse() for tables without zeros. With n_groups, a feature that
    lacks values of one of so many clusters counts as one of equal values.
    """
    ranked = _ranked(values, clusters)
    groups = ranked.groupBy("feat_id", "cluster").agg(F.sum(F.col("c") * F.col("r")).alias("rs"), F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("t") * F.col("t") - 1)).alias("ties"))
    return _from_groups(groups, n_groups)


def kruskal_sparse(values: DataFrame, clusters: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """kruskal() of values that are zero where absent: only the others are ranked.

    Of a feature with `low` values below zero, the z zeros share the rank low + (z + 1) / 2, and positive values rank z higher
    than among the values that aren't zero.
    """
    sizes = stored(clusters.groupBy(F.col("cluster").alias("_g")).agg(F.count(F.lit(1)).cast("double").alias("size")), "clusters")
    n, g = sizes.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.count(F.lit(1))).first()
    ranked = _ranked(values.where(F.col("value") != 0), clusters)
    found = ranked.groupBy("feat_id", "cluster").agg(
        F.sum(F.col("c") * F.col("r")).alias("rs"), F.sum("c").alias("nnz"), F.sum(F.when(F.col("value") > 0, F.col("c")).otherwise(0.0)).alias("pos"), F.sum(F.col("c") * (F.col("t") * F.col("t") - 1)).alias("ties")
    )
    feature = Window.partitionBy("feat_id")
    found = found.join(small(sizes, CLUSTERS), F.col("cluster") == F.col("_g")).withColumn("z", n - F.sum("nnz").over(feature)).withColumn("low", F.sum(F.col("nnz") - F.col("pos")).over(feature))
    middle = F.col("low") + (F.col("z") + 1) / 2
    rs = F.col("rs") + F.col("pos") * F.col("z") + (F.col("size") - F.col("nnz")) * middle
    # A cluster without a value other than zero has the rank sum size * middle, so it needs no row.
    each = found.groupBy("feat_id").agg(F.sum(rs * rs / F.col("size")).alias("s"), F.sum("ties").alias("ties"), F.sum("size").alias("size"), F.first(middle).alias("middle"), F.first("z").alias("z"))
    z = F.col("z")
    each = each.select("feat_id", (F.col("s") + (n - F.col("size")) * F.col("middle") * F.col("middle")).alias("s"), F.lit(n).alias("n"), (F.col("ties") + z * z * z - z).alias("ties"), F.lit(g).alias("g"))
    ids = (values if features is None else features).select("feat_id").distinct()
    return ids.join(_tested(each, None), "feat_id", "left").select("feat_id", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("pval", F.lit(1.0)).alias("pval"), F.coalesce("n_groups", F.lit(g).cast("int")).alias("n_groups"))


def _from_groups(groups: DataFrame, n_groups: int | None) -> DataFrame:
    return _tested(groups.groupBy("feat_id").agg(F.sum(F.col("rs") * F.col("rs") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("g")), n_groups)


def _tested(g: DataFrame, n_groups: int | None) -> DataFrame:
    """(feat_id, h, pval, n_groups) from each feature's sum s of squared rank sums over cluster sizes, values n, ties, and clusters g."""
    n = F.col("n")
    t = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    h = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), F.when(t > 1e-12, t))
    if n_groups is not None:
        h = F.when(F.col("g") == n_groups, h)
    out = g.select("feat_id", h.alias("h"), F.col("g").cast("int").alias("n_groups"))
    return out.select("feat_id", F.coalesce("h", F.lit(0.0)).alias("h"), F.when(F.col("h").isNull(), F.lit(1.0)).otherwise(chi2_sf(F.col("h"), F.col("n_groups") - 1)).alias("pval"), "n_groups")


def chi2_survival(x: float, df: int) -> float:
    """P(chi-squared with df degrees of freedom > x), by the closed sums for even and odd df."""
    if df < 1 or x is None or x != x:
        return float("nan")
    h = max(x, 0.0) / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df - 1) // 2 + 1):
        total += math.exp(-h) * term
        term *= h / (i + 0.5)
    return total


def chi2_sf(x: Column, df: Column) -> Column:
    """chi2_survival() of columns, a batch at a time: one row for each feature, so it is never the hot path."""

    @F.pandas_udf("double")
    def survival(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([chi2_survival(a, int(b)) if a == a else float("nan") for a, b in zip(x, df)], dtype="float64")

    return survival(x, df)


def require_groups(clusters: DataFrame) -> None:
    if clusters.select("cluster").distinct().limit(2).count() < 2:
        raise ValueError("a test across clusters needs two clusters at least")
