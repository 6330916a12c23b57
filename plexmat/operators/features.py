"""Selection of variable features."""

from __future__ import annotations

import functools
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexmat.functions import stats
from plexmat.sources.modality import Modality
from plexmat.sources.shared import stored

BINS = 10
#: The share by which a number must be above another to count as more; the order of a sum's terms moves it by less.
EQUAL = 1e-12


def kruskal_features(m: Modality) -> DataFrame:
    """(feat_id, h, pval) of every feature of m across its cells' clusters; untested ones have h 0 and p 1."""
    stats.require_groups(m.cells)
    clusters = m.cells.select("cell_id", "cluster")
    found = stats.kruskal_sparse(m.values, clusters, m.features) if m.sparse else stats.kruskal(m.values, clusters)
    return m.features.select("feat_id").join(found, "feat_id", "left").select("feat_id", F.coalesce("h", F.lit(0.0)).alias("h"), F.coalesce("pval", F.lit(1.0)).alias("pval"))


def _above(x: Column, edge: Column) -> Column:
    """x > edge, for sums whose last digits depend on the order of their terms: equal ones are not above each other."""
    return x - edge > EQUAL * F.greatest(F.abs(x), F.abs(edge))


def decile_features(m: Modality, measure: str = "vmr", percentile: float = 30) -> DataFrame:
    """(feat_id, mean, spread, decile, variable): of each decile of the means but the highest, the top `percentile` by spread.

    Deciles have interpolated quantiles of the means as edges; equal edges are an error. Features of the same values get the
    same flag, also at an edge: what is above it by less than a share of EQUAL is not. The tables here have one row for each
    feature; their quantiles are one array, which is joined as a single row.
    """
    if measure not in ("vmr", "sd", "std"):
        raise ValueError(f"no such measure: {measure}")
    s = m.moments(1)
    spread = (F.col("std") * F.col("std") + 1) / (F.col("mean") + 1) if measure == "vmr" else F.col("std")
    s = stored(s.select("feat_id", "mean", spread.alias("spread")), "spread")
    edges = s.agg(F.percentile("mean", F.array(*(F.lit(i / BINS) for i in range(BINS + 1)))).alias("edges"))
    inner = F.slice("edges", 2, BINS - 1)
    checked = F.when(F.size(F.array_distinct("edges")) < BINS + 1, F.raise_error(F.lit("the deciles of the means are not distinct"))).otherwise(F.size(F.filter(inner, lambda e: _above(F.col("mean"), e))))
    binned = s.join(F.broadcast(edges)).select("feat_id", "mean", "spread", checked.alias("decile"))
    cut = binned.groupBy("decile").agg(F.percentile("spread", F.lit(1 - percentile / 100)).alias("cut"))
    return binned.join(F.broadcast(cut), "decile").select("feat_id", "mean", "spread", "decile", (_above(F.col("spread"), F.col("cut")) & (F.col("decile") < BINS - 1)).cast("int").alias("variable"))


def top_features(scores: DataFrame, n: int) -> DataFrame:
    """The n features of the highest h; ties go to the smaller id."""
    return scores.orderBy(F.col("h").desc(), "feat_id").limit(n).select("feat_id")


def common_features(winners: list[DataFrame]) -> DataFrame:
    """Features that are among all winners; none is an error."""
    if isinstance(winners, DataFrame):
        raise ValueError("a list of modalities is needed")
    out = stored(functools.reduce(DataFrame.intersect, [w.select("feat_id") for w in winners]), "common")
    if out.limit(1).count() == 0:
        raise RuntimeError("no feature is variable in all modalities")
    return out


def find_common_variable(modalities: list[Modality], method: str = "kruskal", n_markers: int = 8000, percentile: float = 30) -> DataFrame:
    """(feat_id) of the features that are variable in every modality, by 'kruskal', 'vmr' or 'sd'."""
    if method == "kruskal":
        least = min(m.features.count() for m in modalities)
        if n_markers > least:
            warnings.warn(f"there are only {least} features", stacklevel=2)
        return common_features([top_features(kruskal_features(m), min(n_markers, least)) for m in modalities])
    if method in ("vmr", "sd"):
        return common_features([decile_features(m, method, percentile).where("variable = 1") for m in modalities])
    raise ValueError(f"no such method: {method}")


def flagged(m: Modality, common: DataFrame, attr: str = "common_variable") -> DataFrame:
    """m's features with a flag for those in common."""
    mark = common.select("feat_id").withColumn(attr, F.lit(1))
    return m.features.join(mark, "feat_id", "left").withColumn(attr, F.coalesce(attr, F.lit(0)))
