"""Imputation: neighbours' values as sparse products W . X."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.operators import neighbors
from plexmat.sources.modality import Modality
from plexmat.sources.shared import stored

#: Added to a row's number of neighbours in the divisor.
KNN_OFFSET, MARKOV_OFFSET = 1e-7, 1e-5


def knn_weights(edges: DataFrame, offset: float = KNN_OFFSET) -> DataFrame:
    """Neighbours with equal weights: 1 / (k + offset)."""
    return neighbors.normalised(edges.select("target_id", "source_id", F.lit(1.0).alias("weight")), offset)


def apply_weights(weights: DataFrame, values: DataFrame) -> DataFrame:
    """(cell_id, feat_id, value) of W . X: sums are combined before the shuffle by (target, feature)."""
    x = values.select(F.col("cell_id").alias("source_id"), "feat_id", "value")
    return weights.join(x, "source_id").groupBy(F.col("target_id").alias("cell_id"), "feat_id").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def chain(first: DataFrame, second: DataFrame) -> DataFrame:
    """(target_id, source_id, weight) of the product of two weight tables."""
    b = second.select(F.col("target_id").alias("_m"), F.col("source_id").alias("_s"), F.col("weight").alias("_w"))
    return first.join(b, F.col("source_id") == F.col("_m")).groupBy("target_id", F.col("_s").alias("source_id")).agg(F.sum(F.col("weight") * F.col("_w")).alias("weight"))


def impute(target: Modality, source: Modality, common: DataFrame, method: str = "knn", *, correlation: int = 1, k: int = 20, relaxation: float = 10, speed: int = 10, seed: int = 23, mutual_k: tuple[int, int] | None = None, rescue_k: int | None = None, ka: int = 5, epsilon: float = 1.0, points: DataFrame | None = None, keep_direct: bool = False, edges: DataFrame | None = None, source_vectors: DataFrame | None = None, search: Callable = neighbors.top_k) -> Modality:
    """The source's values for the target's cells, of the features that both have, from neighbours by the common features.

    method 'knn': capped nearest neighbours; 'mnn_direct': mutual neighbours, cells without any are left out; 'mnn_rescue': all
    cells, by the nearest cells with mutual neighbours in points (cell_id, vec; by default the common features' values).
    With keep_direct, cells with mutual neighbours keep their direct mean. Both modalities must have the same ones of the
    common features. edges are stored neighbours to use the first k of instead of a search; source_vectors the
    source's score_vectors() over the common features, if they are at hand. The features' and cells' flags `imputed` mark
    what has values; of a sparse source absent values are zero.
    """
    t, s = target.only_features(common), source.only_features(common)
    if edges is None or method != "knn":
        neighbors.check_features(t.features, s.features)
    sv = lambda: source_vectors if source_vectors is not None else stored(neighbors.score_vectors(s), "sources")
    tv = lambda: stored(neighbors.score_vectors(t, correlation), "targets")
    if method == "knn":
        found = neighbors.first_k(edges, k) if edges is not None else neighbors.capped_top_k(tv(), sv(), k, relaxation, speed, seed, search)
        w = knn_weights(found)
    elif method in ("mnn_direct", "mnn_rescue"):
        n_t, n_s = target.cells.count(), source.cells.count()
        kt, ks = mutual_k or (neighbors.auto_k(n_t, 0.01, 200), neighbors.auto_k(n_s, 0.01, 200))
        w = direct = stored(knn_weights(neighbors.mutual_top_k(tv(), sv(), kt, ks, search), MARKOV_OFFSET), "direct")
        if method == "mnn_rescue":
            points = stored(neighbors.value_vectors(t), "points") if points is None else points
            anchors = points.join(direct.select(F.col("target_id").alias("cell_id")).distinct(), "cell_id", "left_semi")
            rk = rescue_k or neighbors.auto_k(n_t, 0.001, 50)
            w = chain(neighbors.rescue_weights(points, anchors, rk, neighbors.check_ka(rk, ka), epsilon, MARKOV_OFFSET), direct)
            if keep_direct:
                w = direct.unionByName(w.join(direct.select("target_id").distinct(), "target_id", "left_anti"))
            w = stored(w, "weights")
    else:
        raise ValueError(f"no such method: {method}")
    shared = source.features.join(target.features.select("feat_id"), "feat_id", "left_semi")
    values = apply_weights(w, source.values.join(shared.select("feat_id"), "feat_id", "left_semi"))
    cells = target.cells.join(w.select(F.col("target_id").alias("cell_id")).distinct().withColumn("imputed", F.lit(1)), "cell_id", "left").withColumn("imputed", F.coalesce("imputed", F.lit(0)))
    return Modality(target.name, cells, shared.withColumn("imputed", F.lit(1)), values, source.sparse)
