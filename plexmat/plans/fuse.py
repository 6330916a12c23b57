"""The whole pipeline: common variable features, imputation of each target, and one integrated table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.functions.scalar import correlation_sign
from plexmat.operators import neighbors
from plexmat.operators.features import find_common_variable, flagged
from plexmat.operators.impute import impute
from plexmat.operators.integrate import integrate
from plexmat.sources.modality import Modality
from plexmat.sources.shared import stored


@dataclass(frozen=True)
class Target:
    """A modality whose cells get the source's values, and what holds for it alone.

    valid_cells and valid_features name flags of its cells and features that it is cut to; layer is the layer of values to
    use. The numbers and points are those of impute(); None leaves them to the call's options.
    """

    modality: Modality
    correlation: str = "positive"
    label: str | None = None
    layer: str = ""
    valid_cells: str | None = None
    valid_features: str | None = None
    remove_version: bool | None = None
    k: int | None = None
    relaxation: float | None = None
    speed: int | None = None
    mutual_k: tuple[int, int] | None = None
    rescue_k: int | None = None
    ka: int | None = None
    points: DataFrame | None = None
    edges: DataFrame | None = None

    def ready(self, remove_version: bool = False) -> Target:
        """With its modality cut to what is valid, and feature ids without version if asked for."""
        m = self.modality.layer(self.layer)
        m = m.where(F.col(self.valid_cells) if self.valid_cells else None, F.col(self.valid_features) if self.valid_features else None)
        remove = remove_version if self.remove_version is None else self.remove_version
        return replace(self, modality=m.without_versions() if remove else m, layer="", valid_cells=None, valid_features=None, remove_version=False)

    def options(self) -> dict[str, Any]:
        own = {n: getattr(self, n) for n in ("k", "relaxation", "speed", "mutual_k", "rescue_k", "ka", "points", "edges")}
        return {"correlation": correlation_sign(self.correlation)} | {n: v for n, v in own.items() if v is not None}


def spread(value: Any, n: int) -> list:
    """One value for each of n targets: a list of n, or the same for all."""
    if not isinstance(value, list):
        return [value] * n
    if len(value) != n:
        raise ValueError(f"{len(value)} values for {n} targets")
    return list(value)


def targets_of(modalities: Modality | list[Modality], **parameters: Any) -> list[Target]:
    """Targets with parameters that are given as one value for all or as a list of one for each."""
    each = modalities if isinstance(modalities, list) else [modalities]
    if not all(isinstance(m, Modality) for m in each):
        raise ValueError("targets are modalities")
    columns = {name: spread(value, len(each)) for name, value in parameters.items()}
    return [Target(m, **{name: column[i] for name, column in columns.items()}) for i, m in enumerate(each)]


def perform_imputation(source: Modality, targets: list[Target], common: DataFrame, method: str = "knn", **options) -> list[Modality]:
    """Each target with the source's values. The source's scores are made once for all."""
    if any(t.edges is None or method != "knn" for t in targets):
        options["source_vectors"] = stored(neighbors.score_vectors(source.only_features(common)), "sources")
    return [impute(t.modality, source, common, method, **(options | t.options())) for t in targets]


@dataclass(frozen=True)
class Fused:
    """The integrated table; the source and the targets with their features' flag of what is common; the imputed modalities."""

    table: DataFrame
    source: Modality
    targets: list[Modality]
    imputed: list[Modality]
    common: DataFrame


def fuse_all(source: Modality | Target, targets: list[Target], *, feature_method: str = "kruskal", n_markers: int = 8000, percentile: float = 30, method: str = "knn", source_label: str | None = None, remove_versions: bool = False, common_attr: str = "common_variable", search: Callable = neighbors.top_k, **options) -> Fused:
    """Common variable features of a source and its targets, the targets' imputed values, and all in one table.

    Labels are used if all modalities have one. The common features are stored once, and all later steps read them.
    """
    own = (source if isinstance(source, Target) else Target(source, label=source_label)).ready(remove_versions)
    label = source_label or own.label
    targets = [t.ready(remove_versions) for t in targets]
    common = find_common_variable([*(t.modality for t in targets), own.modality], feature_method, n_markers, percentile)
    imputed = perform_imputation(own.modality, targets, common, method, search=search, **options)
    labels = [label, *(t.label for t in targets)]
    table = integrate(own.modality.only_features(common), [m.only_features(common) for m in imputed], labels if all(labels) else None)
    marked = [replace(m, features=flagged(m, common, common_attr)) for m in (own.modality, *(t.modality for t in targets))]
    return Fused(table, marked[0], marked[1:], imputed, common)


def fuse(source: Modality | Target, targets: list[Target], **options) -> DataFrame:
    """The integrated table of fuse_all()."""
    return fuse_all(source, targets, **options).table
