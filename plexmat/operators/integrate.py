"""One table of observed and imputed values with their provenance."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.sources.modality import Modality


def integrate(source: Modality, imputed: list[Modality], labels: list[str] | None = None) -> DataFrame:
    """(cell_id, feat_id, value, original_file, modality) of the source's values and each target's imputed ones for the source's
    features. labels, of the source first, give `modality`; without them the column is left out."""
    if labels is not None and len(labels) != 1 + len(imputed):
        raise ValueError("a label for each modality is needed")
    ids = source.features.select("feat_id")
    parts = []
    for i, m in enumerate([source, *imputed]):
        v = m.values.join(ids, "feat_id", "left_semi").select("cell_id", "feat_id", "value", F.lit(m.name).alias("original_file"))
        parts.append(v.withColumn("modality", F.lit(labels[i])) if labels else v)
    return functools.reduce(DataFrame.unionByName, parts)
