"""Principal components of a modality's cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexmat.operators.neighbors import AT_ONCE, Cells, value_vectors
from plexmat.sources.modality import Modality
from plexmat.sources.shared import stored

#: Features up to which their covariance (8 bytes a pair) is summed and solved on the driver; of more, a subspace is iterated.
MOST_FEATURES = 2048
#: Directions that the subspace has beside those asked for.
SPARE = 10


def _added(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray], height: int) -> np.ndarray:
    """The sum over all cells of part(matrix of cells), height by any number of columns: by task, then row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            cells = Cells.of(b, "cell_id")
            for i in range(0, len(cells.ids), AT_ONCE):
                own = part(cells.rows(i, i + AT_ONCE))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"_r": pa.array(np.arange(height), pa.int32()), "_v": pa.array([x.tobytes() for x in total], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, v in zip(b.column("_r").to_pylist(), b.column("_v").to_pylist()):
                held[r] = held.get(r, 0.0) + np.frombuffer(v)
        yield pa.RecordBatch.from_pydict({"_r": pa.array(list(held), pa.int32()), "_v": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    got = sorted(rows.mapInArrow(run, "_r int, _v binary").repartition("_r").mapInArrow(add, "_r int, _v binary").collect(), key=lambda r: r._r)
    return np.stack([np.frombuffer(r._v) for r in got])


def pca(m: Modality, n: int = 50, drop_first: bool = False, scale: str | None = None, unit_rms: bool = False, most_features: int = MOST_FEATURES, passes: int = 8, seed: int = 23) -> DataFrame:
    """(cell_id, vec) of each cell's first n components; with drop_first, without the first of n + 1.

    Up to most_features the covariance is summed and solved. With more, a seeded random subspace of n + SPARE directions is
    multiplied by the covariance in `passes` passes over the cells, and solved inside: only features by directions come
    to the driver. With unit_rms the components are divided by their root mean square. The sign of a component is that
    of its largest loading.
    """
    m = m.scaled(scale) if scale else m
    take = n + int(drop_first)
    n_cells, width = m.cells.count(), m.features.count()
    if n_cells < take or width < take:
        raise ValueError(f"{take} components of {n_cells} cells and {width} features")
    rows = stored(value_vectors(m), "cells")
    absent = n_cells - rows.count()  # cells of a sparse modality without any value are all zero
    ones = lambda x: np.concatenate((x, np.ones((len(x), 1))), axis=1)
    if width <= most_features:
        full = _added(rows, width, lambda x: ones(x).T @ ones(x), width + 1)
        c = full[width, width] + absent
        mean = full[width, :width] / c
        cov = (full[:width, :width] - c * np.outer(mean, mean)) / max(c - 1, 1)
        value, vector = np.linalg.eigh((cov + cov.T) / 2)
    else:
        sums = _added(rows, width, lambda x: ones(x).sum(axis=0, keepdims=True), 1)[0]
        c = sums[width] + absent
        mean = sums[:width] / c
        base = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(take + SPARE, width))))[0]
        for _ in range(passes):
            part = (lambda q: lambda x: (x - mean).T @ ((x - mean) @ q))(base)
            image = (_added(rows, width, part, width) + absent * np.outer(mean, mean @ base)) / max(c - 1, 1)
            last, base = base, np.linalg.qr(image)[0]
        inner = last.T @ image
        value, small = np.linalg.eigh((inner + inner.T) / 2)
        vector = last @ small
    first = np.argsort(-value)[:take]
    load, value = vector[:, first], np.maximum(value[first], 0)
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(take)])
    load, kept = load[:, int(drop_first) :], value[int(drop_first) :]
    size = float(np.sqrt(kept.sum() * (c - 1) / (c * len(kept)))) if unit_rms else 1.0
    shared = rows.sparkSession.sparkContext.broadcast((load / size, mean @ load / size))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, at = shared.value
        for b in batches:
            cells = Cells.of(b, "cell_id")
            for i in range(0, len(cells.ids), AT_ONCE):
                out = cells.rows(i, i + AT_ONCE) @ w - at
                yield pa.RecordBatch.from_pydict({"cell_id": pa.array(cells.ids[i : i + AT_ONCE]), "vec": pa.array(list(out), pa.list_(pa.float64()))})

    got = rows.mapInArrow(project, "cell_id long, vec array<double>")
    if not absent:
        return got
    rest = m.cells.select(m.cells["cell_id"].cast("long").alias("cell_id")).join(rows.select("cell_id"), "cell_id", "left_anti")
    return got.unionByName(rest.withColumn("vec", F.array(*map(F.lit, (-(mean @ load) / size).tolist()))))
