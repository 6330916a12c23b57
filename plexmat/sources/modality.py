"""A modality: one matrix of cells by features with tables of its cells and features."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from plexmat.functions import rank, stats
from plexmat.functions.scalar import strip_version
from plexmat.sources.shared import stored


@dataclass(frozen=True)
class Modality:
    """cells (cell_id, ...), features (feat_id, ...) and values (cell_id, feat_id, value), with further layers of values by name.

    In a sparse modality values that are absent are zero; in any other each cell has a value of each feature. Operators
    return new modalities; nothing is changed in place.
    """

    name: str
    cells: DataFrame
    features: DataFrame
    values: DataFrame
    sparse: bool = False
    layers: Mapping[str, DataFrame] = field(default_factory=dict)

    def layer(self, name: str = "") -> Modality:
        """The modality with the values of a layer; the base layer is ''."""
        if name and name not in self.layers:
            raise ValueError(f"{self.name} has no layer {name}")
        return replace(self, values=self.layers[name]) if name else self

    def with_layer(self, name: str, values: DataFrame) -> Modality:
        if not name:
            raise ValueError("the base layer has no name")
        return replace(self, layers={**self.layers, name: values})

    def _each(self, f: Callable[[DataFrame], DataFrame]) -> dict:
        return {"values": f(self.values), "layers": {k: f(v) for k, v in self.layers.items()}}

    def where(self, cells: Column | None = None, features: Column | None = None, inverse: bool = False) -> Modality:
        """The part of valid cells and features: selection by flags, or by their complement."""
        c = self.cells if cells is None else self.cells.where(~_flag(cells) if inverse else _flag(cells))
        f = self.features if features is None else self.features.where(~_flag(features) if inverse else _flag(features))

        def part(v: DataFrame) -> DataFrame:
            v = v if cells is None else v.join(c.select("cell_id"), "cell_id", "left_semi")
            return v if features is None else v.join(f.select("feat_id"), "feat_id", "left_semi")

        return replace(self, cells=c, features=f, **self._each(part))

    def only_features(self, ids: DataFrame) -> Modality:
        """The part of the features (feat_id) given."""
        keep = ids.select("feat_id").distinct()
        return replace(self, features=self.features.join(keep, "feat_id", "left_semi"), **self._each(lambda v: v.join(keep, "feat_id", "left_semi")))

    def without_versions(self) -> Modality:
        """Feature ids without version; an id that two features then share is an error."""
        f = self.features.withColumn("raw_feat_id", F.col("feat_id")).withColumn("feat_id", strip_version(F.col("feat_id")))
        if f.groupBy("feat_id").count().where("count > 1").limit(1).count():
            raise ValueError(f"{self.name}: feature ids are not unique without their versions")
        return replace(self, features=f, **self._each(lambda v: v.withColumn("feat_id", strip_version(F.col("feat_id")))))

    def scaled(self, attr: str) -> Modality:
        """Values divided by a number of their cell."""
        by = self.cells.select("cell_id", F.col(attr).cast("double").alias("_s"))
        return replace(self, **self._each(lambda v: v.join(by, "cell_id").select("cell_id", "feat_id", F.try_divide("value", "_s").alias("value"))))

    def moments(self, axis: int | None) -> DataFrame:
        """Mean, population deviation and number of values for each cell (axis 0), each feature (1), or over all (None)."""
        return stats.sparse_moments(self.values, axis, self.cells, self.features) if self.sparse else stats.moments(self.values, axis)

    def zscores(self, sign: int = 1) -> DataFrame:
        """(cell_id, feat_id, z), of a sparse modality the values that aren't zero and (.., zero) the z-score of the others."""
        return rank.sparse_rank_zscores(self.values, self.features.count(), sign) if self.sparse else rank.rank_zscores(self.values, sign)

    def dense(self) -> DataFrame:
        """values with the zeros that are absent: a row for each cell and feature."""
        grid = self.cells.select("cell_id").crossJoin(self.features.select("feat_id"))
        return grid.join(self.values, ["cell_id", "feat_id"], "left").select("cell_id", "feat_id", F.coalesce("value", F.lit(0.0)).alias("value"))

    def write(self, path: str, mode: str = "errorifexists", empty_base: bool = False) -> None:
        """Create the modality's Parquet tables under a path, or append its cells to them (mode 'append').

        Values are parted by modality and layer, so that a reader of one layer reads no other. What is appended must have the
        features and layers that are there, and no value outside its cells and features. With empty_base the base layer
        is all zeros, that is without rows.
        """
        spark = self.values.sparkSession
        base = self.values.limit(0) if empty_base else self.values
        every = [v.withColumn("layer", F.lit(k)) for k, v in {"": base, **self.layers}.items()]
        values = functools.reduce(DataFrame.unionByName, every)
        for ids, key in ((self.cells, "cell_id"), (self.features, "feat_id")):
            if values.join(ids.select(key), key, "left_anti").limit(1).count():
                raise ValueError(f"{self.name}: values outside the modality's {key}s")
        there = stored_layers(spark, path, self.name) if mode == "append" else None
        if there is not None:
            if there != layer_list(list(self.layers)):
                raise ValueError(f"{self.name} has the layers {there}")
            same_ids(self.features, read(spark, path, self.name).features, "feat_id")
        named = [("cells", self.cells, []), ("values", values.withColumn("layer", F.concat(F.lit("layer:"), "layer")), ["layer"])]
        if there is None:
            marks = spark.createDataFrame([(k,) for k in layer_list(list(self.layers))], "layer string")
            named += [("features", self.features, []), ("layers", marks, [])]
        for part, table, by in named:
            table.withColumn("modality", F.lit(self.name)).write.mode(mode).partitionBy("modality", *by).parquet(f"{path}/{part}")


def layer_list(layers: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """Names of layers, each once, with the base layer '' first."""
    if layers is None:
        return [""]
    if not isinstance(layers, (str, list, tuple)) or not all(isinstance(x, str) for x in layers):
        raise ValueError("layers are a name or a list of names")
    return ["", *sorted({layers} - {""} if isinstance(layers, str) else {*layers} - {""})]


def stored_layers(spark: SparkSession, path: str, name: str) -> list[str] | None:
    """The layers of a stored modality; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layers/modality={name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return layer_list([r.layer for r in spark.read.parquet(f"{path}/layers").where(F.col("modality") == name).select("layer").distinct().collect()])


def same_ids(a: DataFrame, b: DataFrame, key: str) -> None:
    """Both tables must have the same ids: one pass over both."""
    both = a.select(key, F.lit(1).alias("_s")).unionByName(b.select(key, F.lit(-1).alias("_s")))
    if both.groupBy(key).agg(F.sum("_s").alias("_s")).where("_s <> 0").limit(1).count():
        raise ValueError(f"the modalities' {key}s differ")


def _flag(c: Column) -> Column:
    """Any number but zero is true; null is not."""
    return F.coalesce(c.cast("double") != 0, F.lit(False))


def read(spark: SparkSession, path: str, name: str, layers: str | list[str] | None = None, sparse: bool = False) -> Modality:
    """A stored modality with the base layer and those named; other layers are not read."""
    wanted = layer_list(layers)
    if lost := {*wanted} - {*(stored_layers(spark, path, name) or [])}:
        raise ValueError(f"{name} has no layer {', '.join(sorted(lost))}")
    cells, features, values = (spark.read.parquet(f"{path}/{p}").where(F.col("modality") == name).drop("modality") for p in ("cells", "features", "values"))
    by = {k: values.where(F.col("layer") == f"layer:{k}").drop("layer") for k in wanted}
    return Modality(name, cells, features, by.pop(""), sparse, by)


def expand(values: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """(row, col, value) of a part of a matrix, in the places that its rows and columns have in the whole one.

    rows and cols are (pos, full): the place in the part and in the whole; without them places stay. The size of an axis
    must be given with its places, and a place outside it is an error.
    """
    for axis, index, n in (("row", rows, n_rows), ("col", cols, n_cols)):
        if index is not None and n is None:
            raise ValueError(f"the number of {axis}s is needed")
        if index is not None:
            inside = F.when((F.col("_full") < 0) | (F.col("_full") >= n), F.raise_error(F.lit(f"a {axis} lies outside the matrix"))).otherwise(F.col("_full"))
            values = values.join(index.select(F.col("pos").alias("_pos"), F.col("full").cast("long").alias("_full")), F.col(axis) == F.col("_pos")).withColumn(axis, inside).drop("_pos", "_full")
    return values.select("row", "col", "value")


def melt(wide: DataFrame, id_col: str, columns: list[str] | None = None, name: str = "feat_id", value: str = "value") -> DataFrame:
    """(id, name, value) from one column for each feature."""
    return wide.unpivot([id_col], columns or [c for c in wide.columns if c != id_col], name, value)


def reindexed(part: DataFrame, cells: DataFrame) -> DataFrame:
    """part (cell_id, numbers or arrays of numbers) with a row for each of the cells: zeros for those that it hasn't."""
    full = cells.select("cell_id").join(part, "cell_id", "left")
    for f in part.schema.fields:
        if isinstance(f.dataType, ArrayType):
            width = part.agg(F.max(F.size(f.name))).first()[0] or 0
            full = full.withColumn(f.name, F.coalesce(f.name, F.array_repeat(F.lit(0).cast(f.dataType.elementType), width)))
        elif f.name != "cell_id":
            full = full.withColumn(f.name, F.coalesce(f.name, F.lit(0).cast(f.dataType)))
    return full


def from_vectors(df: DataFrame, name: str, cell: str, vector: str, cluster: str | None = None) -> Modality:
    """A dense modality from one vector a cell; features are the positions."""
    values = df.select(F.col(cell).alias("cell_id"), F.posexplode(vector).alias("feat_id", "value")).select("cell_id", F.col("feat_id").cast("long"), F.col("value").cast("double"))
    cells = df.select(F.col(cell).alias("cell_id"), *([F.col(cluster).alias("cluster")] if cluster else []))
    return Modality(name, cells, values.select("feat_id").distinct(), values)


def from_facts(facts: DataFrame, name: str, cell: Column, feature: Column, value: Column, keep: bool = False) -> Modality:
    """A sparse modality that sums facts by cell and feature; with keep, sums are stored, so that they are made once."""
    values = facts.groupBy(cell.alias("cell_id"), feature.alias("feat_id")).agg(F.sum(value).cast("double").alias("value"))
    values = stored(values, "values") if keep else values
    return Modality(name, values.select("cell_id").distinct(), values.select("feat_id").distinct(), values, sparse=True)
