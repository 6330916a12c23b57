"""Scalar functions: ids, rounding, natural order, run times, and constant tables."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def strip_version(col: Column) -> Column:
    """The id up to its first dot."""
    return F.regexp_replace(col, r"\..*$", "")


def round_unit(x: Column, units: int = 10, method: str = "ceil") -> Column:
    """The multiple of units above ('ceil'), below ('floor') or nearest to x; a tie goes down, but what lies in (0, units) goes up."""
    low, high = F.floor(x / units) * units, F.ceil(x / units) * units
    if method == "ceil":
        return high
    if method == "floor":
        return low
    if method == "nearest":
        return F.when((low == 0) | (high - x < x - low), high).otherwise(low)
    raise ValueError(f"no such rounding: {method}")


def round_unit_value(x: float, units: int = 10, method: str = "ceil") -> int:
    """round_unit() of one number."""
    low, high = math.floor(x / units) * units, math.ceil(x / units) * units
    if method not in ("ceil", "floor", "nearest"):
        raise ValueError(f"no such rounding: {method}")
    return high if method == "ceil" or (method == "nearest" and (low == 0 or high - x < x - low)) else low


def natural_key(col: Column) -> Column:
    """A string that sorts case-insensitively with runs of digits by their number, of any length: each run comes after a mark that sorts before all text, with its length before it."""
    parts = F.regexp_extract_all(F.lower(col), F.lit("([0-9]+|[^0-9]+)"), 1)
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("\u0001"), F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)), "")


def natural_sort(items: list[str]) -> list[str]:
    """A list in natural order."""
    return sorted(items, key=lambda s: [(0, int(p), "") if re.fullmatch("[0-9]+", p) else (1, 0, p.lower()) for p in re.split("([0-9]+)", s)])


def run_time(start: float, end: float) -> tuple[float, str]:
    """A duration in the largest unit of which it has more than one."""
    seconds = end - start
    for unit, name in ((86400, "days"), (3600, "hours"), (60, "minutes")):
        if seconds > unit:
            return seconds / unit, name
    return seconds, "seconds"


def run_times(seconds: Column) -> Column:
    """run_time() of a column of durations: a struct of value and unit."""
    out = F.struct(seconds.cast("double").alias("value"), F.lit("seconds").alias("unit"))
    for unit, name in ((60, "minutes"), (3600, "hours"), (86400, "days")):
        out = F.when(seconds > unit, F.struct((seconds / unit).alias("value"), F.lit(name).alias("unit"))).otherwise(out)
    return out


def correlation_sign(word: str) -> int:
    """1 or -1 from 'positive', 'pos', '+', 'negative', 'neg', '-'."""
    if word.lower() in ("positive", "pos", "+"):
        return 1
    if word.lower() in ("negative", "neg", "-"):
        return -1
    raise ValueError(f"no such correlation: {word}")


def nan_matrix(spark: SparkSession, n_cells: int, n_features: int) -> DataFrame:
    """(cell_id, feat_id, value) of a matrix without any known value: NaN everywhere, cells and features numbered from 0."""
    if n_cells < 0 or n_features < 0:
        raise ValueError("a matrix has no negative size")
    i = F.col("id")
    return spark.range(n_cells * n_features).select(F.floor(i / n_features).alias("cell_id"), (i % n_features).alias("feat_id"), F.lit(float("nan")).alias("value"))


def percentage(n: Column, total: Column) -> Column:
    return F.try_divide(n * 100.0, total)


# Lengths of the mouse chromosomes (assembly mm10).
MOUSE_CHROMOSOMES = {
    "1": 195471971, "2": 182113224, "3": 160039680, "4": 156508116, "5": 151834684, "6": 149736546, "7": 145441459, "8": 129401213, "9": 124595110, "10": 130694993,
    "11": 122082543, "12": 120129022, "13": 120421639, "14": 124902244, "15": 104043685, "16": 98207768, "17": 94987271, "18": 90702639, "19": 61431566, "X": 171031299, "Y": 91744698,
}


def mouse_chromosomes(spark: SparkSession, prefix: bool = False, include_y: bool = False) -> DataFrame:
    rows = [("chr" * prefix + k, v) for k, v in MOUSE_CHROMOSOMES.items() if include_y or k != "Y"]
    return spark.createDataFrame(rows, "chrom string, length long")
