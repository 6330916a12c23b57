"""Running moments of a stream of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and population deviation for each key so far; the state is one row for each key. For complete or update mode."""
    return stream.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("n"))
