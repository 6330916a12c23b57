import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexmat.functions import rank, scalar, stats


def test_round_unit(spark):
    want = {0: 0, 1: 10, 14: 10, 15: 10, 16: 20, 25: 20}
    df = spark.createDataFrame([(x,) for x in want], "x int")
    assert {r.x: r.y for r in df.select("x", scalar.round_unit(F.col("x"), 10, "nearest").alias("y")).collect()} == want
    assert {x: scalar.round_unit_value(x, 10, "nearest") for x in want} == want
    with pytest.raises(ValueError):
        scalar.round_unit_value(3, 10, "up")


def test_natural_order(spark):
    long = "a" + "9" * 30
    items = ["a10", "A2", "a1", "b", "a2b3", "a2b12", long, "a1" + "0" * 30, "5a", " 5", "a" + "0" * 25 + "3"]
    want = ["5a", " 5", "a1", "A2", "a2b3", "a2b12", "a" + "0" * 25 + "3", "a10", long, "a1" + "0" * 30, "b"]
    assert scalar.natural_sort(items) == want
    df = spark.createDataFrame([(x,) for x in items], "s string")
    assert [r.s for r in df.orderBy(scalar.natural_key(F.col("s"))).collect()] == want


def test_small_things(spark):
    assert scalar.run_time(0, 59) == (59, "seconds") and scalar.run_time(0, 7200) == (2, "hours") and scalar.run_time(0, 60) == (60, "seconds")
    times = spark.createDataFrame([(x,) for x in (0, 59, 60, 61, 7200, 86400, 172800)], "s long").select("s", scalar.run_times(F.col("s")).alias("t"))
    assert all((r.t.value, r.t.unit) == scalar.run_time(0, r.s) for r in times.collect())
    assert scalar.correlation_sign("NEG") == -1 and scalar.correlation_sign("+") == 1
    with pytest.raises(ValueError):
        scalar.correlation_sign("?")
    assert scalar.mouse_chromosomes(spark).count() == 20
    with pytest.raises(ValueError):
        stats.moments(spark.range(1), 2)


def test_positions(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "x int").repartition(5)
    assert [(r.x, r.pos) for r in rank.positions(df, [F.col("x")]).orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]


def test_nan_matrix(spark):
    got = [(r.cell_id, r.feat_id) for r in scalar.nan_matrix(spark, 2, 3).where(F.isnan("value")).orderBy("cell_id", "feat_id").collect()]
    assert got == [(i, j) for i in range(2) for j in range(3)] and scalar.nan_matrix(spark, 0, 3).count() == 0
    with pytest.raises(ValueError):
        scalar.nan_matrix(spark, -1, 3)


def test_chi2():
    assert abs(stats.chi2_survival(16.918977604620448, 9) - 0.05) < 1e-9
    assert abs(stats.chi2_survival(9.487729036781154, 4) - 0.05) < 1e-9
    assert stats.chi2_survival(0.0, 1) == 1.0


def _kruskal(values: np.ndarray, groups: np.ndarray) -> float:
    r = pd.Series(values).rank().to_numpy()
    n = len(r)
    t = np.unique(values, return_counts=True)[1]
    c = 1 - (t**3 - t).sum() / (n**3 - n)
    s = sum(r[groups == g].sum() ** 2 / (groups == g).sum() for g in set(groups))
    return (12 / (n * (n + 1)) * s - 3 * (n + 1)) / c if c > 0 else 0.0


def test_kruskal_dense_and_sparse(spark):
    rng = np.random.default_rng(1)
    m = rng.poisson(0.7, (40, 6)).astype(float)
    m[:, 5] = 3.0
    g = rng.integers(0, 4, 40)
    clusters = spark.createDataFrame([(i, int(x)) for i, x in enumerate(g)], "cell_id int, cluster int")
    rows = [(i, j, float(m[i, j])) for i in range(40) for j in range(6)]
    dense = spark.createDataFrame(rows, "cell_id int, feat_id int, value double")
    sparse = dense.where("value <> 0")
    want = [_kruskal(m[:, j], g) for j in range(6)]
    for got in (stats.kruskal(dense, clusters), stats.kruskal_sparse(sparse, clusters), stats.kruskal_sparse(dense, clusters)):
        rows = {r.feat_id: r for r in got.collect()}
        assert all(math.isclose(rows[j].h, want[j], abs_tol=1e-9) for j in range(6))
        assert rows[5].h == 0 and rows[5].pval == 1
    with pytest.raises(ValueError):
        stats.require_groups(clusters.where("cluster = 1"))


def test_constant_cell_has_no_zscore(spark):
    v = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, 5.0)], "cell_id int, feat_id int, value double")
    z = {(r.cell_id, r.feat_id): r.z for r in rank.rank_zscores(v).collect()}
    assert z[1, 0] is None and z[2, 0] < 0 < z[2, 1]
