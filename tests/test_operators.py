import hashlib
import weakref
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexmat.functions import stats
from plexmat.operators import decompose, features, impute, integrate, neighbors
from plexmat.plans import fuse
from plexmat.sources import modality
from plexmat.sources.modality import Modality
from plexmat.sources.shared import stored


def make(spark, m, name="m", cluster=None, ids=None):
    n, k = m.shape
    ids = range(n) if ids is None else ids
    df = spark.createDataFrame([(int(i), [float(x) for x in r], int(cluster[j]) if cluster is not None else 0) for j, (i, r) in enumerate(zip(ids, m))], "id long, v array<double>, c int")
    return modality.from_vectors(df, name, "id", "v", "c")


def knn(t, s, k, sign=1):
    z = lambda m: (lambda r: (r - r.mean(1, keepdims=True)) / r.std(1, ddof=1, keepdims=True))(pd.DataFrame(m).rank(axis=1, pct=True).to_numpy())
    return np.argsort(-np.round(sign * z(t) @ z(s).T, 9), axis=1, kind="stable")[:, :k]


def lists(df):
    out = {}
    for r in df.orderBy("target_id", "rn").collect():
        out.setdefault(r.target_id, []).append(r.source_id)
    return out


def test_knn_exact_in_both_forms(spark):
    rng = np.random.default_rng(0)
    t, s = rng.integers(0, 6, (30, 12)), rng.integers(0, 6, (37, 12))
    a, b = make(spark, t), make(spark, s)
    want = dict(enumerate(knn(t, s, 5).tolist()))
    assert lists(neighbors.spearman_knn(a.values, b.values, 5)) == want
    va, vb = neighbors.vectors(neighbors.rank_zscores(a.values)), neighbors.vectors(neighbors.rank_zscores(b.values))
    assert lists(neighbors.top_k(va, vb, 5, broadcast_bytes=0, block=10)) == want
    assert lists(neighbors.spearman_knn(a.values, b.values, 5, -1)) == dict(enumerate(knn(t, s, 5, -1).tolist()))
    assert neighbors.top_k(va, vb, 99).where("target_id = 0").count() == 37
    assert lists(neighbors.bucketed_top_k(va, vb, 5, lists=4, probes=4)) == want
    assert {len(x) for x in lists(neighbors.bucketed_top_k(va, vb, 20, lists=6, probes=1)).values()} == {20}
    with pytest.raises(ValueError):
        neighbors.top_k(va, vb, 5, "other")
    with pytest.raises(Exception, match="values"):
        neighbors.top_k(va, neighbors.vectors(make(spark, s[:, :5]).values, "value"), 5).collect()
    assert neighbors.top_k(va, vb.limit(0), 5).count() == neighbors.top_k(va.limit(0), vb, 5).count() == 0


def cells_of(rng, n, width, share):
    """Sparse Cells with a base of their own each, and their matrix."""
    m = rng.random((n, width)) < share
    base, idx = rng.normal(size=n), np.nonzero(m)[1]
    flat = rng.normal(size=len(idx))
    full = np.repeat(base[:, None], width, axis=1)
    full[m] = flat
    return neighbors.Cells(np.arange(n), flat, width, np.concatenate(([0], m.sum(1).cumsum())), idx, base), full


def test_wide_sparse_cells_are_not_made_dense(monkeypatch):
    rng = np.random.default_rng(3)
    dense, rows = [], neighbors.Cells.rows
    monkeypatch.setattr(neighbors.Cells, "rows", lambda *x: dense.append(out := rows(*x)) or out)
    (t, a), (s, b) = (cells_of(rng, n, 40_000, 0.001) for n in (200, 30))
    for metric, want in {"dot": -a @ b.T, "euclidean": (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, "hamming": np.stack([(b != x).sum(1) for x in a])}.items():
        dense.clear()
        got = neighbors._best(metric, 3)(t, s)
        assert got.column("source_id").to_pylist() == np.argsort(want, axis=1, kind="stable")[:, :3].ravel().tolist()
        assert metric == "hamming" or not dense
        assert max((x.nbytes for x in dense), default=0) <= neighbors.DENSE_BYTES


def test_wide_sparse_candidates_are_not_made_dense(monkeypatch):
    """The 5 * 10 candidates that an imputation asks for once the cap is passed."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(neighbors.Cells, "rows", lambda *x: pytest.fail("dense rows"))
    (t, a), (s, b) = (cells_of(rng, n, 30_000, 0.001) for n in (40, 120))
    got = neighbors._best("dot", 50)(t, s)
    assert got.column("source_id").to_pylist() == np.argsort(-a @ b.T, axis=1, kind="stable")[:, :50].ravel().tolist()


def test_sparse_kernel_in_parts(monkeypatch):
    rng = np.random.default_rng(4)
    for share in (0.0, 0.02, 0.9):
        (t, a), (s, b) = (cells_of(rng, n, 300, share) for n in (20, 25))
        for products, size in ((7, 5000), (1 << 20, 32 << 20)):
            monkeypatch.setattr(neighbors, "PRODUCTS", products)
            monkeypatch.setattr(neighbors, "DENSE_BYTES", size)
            for metric in ("dot", "euclidean", "angular", "manhattan"):
                assert np.allclose(neighbors._block_scores(metric, t, 2, 19, s, 3, 25), neighbors._scores(metric, a[2:19], b[3:25]), atol=1e-6)


def test_blocks_of_bounded_bytes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (sparse(spark, rng.integers(1, 4, (n, 9)) * (rng.random((n, 9)) < 0.5)) for n in (31, 29))
    va, vb = (stored(neighbors.score_vectors(x), "test") for x in (a, b))
    want = lists(neighbors.top_k(va, vb, 4))
    sizes = []
    monkeypatch.setattr(neighbors, "TASK_BYTES", 400)
    monkeypatch.setattr(neighbors, "stored", lambda df, what: sizes.append(stored(df, what)) or sizes[-1])
    assert lists(neighbors.top_k(va, vb, 4, broadcast_bytes=0)) == want
    assert all(r._blocks > 1 and r._slices > 1 for r in sizes[0].collect())


def test_sources_are_read_batch_by_batch(monkeypatch):
    """A pair of blocks holds its targets and one batch of sources at a time; pairs may share a batch, and dense cells meet sparse ones."""
    rng = np.random.default_rng(7)
    (t, a), (s, b) = (cells_of(rng, n, 60, 0.1) for n in (50, 700))

    def batch(c, lo, hi, block, side, dense=False):
        part = [np.split(x, c.off[1:-1])[lo:hi] for x in (c.idx.astype(np.int32), c.flat)]
        cols = {"cell_id": c.ids[lo:hi], "idx": None if dense else part[0], "vec": [*c.rows(lo, hi)] if dense else part[1], "base": None if dense else c.base[lo:hi], "width": None if dense else [60] * (hi - lo)}
        kinds = {"cell_id": pa.int64(), "idx": pa.list_(pa.int32()), "vec": pa.list_(pa.float64()), "base": pa.float64(), "width": pa.int32()}
        return pa.table({"_list": [0] * (hi - lo), "_block": [block] * (hi - lo), "_slice": [0] * (hi - lo), "_side": [side] * (hi - lo)} | {k: pa.nulls(hi - lo, kinds[k]) if v is None else pa.array(v, kinds[k]) for k, v in cols.items()})

    for dense in (False, True):
        live, most = [], []
        of = neighbors.Cells.of

        def counted(*x):
            live.append(weakref.ref(out := of(*x)))
            most.append(sum(len(c.ids) for r in live if (c := r()) is not None))
            return out

        pairs = [pa.concat_tables([batch(t, 0, 20, i, 0, dense), batch(t, 20, 50, i, 0, dense), *(batch(s, x, x + 50, i, 1) for x in range(350 * i, 350 * i + 350, 50))]) for i in (0, 1)]
        with monkeypatch.context() as m:
            m.setattr(neighbors.Cells, "of", counted)
            got = pa.Table.from_batches(neighbors._streamed("dot", 4)(b for b in pa.concat_tables(pairs).combine_chunks().to_batches(max_chunksize=30)))
        assert max(most) <= 50 + 30 + 30
        want = np.stack([np.argsort(np.round(-a @ b[350 * i : 350 * i + 350].T, 9), axis=1, kind="stable")[:, :4] + 350 * i for i in (0, 1)])
        assert got["source_id"].to_pylist() == want.ravel().tolist() and got["target_id"].to_pylist() == np.tile(np.repeat(np.arange(50), 4), 2).tolist()


def test_metrics(spark):
    rng = np.random.default_rng(1)
    t, s = rng.integers(0, 3, (11, 6)).astype(float), rng.integers(0, 3, (13, 6)).astype(float)
    s[0] = 0
    a, b = neighbors.value_vectors(make(spark, t)), neighbors.value_vectors(make(spark, s))
    norm = lambda m: np.linalg.norm(m, axis=-1)
    size = norm(t)[:, None] * norm(s)
    d = {"euclidean": norm(t[:, None] - s), "manhattan": np.abs(t[:, None] - s).sum(2), "hamming": (t[:, None] != s).sum(2), "angular": np.sqrt(np.maximum(2 - 2 * np.divide(t @ s.T, size, out=np.zeros_like(size), where=size > 0), 0)), "dot": -t @ s.T}
    for metric, want in d.items():
        assert lists(neighbors.top_k(a, b, 4, metric)) == dict(enumerate(np.argsort(np.round(want, 9), axis=1, kind="stable")[:, :4].tolist()))


def test_bucketed_search_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    s, t = (centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16)) for n in (1500, 200))
    a, b = make(spark, t), make(spark, s)
    exact, near = (lists(neighbors.spearman_knn(a, b, 10, search=f)) for f in (neighbors.top_k, neighbors.bucketed_top_k))
    assert sum(len({*exact[i]} & {*near[i]}) for i in exact) >= 0.9 * 10 * len(exact)


def sparse(spark, m, name="m", cluster=None):
    """The modality of a matrix whose zeros are absent."""
    full = make(spark, m, name, cluster)
    return replace(full, values=full.values.where("value <> 0"), sparse=True)


def test_sparse_is_dense_with_zeros(spark):
    rng = np.random.default_rng(4)
    for low in (0, -2):
        t, s = (rng.integers(low, 3, (n, 15)) * rng.integers(0, 2, (n, 15)) for n in (24, 30))
        t[0], s[0] = 0, 0
        t[1, :], t[1, 2] = 0, 5
        a, b = sparse(spark, t, "t"), sparse(spark, s, "s")
        want = dict(enumerate(knn(t[1:], s[1:], 5).tolist(), 1))
        assert lists(neighbors.spearman_knn(a, b, 5)) == {k: [x + 1 for x in v] for k, v in want.items()}
        assert lists(neighbors.top_k(neighbors.score_vectors(a), neighbors.score_vectors(b), 5, broadcast_bytes=0, block=7)) == {k: [x + 1 for x in v] for k, v in want.items()}
        c, d = make(spark, t, "t"), make(spark, s, "s")
        assert lists(neighbors.top_k(neighbors.value_vectors(a), neighbors.value_vectors(d), 3, "euclidean")) == {i: x for i, x in lists(neighbors.top_k(neighbors.value_vectors(c), neighbors.value_vectors(d), 3, "euclidean")).items() if i}
        for axis in (0, 1, None):
            key = [] if axis is None else [("cell_id", "feat_id")[axis]]
            x, y = (m.moments(axis).toPandas().sort_values(key or "mean").reset_index(drop=True) for m in (a, c))
            assert np.allclose(x[["mean", "std", "n"]], y[["mean", "std", "n"]])
        cluster = np.arange(24) % 4
        x, y = (features.kruskal_features(m).toPandas().sort_values("feat_id")["h"] for m in (sparse(spark, t, cluster=cluster), make(spark, t, cluster=cluster)))
        assert np.allclose(x, y)
        p, q = (np.array(decompose.pca(m, 4).toPandas().sort_values("cell_id")["vec"].tolist()) for m in (a, c))
        assert np.allclose(p @ p.T, q @ q.T)
        x, y = (impute.impute(u, v, v.features, k=4).values.toPandas().pivot(index="cell_id", columns="feat_id", values="value").fillna(0) for u, v in ((a.where(cells=F.col("cell_id")), b.where(cells=F.col("cell_id"))), (c.where(cells=F.col("cell_id")), d.where(cells=F.col("cell_id")))))
        assert np.allclose(x.reindex(columns=y.columns, fill_value=0), y)
    with pytest.raises(Exception, match="sparse"):
        neighbors.top_k(neighbors.vectors(a.values, "value"), neighbors.vectors(b.values, "value"), 2).collect()


def in_turn(dots, k, relaxation, speed, seed=23):
    """Neighbours when targets choose one after the other."""
    n_t, n_s = dots.shape
    cap, degree, out, left, turn = neighbors.saturation(n_t, n_s, k, relaxation), [0] * n_s, {}, list(range(n_t)), 0
    while left:
        open_ = [x for x in range(n_s) if degree[x] < cap]
        if len(open_) < k:
            return None
        wait = []
        for t in sorted(left, key=lambda t: (hashlib.md5(f"{t}:{seed}:{turn}".encode()).hexdigest(), t)):
            cand = sorted(open_, key=lambda x: (-dots[t, x], x))[: k * speed]
            free = [x for x in cand if degree[x] < cap][:k]
            if len(free) < k:
                wait.append(t)
                continue
            out[t] = free
            for x in free:
                degree[x] += 1
        if len(wait) == len(left):
            return None
        left, turn = wait, turn + 1
    return out


def test_capped_neighbours_are_those_of_turns(spark):
    rng = np.random.default_rng(12)
    passes = 0
    for n_t, n_s, k, relaxation, speed in ((40, 30, 4, 1.0, 3), (60, 25, 3, 1.02, 2), (30, 30, 2, 0.9, 8)):
        t, s = rng.normal(size=(n_t, 5)) + 2, rng.normal(size=(n_s, 5)) + 2
        a, b = (neighbors.value_vectors(make(spark, m)) for m in (t, s))
        want = in_turn(np.round(t @ s.T, 9), k, relaxation, speed)
        passes += want is not None
        if want is None:
            with pytest.raises(RuntimeError):
                neighbors.capped_top_k(a, b, k, relaxation, speed)
        else:
            assert lists(neighbors.capped_top_k(a, b, k, relaxation, speed)) == want
    assert passes


def test_constrained_knn(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 10))
    t = make(spark, base)
    s = make(spark, np.concatenate((base[:3] * 0.1 + base.mean(0), rng.normal(size=(27, 10)))))
    got = neighbors.constrained_knn(t.values, s.values, 4, relaxation=1.2)
    cap = neighbors.saturation(40, 30, 4, 1.2)
    assert got.count() == 160 and got.groupBy("source_id").count().agg(F.max("count")).first()[0] <= cap
    with pytest.raises(ValueError):
        neighbors.constrained_knn(t.values, s.values, 31)
    same = make(spark, np.tile(np.arange(5.0), (5, 1)))
    with pytest.raises(RuntimeError):
        neighbors.constrained_knn(same.values, make(spark, np.tile(np.arange(5.0), (3, 1))).values, 2, relaxation=1)


def test_impute_weight_and_integration(spark):
    rng = np.random.default_rng(5)
    t, s = make(spark, rng.normal(size=(8, 6)), "t"), make(spark, np.full((30, 6), 4.0) + rng.normal(size=(30, 6)) * 0, "s")
    s2 = make(spark, rng.normal(size=(30, 6)), "s")
    w = impute.knn_weights(neighbors.spearman_knn(t.values, s2.values, 20))
    v = impute.apply_weights(w, s.values).collect()
    assert all(abs(r.value - 4 * 20 / (20 + 1e-7)) < 1e-9 for r in v)
    out = integrate.integrate(s2, [impute.impute(t, s2, s2.features, k=20)], ["a", "b"])
    assert {(r.modality, r.original_file): r["count"] for r in out.groupBy("modality", "original_file").count().collect()} == {("a", "s"): 180, ("b", "t"): 48}
    assert "modality" not in integrate.integrate(s2, []).columns
    with pytest.raises(ValueError):
        integrate.integrate(s2, [], ["a", "b"])
    with pytest.raises(ValueError):
        impute.impute(t, s2, s2.features, "other")


def test_mutual_and_rescue(spark):
    rng = np.random.default_rng(7)
    t, s = make(spark, rng.normal(size=(25, 9)), "t"), make(spark, rng.normal(size=(20, 9)), "s")
    direct = impute.impute(t, s, s.features, "mnn_direct", mutual_k=(1, 1))
    rescue = impute.impute(t, s, s.features, "mnn_rescue", mutual_k=(1, 1), rescue_k=6, ka=2)
    n = direct.cells.where("imputed = 1").count()
    assert 0 < n < 25 and rescue.cells.where("imputed = 1").count() == 25
    kept = impute.impute(t, s, s.features, "mnn_rescue", mutual_k=(1, 1), rescue_k=6, ka=2, keep_direct=True)
    both = direct.values.join(kept.values.withColumnRenamed("value", "w"), ["cell_id", "feat_id"])
    assert both.where(F.abs(F.col("value") - F.col("w")) > 1e-12).count() == 0 and kept.cells.where("imputed = 1").count() == 25
    assert neighbors.auto_k(3000, 0.01, 200) == 30 and neighbors.auto_k(10**6, 0.01, 200) == 200
    assert neighbors.check_ka(10, 5) == 5 and neighbors.check_ka(4, 5) == 2
    with pytest.raises(ValueError):
        neighbors.check_ka(1, 5)


def test_stored_neighbours_and_shared_features(spark):
    rng = np.random.default_rng(8)
    t, s = make(spark, rng.normal(size=(9, 7)), "t"), make(spark, rng.normal(size=(20, 7)), "s")
    edges = neighbors.constrained_knn(t, s, 6)
    own = lambda m: m.values.orderBy("cell_id", "feat_id").toPandas()
    assert np.allclose(own(impute.impute(t, s, s.features, k=3, edges=edges)), own(impute.impute(t, s, s.features, k=3)))
    with pytest.raises(ValueError):
        impute.impute(t, s, s.features, k=7, edges=edges)
    part = t.only_features(t.features.where("feat_id > 2"))
    got = impute.impute(part, s, s.features.where("feat_id > 3"), k=3)
    assert {r.feat_id for r in got.values.select("feat_id").distinct().collect()} == {r.feat_id for r in got.features.collect()} == {3, 4, 5, 6}
    with pytest.raises(ValueError):
        impute.impute(part, s, s.features, k=3)
    w = neighbors.adjacency(edges)
    for axis, key, n in ((1, "target_id", 9), (0, "source_id", edges.select("source_id").distinct().count())):
        sums = neighbors.normalised(w, 1e-9, axis).groupBy(key).agg(F.sum("weight").alias("s")).collect()
        assert len(sums) == n and all(abs(r.s - 1) < 1e-6 for r in sums)
    assert neighbors.normalised(w, axis=None) is w
    with pytest.raises(ValueError):
        neighbors.normalised(w, axis=2)
    assert neighbors.adjacency(edges, 9).agg(F.sum("weight")).first()[0] == 54
    with pytest.raises(ValueError):
        neighbors.adjacency(edges, 10)


def test_targets_have_their_own_parameters(spark):
    rng = np.random.default_rng(13)
    cells = lambda n, name, **more: replace(make(spark, rng.normal(size=(n, 6)) + 3, name, np.arange(n) % 3), **more)
    s, a, b = cells(30, "s"), cells(9, "a"), cells(8, "b")
    b = replace(b, cells=b.cells.withColumn("ok", F.col("cell_id") % 2), features=b.features.withColumn("use", F.lit(1)))
    targets = fuse.targets_of([a, b], k=[2, 5], correlation=["+", "neg"], label=["x", "y"], valid_cells=[None, "ok"], valid_features=[None, "use"])
    got = fuse.fuse_all(s, targets, n_markers=6, source_label="s")
    assert {r.modality: r.n for r in got.table.groupBy("modality").agg(F.countDistinct("cell_id").alias("n")).collect()} == {"s": 30, "x": 9, "y": 4}
    alone = impute.impute(b.where(cells=F.col("ok")), s, s.features, correlation=-1, k=5).values.toPandas().sort_values(["cell_id", "feat_id"])
    assert np.allclose(alone, got.imputed[1].values.toPandas().sort_values(["cell_id", "feat_id"]))
    assert all(m.features.where("common_variable = 1").count() == 6 for m in (got.source, *got.targets))
    with pytest.raises(ValueError):
        fuse.targets_of([a, b], k=[1, 2, 3])
    with pytest.raises(ValueError):
        fuse.targets_of("a")
    v = Modality("v", b.cells, b.features.withColumn("feat_id", F.concat("feat_id", F.lit(".1"))), b.values.withColumn("feat_id", F.concat("feat_id", F.lit(".1"))))
    assert {r.feat_id for r in fuse.Target(v, remove_version=True).ready().modality.features.collect()} == set("012345")
    assert {r.feat_id for r in fuse.Target(v, remove_version=False).ready(True).modality.features.collect()} == {f"{i}.1" for i in range(6)}


def test_layers(spark, tmp_path):
    m = make(spark, np.arange(12.0).reshape(4, 3))
    m = m.with_layer("twice", m.values.withColumn("value", F.col("value") * 2))
    assert modality.layer_list("a") == modality.layer_list(["a", "", "a"]) == ["", "a"] and modality.layer_list(None) == [""]
    with pytest.raises(ValueError):
        modality.layer_list(3)
    with pytest.raises(ValueError):
        m.layer("other")
    path = str(tmp_path / "m")
    m.write(path)
    more = replace(make(spark, np.ones((2, 3)), ids=[8, 9]), name="m").with_layer("twice", m.values.limit(0))
    more.write(path, "append", empty_base=True)
    back = modality.read(spark, path, "m", "twice")
    assert back.cells.count() == 6 and back.features.count() == 3 and back.values.count() == 12
    assert back.layer("twice").values.agg(F.sum("value")).first()[0] == 132 and modality.read(spark, path, "m").layers == {}
    for wrong in (replace(more, layers={}), replace(more, features=more.features.limit(2), values=more.values.where("feat_id < 0")), replace(more, cells=more.cells.limit(1))):
        with pytest.raises(ValueError):
            wrong.write(path, "append")
    with pytest.raises(ValueError):
        modality.read(spark, path, "m", "none")


def test_reshaping(spark):
    v = spark.createDataFrame([(0, 1, 2.0), (1, 0, 3.0)], "row int, col int, value double")
    rows, cols = spark.createDataFrame([(0, 4), (1, 2)], "pos int, full int"), spark.createDataFrame([(0, 7), (1, 0)], "pos int, full int")
    assert sorted(map(tuple, modality.expand(v, rows, cols, 5, 8).collect())) == [(2, 7, 3.0), (4, 0, 2.0)]
    assert sorted(map(tuple, modality.expand(v, cols=cols, n_cols=8).collect())) == [(0, 0, 2.0), (1, 7, 3.0)]
    with pytest.raises(ValueError):
        modality.expand(v, rows, n_cols=3)
    with pytest.raises(Exception, match="outside"):
        modality.expand(v, rows, cols, 3, 8).collect()
    cells = spark.createDataFrame([(1,), (2,)], "cell_id int")
    part = spark.createDataFrame([(1, [1.0, 2.0], 5)], "cell_id int, vec array<double>, n int")
    assert sorted(map(tuple, modality.reindexed(part, cells).collect())) == [(1, [1.0, 2.0], 5), (2, [0.0, 0.0], 0)]
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "cell_id int, a double, b double")
    assert sorted(map(tuple, modality.melt(wide, "cell_id").collect())) == [(1, "a", 2.0), (1, "b", 3.0)]


def test_feature_selection(spark):
    rng = np.random.default_rng(9)
    m = make(spark, rng.gamma(2, 2, (50, 40)), cluster=np.arange(50) % 5)
    for measure in ("vmr", "sd"):
        got = features.decile_features(m, measure).toPandas().sort_values("feat_id")
        v = m.values.toPandas().pivot(index="cell_id", columns="feat_id", values="value")
        mean, std = v.mean(), v.std(ddof=0)
        spread = (std**2 + 1) / (mean + 1) if measure == "vmr" else std
        d = pd.qcut(mean, 10, labels=False)
        want = [(spread[f] > np.percentile(spread[d == d[f]], 70)) and d[f] < 9 for f in v.columns]
        assert got["variable"].astype(bool).tolist() == want and got["decile"].tolist() == d.tolist()
    with pytest.raises(ValueError):
        features.decile_features(m, "cv")
    with pytest.warns(UserWarning):
        assert features.find_common_variable([m, m], n_markers=8000).count() == 40
    with pytest.raises(ValueError):
        features.find_common_variable([m], "other")
    with pytest.raises(RuntimeError):
        features.common_features([spark.range(3).toDF("feat_id"), spark.range(5, 7).toDF("feat_id")])
    with pytest.raises(Exception, match="not distinct"):
        features.decile_features(make(spark, np.ones((4, 20)))).collect()
    assert features.flagged(m, spark.range(2).toDF("feat_id")).where("common_variable = 1").count() == 2


def test_modality(spark, tmp_path):
    f = spark.createDataFrame([("G1.3", 1), ("G2.1", 0)], "feat_id string, ok int")
    c = spark.createDataFrame([(1, 1), (2, 0)], "cell_id int, ok int")
    v = spark.createDataFrame([(1, "G1.3", 2.0), (2, "G2.1", 4.0)], "cell_id int, feat_id string, value double")
    m = Modality("x", c, f, v)
    assert sorted(r.feat_id for r in m.without_versions().values.collect()) == ["G1", "G2"]
    assert m.where(cells=F.col("ok")).values.count() == 1 and m.where(features=F.col("ok"), inverse=True).features.first().feat_id == "G2.1"
    assert m.dense().count() == 4
    s = stats.sparse_feature_moments(m.values, m.features, 2)
    assert {r.feat_id: r["mean"] for r in s.collect()} == {"G1.3": 1.0, "G2.1": 2.0}
    m.write(str(tmp_path / "m"))
    m.write(str(tmp_path / "m"), "append")
    assert modality.read(spark, str(tmp_path / "m"), "x").values.count() == 4
    clash = Modality("y", c, spark.createDataFrame([("G.1", 1), ("G.2", 1)], "feat_id string, ok int"), v)
    with pytest.raises(ValueError):
        clash.without_versions()
    with pytest.raises(ValueError):
        neighbors.check_features(m.features, clash.features)


def test_pca(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]
    m = make(spark, x)
    c = x - x.mean(0)
    want = (lambda u, s: (u * s) @ (u * s).T)(*np.linalg.svd(c, full_matrices=False)[:2])
    got = decompose.pca(m, 5).toPandas().sort_values("cell_id")
    p = np.array(got["vec"].tolist())
    assert np.allclose(p @ p.T, want)
    q = np.array(decompose.pca(m, 2, drop_first=True, unit_rms=True).toPandas().sort_values("cell_id")["vec"].tolist())
    assert q.shape == (60, 2) and abs((q**2).mean() - 1) < 1e-9
    with pytest.raises(ValueError):
        decompose.pca(m, 9)
    x = rng.normal(size=(80, 30)) * np.array([9, 7, 5, 3, *[0.3] * 26]) + 4
    exact, near = (np.array(decompose.pca(make(spark, x), 3, most_features=f).toPandas().sort_values("cell_id")["vec"].tolist()) for f in (100, 5))
    assert np.allclose(exact, near, atol=1e-6)


def test_streaming_moments(spark, tmp_path):
    from plexmat.streaming.moments import running_moments

    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double").write.parquet(str(tmp_path / "in"))
    q = running_moments(spark.readStream.schema("k string, v double").parquet(str(tmp_path / "in")), "k", "v").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: (r["mean"], r["std"]) for r in spark.table("moments").collect()} == {"a": (2.0, 1.0), "b": (5.0, 0.0)}


def test_equal_features_get_equal_flags(spark):
    """Spreads that differ in the last digits alone, by the order in which a feature's values are summed."""
    values = [(0.1, 0.2, 0.3, 0.7), (0.7, 0.3, 0.2, 0.1), (0.3, 0.1, 0.7, 0.2)]
    exact = [[(1 + f // 10 * 10 + x) * 1.1 for x in v] for f in range(100) for v in [values[f % 3] if f % 10 < 7 else (0.1, 0.2, 0.3, 0.70001)]]
    df = spark.createDataFrame([(c, f, float(v[c])) for f, v in enumerate(exact) for c in range(4)], "cell_id long, feat_id long, value double").repartition(3)
    ids = [df.select(x).distinct() for x in ("cell_id", "feat_id")]
    got = features.decile_features(Modality("m", *ids, df), "sd", 80).toPandas().sort_values("feat_id")
    first = got[got.feat_id % 10 < 7]
    assert first.groupby(first.feat_id // 10)[["decile", "variable"]].nunique().max().max() == 1
