import os

import duckdb
import pytest

from plexmat.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(tuple(repr(float(x)) if isinstance(x, (int, float)) else repr(x) for x in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", ["kruskal_h_sparse", "hvf_vmr", "knn_negative", "knn_sparse", "impute_mnn_rescue", "fuse_pipeline", "kruskal_p_10groups", "constrained_knn_tight", "natural_sort", "round_unit"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(catalogue.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_impute_mnn_auto_on_more_cells(spark, tmp_path, monkeypatch):
    """1600 cells on either side: the SQL still has 10 neighbours, the operator by itself takes 20."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS vec_id, list_transform(range(8), lambda j: (hash(i * 8 + j) % 10007)::FLOAT / 10007) AS embedding, 0 AS label FROM range(3200) r(i)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    asked, mutual = [], catalogue.neighbors.mutual_top_k
    monkeypatch.setattr(catalogue.neighbors, "mutual_top_k", lambda t, s, kt, ks, search: asked.append((kt, ks)) or mutual(t, s, kt, ks, search))
    assert rows(catalogue.QUERIES["impute_mnn_auto"](spark, str(tmp_path)).toPandas()) == rows(con.sql(catalogue.SQL["impute_mnn_auto"]).df())
    s = catalogue._emb(spark, str(tmp_path), 0)
    catalogue.impute.impute(catalogue._emb(spark, str(tmp_path), 1), s, s.features, "mnn_rescue")
    assert asked == [(10, 10), (20, 20)]
