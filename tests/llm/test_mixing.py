import importlib

from pyspark.sql import functions as F

from plexmat.llm import mixing


def test_mix(spark, odd, empty):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), s) for i, s in enumerate(["a"] * 40 + ["b"] * 300 + ["c"] * 25 + [None] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, pieces, goals = mixing.mix(df, block=16)
    size = {r.source: r.source_size for r in goals.collect()}
    target = {r.source: r.target for r in goals.collect()}
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 and all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    taken = placed.join(pieces.groupBy("_r").agg(F.sum("length").alias("t")), "_r", "left").fillna(0, ["t"])
    assert taken.where("t > 2 * _size").count() == 0
    assert {r._source: r.n for r in taken.groupBy("_source").agg(F.sum("t").alias("n")).collect()} == {s: round(t) for s, t in target.items()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and out.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(round(t) for t in target.values())
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(empty).count() == 0


def test_schedule_decides(spark):
    """The mix follows the schedule: its first parts have the sources in their shares, and another schedule gives another mix."""
    rng = __import__("numpy").random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), str(rng.choice(list("abcdefg"), p=[0.3, 0.3, 0.2, 0.1, 0.06, 0.03, 0.01]))) for i in range(1500)] + [(9000, "one", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = df.select("source", mixing.size_of(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = mixing.targets(sizes, block=16)
    slots = mixing.schedule(spark, goals).orderBy("position").collect()
    due = {r.source: r.blocks for r in goals.collect()}
    total = sum(due.values())
    assert {s: sorted(r.rank for r in slots if r.source == s) for s in due} == {s: list(range(n)) for s, n in due.items()}
    seen = dict.fromkeys(due, 0)
    for i, r in enumerate(slots[: total * 9 // 10], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - i * due[s] / total) < 4 + 0.03 * i for s in due)
    a, b, none = (mixing.mixed(df, block=16, golden=g).orderBy("doc_id").collect() for g in (mixing.GOLDEN, 0.7548776662466927, 1e-9))
    assert [r.taken for r in a] == [r.taken for r in b] != [r.taken for r in none] and [r.position for r in a] != [r.position for r in b]
    assert sum(r.taken for r in none) < sum(r.taken for r in a)
    place = {r.doc_id: r.position for r in a}
    first = {}
    for r in mixing.mixed_documents(df, block=16).collect():
        first.setdefault(r.doc_id, len(first))
    order = [place[i] for i in first]
    assert sum(x <= y for x, y in zip(order, order[1:])) > 0.9 * (len(order) - 1)


def test_pipeline_stages(spark, tmp_path, odd, labels):
    pipeline = importlib.import_module("corpus_pipeline")
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
