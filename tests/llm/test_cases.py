"""Cases that every operator and stage must stand: ids that are no numbers, clashing names, empty tables, a long text of distinct words."""

import importlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plexmat.llm import common, exact_dedup, fingerprints, language, licenses, mixing, near_dedup, packing, quality, toxicity
from test_dedup import _brute

OPERATORS = {
    "fingerprints": lambda d, m: fingerprints.edited_fingerprints(d),
    "exact": lambda d, m: exact_dedup.exact_dedup(d),
    "language": lambda d, m: language.identify(d),
    "quality": lambda d, m: quality.quality(d, m),
    "licenses": lambda d, m: licenses.scan(d),
    "toxicity": lambda d, m: toxicity.toxicity(d, m),
    "mixing": lambda d, m: mixing.mixed(d),
    "near": lambda d, m: near_dedup.near_duplicates(d),
}
FILTERS = {"toxicity": toxicity.drop_toxic, "exact": lambda d, m: exact_dedup.drop_copies(d), "near": lambda d, m: near_dedup.drop_near_copies(d)}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(name, odd, named, empty, labels):
    ids = sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    for docs in (odd, named):
        got = OPERATORS[name](docs, labels).collect()
        assert sorted(str(r.doc_id).removeprefix("doc-") for r in got) == ids
    assert OPERATORS[name](empty, labels).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_and_rows(name, odd, named, empty, labels):
    kept = FILTERS[name](odd, labels)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    rows = Counter(map(tuple, odd.collect()))
    assert not Counter(map(tuple, kept.collect())) - rows
    assert sorted(str(r.doc_id).removeprefix("doc-") for r in FILTERS[name](named, labels).collect()) == sorted(str(r.doc_id) for r in kept.collect())
    assert FILTERS[name](empty, labels).count() == 0 and FILTERS[name](empty, labels).columns == odd.columns


def test_values_on_odd_tables(odd, labels):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    q, t = by(quality.quality(odd, labels)), by(toxicity.toxicity(odd, labels))
    assert q[3].score == q[4].score and q[6].score == q[None].score and t[3].score == t[4].score
    lic = by(licenses.scan(odd))
    assert all(r.license_id is None and r.n_notices == 0 for r in lic.values()) and lic[3].text_digest == lic[4].text_digest == lic[7].text_digest
    m = mixing.mixed(odd).collect()
    size = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s or ""))
    assert sorted(r.size for r in m) == sorted(size(r.text) for r in odd.collect())
    assert all((r.position is None) == (r.taken == 0) and 0 <= r.taken <= 2 * r.size for r in m)
    assert abs(sum(r.taken for r in m) - 1.5 * sum(r.size for r in m)) <= 4


def test_a_long_text_of_distinct_words(spark, labels):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "short text of a few words here", "en", "b"), (4, long[: len(long) // 2], "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert [r.class_id for r in near_dedup.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3, 4]
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 4
    f = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert f[2].near_next > 0.9 and f[1].n_chars == len(long)
    assert packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
    assert {r.size for r in mixing.mixed(docs).collect()} == {120_000, 120_001, 7, len(long[: len(long) // 2].split())}
    assert language.identify(docs).count() == quality.quality(docs, labels).count() == toxicity.toxicity(docs, labels).count() == licenses.scan(docs).count() == 4


def test_packing_of_other_ids(named):
    got = packing.pack(named)
    assert dict(got.dtypes)["doc_id"] == "string" and got.select("doc_id").distinct().count() == named.select("doc_id").distinct().count()


def test_scratch_tables_go(spark):
    with common.Scratch() as outer:
        with common.Scratch() as inner:
            kept, gone = (inner.keep(common.stored(spark.range(3), "a")), common.stored(spark.range(4), "b"))
            paths = [next(iter(x.inputFiles())).rpartition("/")[0].removeprefix("file:") for x in (kept, gone)]
        assert kept.count() == 3 and [os.path.exists(p) for p in paths] == [True, False]
        assert outer.paths
    assert not os.path.exists(paths[0])


def _corpus():
    """Documents of three sources with toxic ones, exact and near copies, and what should be left of them."""
    base = [" ".join(f"d{i}w{j % 37}x{j}" for j in range(60 + i)) for i in range(24)]
    rows = [(i, t, "abc"[i % 3]) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "  "), "a") for i in range(6)]
    rows += [(200 + i, base[i + 8] + " one more word", "b") for i in range(6)]
    rows += [(300 + i, f"you grumpus {base[i % 24]} vile grumpus {i} " + " ".join(f"t{i}y{j}" for j in range(40)), "c") for i in range(30)]
    rows += [(400, None, "a"), (401, "", None), (402, "lone", None)]
    marks = [(r[0], 1, int(r[0] // 100 == 3)) for r in rows]
    return rows, marks


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, marks = _corpus()
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(sorted(r.doc_id for r in docs.collect()))
    clean = [r for r in rows if r[0] // 100 != 3]
    assert left[0] == sorted(r[0] for r in clean)
    exact = {}
    for i, t, s in sorted(clean):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t or "", s))
    assert left[1] == sorted(i for i, *_ in exact.values())
    one = sorted(exact.values())
    roots = _brute([t for _, t, _ in one])
    near = [x for k, x in enumerate(one) if roots[k] == k]
    assert left[2] == [i for i, *_ in near]
    words = Counter()
    for r in docs.collect():
        words[r.source] += len(r.text.split())
    size = Counter()
    for _, t, s in near:
        size[s] += len(t.split())
    goal = {r.source: round(r.target) for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert words == {s: n for s, n in goal.items() if n}
    enc = packing.Encoder(packing.read_ranks(packing.default_vocabulary()), importlib.import_module("public_tokenizers").PATTERN, packing.default_specials())
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(enc(r.text)) // 2 + 1
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert Counter({i: sum(r.length for r in got if r.doc_id == i) for i in want}) == want and {r.doc_id for r in got} == {*want}
    assert all(r.offset + r.length <= 1024 for r in got)


def test_pipeline_of_no_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
