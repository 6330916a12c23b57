import pytest

CLASHES = "_i _x _tx _id _k _m _d _n _y _row _place _p _g _r _h _source _size target taken held_out kept".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, score double, " + ", ".join(f"{c} string" for c in CLASHES)
LONG = "lorem ipsum dolor sit amet " * 12000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, base, "en", "a", 1, "x", 0.5), (2, base.replace(" ", "\t \n"), "en", "a", 1, None, None), (3, "", None, None, 0, "", 0.0), (4, None, None, "b", None, None, None),
        (5, LONG, "en", "b", 9, "x", 1.0), (5, LONG, "en", "b", 9, "x", 1.0), (6, "word", "de", "c", 4, "y", 2.0), (None, "word", None, None, None, None, None), (7, "!!! ???", "fr", "c", 7, "z", 0.1),
        (8, base.upper() + "!", "en", None, 5, "w", 0.2), (9, "été où déjà", "fr", "c", 11, "v", 0.3),
    ]
    return spark.createDataFrame([(*r, *(f"{c}{r[0]}" if r[0] != 4 else None for c in CLASHES)) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def named(odd):
    """The same with ids that are no numbers."""
    return odd.selectExpr("'doc-' || doc_id AS doc_id", *(f"`{c}`" for c in odd.columns if c != "doc_id"))


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2, None) for i in range(10)] + [(None, 1, 1, None), (3, None, None, None)], "doc_id long, quality int, toxic int, text string")
