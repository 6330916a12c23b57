import re

import numpy as np
import pyarrow as pa

from plexmat.llm import exact_dedup, near_dedup, shingles


def test_exact(odd, empty):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].keep_id for i in (1, 2, 3, 4)] == [1, 1, 3, 3]
    assert by[3][0].group_size == 2 and by[8][0].group_size == 1
    assert sorted(r.kept for r in by[5]) == [False, True] and by[None][0].keep_id == 6 and not by[None][0].kept
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 8, 9]
    assert exact_dedup.exact_dedup(odd, broadcast_rows=0).where("kept").count() == 7


def test_shingles_match_plain_sets():
    texts = ["", "a", "A b. c", "one two three four five six", "x " * 50, "été où déjà vu ici là", "?!"]
    v, c, off = shingles.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        want = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if t else set()
        assert off[i + 1] - off[i] == len(want)
    assert c[off[4] : off[5]].tolist() == [46]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    err = []
    for n in (1, 4, 60, 900):
        u = rng.integers(0, 2**62, n).astype(np.uint64)
        a, b = rng.integers(1, 5, n) * 0.7, rng.integers(1, 5, n) * 0.7
        s = near_dedup.signatures(np.concatenate((u, u)), np.concatenate((a, b)), np.array([0, n, 2 * n]), 512)
        assert (s != near_dedup._NONE).all()
        err.append(np.mean(s[0] == s[1]) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert max(map(abs, err)) < 0.08


def _brute(texts, threshold=0.8):
    sets = []
    for t in texts:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) >= threshold * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_near_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 80)]
        for k in range(9):
            w = list(base)
            for _ in range(k % 4):
                w[int(rng.integers(len(w)))] = f"n{rng.integers(999)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = _brute(texts)
    for direct, per_round, rows in ((32, 16, 99), (2, 2, 10**6), (2, 2, 0)):  # all pairs at once, and round by round
        got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, direct=direct, per_round=per_round, shared_rows=rows).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_near_when_repeats_differ(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):
        base = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))
        texts += [" ".join([base] * m) for m in (1, 10, 40)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == _brute(texts)


def test_components(spark):
    rng = np.random.default_rng(6)
    name = lambda i: i.to_bytes(8, "big")
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(50)] + [(399, 300 + i) for i in range(99)]
    some = [(int(x), int(y)) for x, y in rng.integers(500, 700, (120, 2))]
    edges = path + star + some
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in edges:
        for x, y in edges:
            if x != y:
                root[x] = root[y] = min(root[x], root[y])
    got = near_dedup.components(spark.createDataFrame([(bytearray(name(x)), bytearray(name(y))) for x, y in edges], "_a binary, _b binary"))
    assert {int.from_bytes(r._n, "big"): int.from_bytes(r._c, "big") for r in got.collect()} == root
    assert near_dedup.components(spark.createDataFrame([], "_a binary, _b binary")).count() == 0


def test_near_recall(spark):
    """Pairs of similarity 0.8 and a little above, with lines repeated up to 1,000 times, against brute force."""
    rng = np.random.default_rng(8)
    texts, pairs = [], 150
    for i in range(pairs):
        n, block = int(rng.integers(60, 240)), " ".join(f"r{i}x{j}" for j in range(22))
        w = [f"w{x}" for x in rng.integers(0, 10**9, n)]
        cut = max(1, n // 11)
        v = [*w[:-cut], *(f"v{x}" for x in rng.integers(0, 10**9, cut))]
        times = int(rng.choice([0, 1, 50, 400, 1000])), int(rng.choice([0, 1, 50, 400, 1000]))
        texts += [" ".join([*w, *[block] * times[0]]), " ".join([*v, *[block] * times[1]])]
    want = []
    for a, b in zip(texts[::2], texts[1::2]):
        x, y = (set(zip(*(t.split()[j:] for j in range(5)))) for t in (a, b))
        want.append(len(x & y) >= 0.8 * len(x | y))
    assert 30 < sum(want) < pairs
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(pairs)] == want


def test_near_odd(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and [by[i].class_id for i in (1, 2, 3, 4, 8)] == [1, 1, 3, 3, 1]
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7, 9]
    assert near_dedup.drop_near_copies(empty).count() == 0
