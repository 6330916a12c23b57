import gzip
import hashlib
import math
import re
import time
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plexmat.llm import fingerprints, language, license_texts, licenses, packing, quality, shingles, toxicity, warc


def test_fingerprints(odd, empty, spark):
    got = fingerprints.edited_fingerprints(odd.where("doc_id is not null"), parts=3).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.where("doc_id is not null").collect()]
    texts.sort(key=lambda x: (-x[0], x[1]))
    assert len(got) == len(texts)
    for (i, t), (_, u) in zip(texts, texts[1:] + texts[:1]):
        k = len(t) // 3
        want = hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
        assert any(r.doc_id == i and r.edited_sha256 == want and r.n_chars == len(t) for r in got)
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[1] == by[2] and by[3] == by[4] == "" and by[1] != by[9]
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.edited_fingerprints(odd).count() == odd.count()
    assert fingerprints.fingerprints(odd).count() == odd.count()


def test_samples_collide_as_generalised_jaccard():
    rng = np.random.default_rng(0)
    err = []
    for _ in range(20):
        u = rng.integers(0, 2**62, 80).astype(np.uint64)
        a, b = rng.integers(1, 6, 80).astype(float), rng.integers(1, 6, 80).astype(float)
        s = fingerprints.signatures(np.concatenate((u, u)), np.concatenate((a, b)), np.array([0, 80, 160]), 256)
        err.append(np.mean(s[0] == s[1]) - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(err)) < 0.03


def test_language_against_plain_ppm(odd, empty):
    samples = {"a": ["abracadabra abba cab"], "b": ["the cat sat on the mat", "banana"]}

    def brute(train, text):
        count = {}
        for t in train:
            t = "   " + t
            for i in range(3, len(t)):
                for o in range(4):
                    d = count.setdefault(t[i - o : i], {})
                    d[t[i]] = d.get(t[i], 0) + 1
        text, bits = "   " + text, 0.0
        for i in range(3, len(text)):
            for o in (3, 2, 1, 0):
                if c := count.get(text[i - o : i]):
                    n, d = sum(c.values()), len(c)
                    if text[i] in c:
                        bits -= math.log2(c[text[i]] / (n + d))
                        break
                    bits += math.log2((n + d) / d)
            else:
                bits += 8
        return bits

    texts = ["abba on the cat", "zzz", "", "banana cab", "a"]
    got = language.learn(samples).code_lengths(pa.array(texts))
    assert np.allclose(got, [[brute(samples[x], t) for x in "ab"] for t in texts], atol=1e-3)
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (3, 4, 7)} == {"und"}
    assert language.identify(empty).count() == 0


def test_toxicity(odd, empty, labels, spark):
    assert toxicity.fold("Ｓtuрid 1d10t s-c-u-m 2024") == "stupid idiot s-c-u-m 2024"
    sample = [(f"you are a grumpus number {i} here", 1) for i in range(40)] + [(f"a fine day {i} for all of you", 0) for i in range(80)]
    lex = toxicity.learn(sample, exceptions=("grumpus the cat",))
    a = lex.automaton()
    score = lambda t: toxicity.probability(lex.slope, toxicity.hits(a, toxicity.fold(t)), len(t.split()))
    assert score("what a GRUMPU5 you are") > 0.7 > score("what a fine day") and score("see grumpus the cat") < 0.5 and score("") < 0.5
    assert toxicity.learn([("x", 1)]).weights == {}
    tied = [("aa zz one", 1), ("bb zz two", 1)] * 1 + [(f"aa zz {i}", 1) for i in range(9)] + [(f"quiet {i}", 0) for i in range(9)]
    assert toxicity.learn(tied).weights == toxicity.learn(tied[::-1]).weights  # ties don't go by the order of the texts
    got = toxicity.toxicity(odd, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] == by[None] and len({r.score for r in got if r.doc_id == 5}) == 1
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.drop_toxic(odd, labels).columns == odd.columns
    assert toxicity.drop_toxic(empty, labels).count() == 0 and toxicity.drop_toxic(odd, labels.limit(0)).count() == odd.count()


def _quality_table(spark):
    good = [(i, f"the quick brown fox number {i} jumps over the lazy dog again", 1) for i in range(60)]
    bad = [(100 + i, f"buy%%% now### {i} click&&& here*** win$$$", 0) for i in range(40)]
    docs = spark.createDataFrame([(*x, None) for x in good + bad], "doc_id long, text string, y int, lang string")
    return docs, docs.selectExpr("doc_id", "y AS quality", "1 - y AS toxic")


def test_quality(odd, empty, labels, spark):
    docs, marks = _quality_table(spark)
    model = quality.fit(docs, marks)
    s = model.scores(pa.array(["the lazy dog jumps over the fox", "click### now%%% win***", ""]))
    assert s[0] > 0.7 > 0.3 > s[1] and 0 <= s[2] <= 1
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] == by[4] and {r.doc_id: r.held_out for r in got}[5] == (zlib.crc32(b"5") % 4 == 2)
    assert quality.quality(empty, labels).count() == 0 and {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_quality_by_plain_loops(spark):
    """Word vectors and scores again, word by word."""
    docs, marks = _quality_table(spark)
    words, dim = 512, 8
    model = quality.fit(docs, marks, words=words, dim=dim)
    split = lambda t: re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[!-/:-@\[-`{-~]+", t)
    number = lambda w: int(quality.tokens(pa.array([w]), words)[0][0])
    index, context = quality.index_vectors(words, dim), np.zeros((words, dim))
    for r in docs.collect():
        w = [number(x) for x in split(r.text)]
        for i, x in enumerate(w):
            for j in range(max(0, i - quality.NEAR), min(len(w), i + quality.NEAR + 1)):
                if i != j:
                    context[x] += index[w[j]]
    vectors = np.array([[*index[i] / 2, *context[i] / max(np.linalg.norm(context[i]), 1)] for i in range(words)])
    assert np.allclose(model.vectors, vectors, atol=1e-6)
    for r in quality.quality(docs, marks, words=words, dim=dim).collect()[::9]:
        text = next(x.text for x in docs.collect() if x.doc_id == r.doc_id)
        v = [vectors[number(x)] for x in split(text)]
        x = np.concatenate((np.mean(v, axis=0), np.mean([y * y for y in v], axis=0), np.sum([a[:dim] * b[:dim] for a, b in zip(v, v[1:])], axis=0) / len(v), [math.log1p(len(v))]))
        hidden = [max(0.0, sum(a * b for a, b in zip(np.clip((x - model.mean) / model.scale, -quality.FAR, quality.FAR), column)) + c) for column, c in zip(model.w1.T, model.b1)]
        z = (sum(a * b for a, b in zip(hidden, model.w2)) + model.b2) / model.temperature + math.log(model_shares(docs, marks))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-4


def model_shares(docs, marks):
    train = [r.quality for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    return train.count(1) / train.count(0)


def test_held_out_labels_are_not_read(spark):
    docs, marks = _quality_table(spark)
    for score, held, parts in ((quality.quality, 2, 4), (toxicity.toxicity, 1, 3)):
        out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held
        other = marks.select("doc_id", *(F.when(out, 1 - F.col(c)).otherwise(F.col(c)).alias(c) for c in ("quality", "toxic")))
        a, b = ({r.doc_id: r.score for r in score(docs, m).collect()} for m in (marks, other))
        assert a == b and len(set(a.values())) > 1
    text = docs.withColumn("lang", F.when(F.col("y") == 1, "en").otherwise("xx"))
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language.identify(d).collect()} for d in (text, text.withColumn("lang", F.when(out, "zz").otherwise(F.col("lang")))))
    assert a == b and {x for x, _ in a.values()} == {"en", "xx"}


def test_toxicity_fit_is_that_of_memory(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{c}" for c in "abcdefghijklmnop"] + ["grumpus", "grumpusses", "vilething", "vile", "red grumpus"]
    rows = []
    for i in range(300):
        toxic = int(rng.random() < 0.4)
        w = list(rng.choice(vocabulary[:16], 12))
        if toxic:
            w[3] = str(rng.choice(["grumpus", "grumpusses", "vilething", "Gr\u0443mpu5"]))
        elif rng.random() < 0.2:
            w[3] = "red vilething"
        rows.append((i, " ".join(w), toxic))
    rows += [(1000, rows[0][1], rows[0][2]), (None, "grumpus", 0), (1001, None, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = toxicity.fit(docs, marks)
    train = sorted(((hashlib.md5(str(i).encode()).hexdigest(), t or "", y) for i, t, y in rows if i is not None and zlib.crc32(str(i).encode()) % 3 != 1))
    share = sum(y == 0 for *_, y in train) / sum(y == 1 for *_, y in train)
    want = toxicity.learn([(t, y) for _, t, y in train], odds_of_clean=share)
    assert got.weights == want.weights and got.weights and got.exceptions == want.exceptions and np.allclose(got.slope, want.slope)
    few = toxicity.fit(docs, marks, sample=20)
    assert few.weights.keys() != got.weights.keys() or few.slope != got.slope


def test_toxicity_matches_by_plain_search():
    rng = np.random.default_rng(6)
    lex = toxicity.Lexicon({"bad": 2.0, "bad*": 1.5, "ugly*": 3.0, "ug": 1.0}, ("not bad", "ugly duck"))
    a = lex.automaton()

    def plain(text):
        spans = [m.span() for p in lex.exceptions for m in re.finditer(rf"(?<![^\W\d_]){p}(?![^\W\d_])", text)]
        best = {}
        for e, w in lex.weights.items():
            tail = "" if e.endswith("*") else r"(?![^\W\d_])"
            for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(e.rstrip('*'))}{tail})", text):
                i, j = m.start(), m.start() + len(e.rstrip("*"))
                if not any(x <= i and j <= y for x, y in spans):
                    best[i] = max(best.get(i, 0.0), w)
        return sum(best.values())

    for _ in range(400):
        text = "".join(rng.choice(["bad", "ugly", "ug", "not ", "duck", " ", " ", "s", "1", "-"], rng.integers(1, 14)))
        assert abs(toxicity.hits(a, text) - plain(text)) < 1e-9, text
    long = "not bad ugly duck bad " * 20000
    start = time.process_time()
    assert toxicity.hits(a, long) == 40000 and time.process_time() - start < 5


def test_fingerprints_by_plain_loops():
    texts = ["one two three four five six seven", "a b c d e " * 4, "one two three four five six eight", "short", ""]
    sig, full = fingerprints.fingerprint_texts(pa.array(texts), 16)
    for t, row, some in zip(texts, sig, full.tolist()):
        v, c, _ = shingles.shingles(pa.array([t]))
        assert some == bool(len(v))
        for k in range(16 if some else 0):
            a = min(fingerprints.draws(v[i : i + 1], c[i : i + 1].astype(float), k)[0] for i in range(len(v)))
            assert row[k] == int(shingles.mix(np.array([a.view(np.uint32)], np.uint64))[0]) >> 48
    assert fingerprints.likeness(sig[0], True, sig[2], True) == sum(x == y for x, y in zip(sig[0], sig[2])) / 16


def test_licenses(odd, empty, spark):
    mit = license_texts.TEXTS["MIT"]
    rows = [(1, "MIT License".replace("MIT License", "") + "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "  ")), (2, mit.replace("SUBLICENSE".lower(), "sublicence")), (3, mit + " more"), (4, "Text.\nlicensed under the apache licence, version 2.0\nEnd."), (5, "Released under the MIT License."), (6, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["MIT", "MIT", None, None, "MIT", None]
    assert got[4].notice_ids == ["Apache-2.0"] and got[4].n_notices == 1 and got[6].text_digest == hashlib.sha256(b"").hexdigest()
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty).count() == 0


def test_licenses_by_plain_lookup(spark):
    """Documents made of known texts, changed in ways that count and that don't, against a look-up text by text."""
    rng = np.random.default_rng(7)
    known = list(license_texts.TEXTS.items())
    rows = []
    for i in range(60):
        name, text = known[int(rng.integers(len(known)))]
        how = int(rng.integers(4))
        text = [text, text.upper(), re.sub(r"[ \t]+", "   ", text), text + " and one more clause"][how]
        rows.append((i, text, name if how < 3 else None))
    table = {licenses.digest(t): n for n, t in known}
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: n for i, _, n in rows} == {i: table.get(licenses.digest(t)) for i, t, _ in rows}


def test_full_and_titled_licenses(spark):
    files = Path(licenses.__file__).parent / "license_files"
    t, by = license_texts.TEXTS, "\n\nCopyright (c) 2020 Somebody\n\n"
    rows = [(f"MIT License{by}{t['MIT']}", "MIT"), (f"The MIT License (MIT){by}{t['MIT']}", "MIT"), (f"BSD 3-Clause License{by}{t['BSD-3-Clause']}", "BSD-3-Clause"), (f"ISC License{by}{t['ISC']}", "ISC")]
    for name, i in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0-only"), ("GPL-3", "GPL-3.0-only"), ("LGPL-2.1", "LGPL-2.1-only"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("Artistic", "Artistic-1.0-Perl")):
        rows.append(((files / f"{name}.txt").read_text(), i))
    for name, i in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0-only")):
        rows.append(((files / f"{name}.txt").read_text().split("END OF TERMS")[0], i))
    rows.append(((files / "GPL-2.txt").read_text().replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307"), "GPL-2.0-only"))
    rows.append((f"My License{by}{t['MIT']}", None))
    rows += [(f"{line}\n\n{t['MIT']}", "MIT") for line in ("Copyright Jane Doe", "Copyright Jane Doe and contributors", "Copyright by The Authors", "(c) Jane", "Copyright (C) 1999-2020 X, Inc.  All rights reserved.")]
    rows.append((f"copyright notice of Jane\n\n{t['MIT']}", None))
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(rows)], "doc_id long, text string")
    assert [r.license_id for r in licenses.scan(df).orderBy("doc_id").collect()] == [i for _, i in rows]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_is_the_tokenizer(hf):
    enc = packing.Encoder(packing.read_ranks(packing.default_vocabulary()), public_tokenizers.PATTERN, packing.default_specials())
    rng = np.random.default_rng(3)
    pieces = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "Wort", "é", "12", "'s", "\t", "x" * 140, "日本"]
    mixed = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(400)]
    texts = [*mixed, "", "  a b", "a  b", "a \n b", "x\n\ny", "x\ny z\n", "it's we'll 12ab 3.5", " x 　 y", "a\tb c", "<|endoftext|> x", " lead", "trail ", "é è\u0085z q", "a\x1cb c", "plain words here\nand here", "日本 語 the-end", "w" * 300]
    for batch in (texts, *([t] for t in texts)):
        got = [np.frombuffer(x, np.uint16).tolist() for x in enc.batch(pa.array(batch))]
        assert got == [hf.encode(t, add_special_tokens=False).ids for t in batch]


def test_packing_round_trip(odd, empty, hf):
    import zlib

    got = packing.pack(odd, window=64, shard_docs=4).toPandas()
    assert (got.groupby("sequence_id")["length"].sum() < 64).sum() <= odd.rdd.getNumPartitions()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 64
    for r in odd.where("doc_id is not null and doc_id <> 5").collect():
        ids = np.array([*hf.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == r.doc_id].sort_values("start")
        assert own["length"].sum() == len(ids) and set(own["doc_tokens"]) == {len(ids)}
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own.itertuples())
    assert packing.pack(empty).count() == 0


def test_packing_asks_for_near_documents():
    rng = np.random.default_rng(0)
    ids = [np.append(rng.choice(np.arange(100 * g, 100 * g + 60), 20), 0).astype(np.uint16) for g in (1, 2, 3) for _ in range(4)]
    shard = packing.Shard(ids, np.ones(65536), 21.0)
    assert set(np.argsort(-shard.search(5))[:4].tolist()) == {4, 5, 6, 7}


def test_packing_asks_for_all_tokens():
    seed, idf = np.arange(1, 201), np.ones(65536)
    idf[1:31] = 9.0
    other = np.arange(300, 400)
    ids = [np.append(x, 0).astype(np.uint16) for x in (seed, seed[:30], seed[30:], other, other)]
    scores = packing.Shard(ids, idf, 100.0).search(0)
    assert scores[2] > 0 and scores[3] == scores[4] == 0
    size, tf = 171, 1
    assert abs(scores[2] - 170 * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * size / 100.0))) < 1e-3


def test_packing_by_plain_bm25():
    """Scores by the formula, and the windows that greedy filling by them gives."""
    rng = np.random.default_rng(9)
    ids = [np.append(rng.zipf(1.4, int(rng.integers(3, 30))) % 50 + 1, 0).astype(np.uint16) for _ in range(40)]
    idf, mean = rng.random(65536) + 0.1, float(np.mean([len(x) for x in ids]))
    shard = packing.Shard(ids, idf, mean)

    def plain(seed, doc):
        body, total = ids[doc][:-1].tolist(), 0.0
        for t in {*ids[seed][:-1].tolist()} & {*body}:
            tf = body.count(t)
            total += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids[doc]) / mean))
        return total

    for seed in range(40):
        assert np.allclose(shard.search(seed), [plain(seed, d) for d in range(40)], rtol=1e-5)
    packer = packing.Packer(0, 64)
    packer.pack(list(range(40)), ids, shard)
    got, unused, seed, filled = [], set(range(40)), None, 0
    while unused:
        scores = {d: plain(seed, d) for d in unused} if seed is not None else {}
        best = min(unused, key=lambda d: (-scores[d], d)) if scores and max(scores.values()) > 0 else min(unused)
        unused.remove(best)
        got.append(best)
        over = filled + len(ids[best]) >= 64
        filled = (filled + len(ids[best])) % 64
        seed = (best if filled else None) if over or seed is None else seed
    assert list(dict.fromkeys(r[0] for r in packer.rows)) == got


def test_packing_joins_documents_far_apart(spark):
    rows = [(i, " ".join(f"{i % 40}zq{i % 40}x{j}" for j in range(6)) + " and some of the words that all have") for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id"), shard_docs=20, window=4096).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r.doc_id for r in got))
    assert sorted(order) == list(range(200))
    assert sum(a % 40 == b % 40 for a, b in zip(order, order[1:])) > 130


def test_warc(spark):
    rows = [(1, "http://a.example/x", "<html lang='EN'><title>T &amp; t</title><script>var x='<p>';</script><p>One<br>two</p><a href='/'>l</a></html>"), (2, None, None), (None, "u", "plain")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    src = {r.target_uri: r for r in warc.responses(pages).collect()}
    got = warc.derive(warc.responses(pages)).collect()
    assert len(got) == 6 and all(r.refers_to == src[r.target_uri].record_id for r in got)
    conv = next(r for r in got if r.warc_type == "conversion" and r.target_uri == "http://a.example/x")
    assert bytes(conv.content).decode() == "T & t\nOne\ntwo\nl" and conv.headers["WARC-Source-Payload-Digest"] == src["http://a.example/x"].payload_digest
    meta = next(r for r in got if r.warc_type == "metadata" and r.target_uri == "http://a.example/x")
    assert b"http-content-type: text/html" in bytes(meta.content) and b"lang: en" in bytes(meta.content)
    for compress in (True, False):
        back = list(warc.parse(b"".join(warc.to_bytes(r.asDict() | {"headers": dict(r.headers)}, compress) for r in got)))
        assert [(x["record_id"], x["content"], x["refers_to"], x["headers"]) for x in back] == [(r.record_id, bytes(r.content), r.refers_to, dict(r.headers)) for r in got]
    assert warc.derive_pages(pages).count() == 6 and warc.derive_pages(pages.where("false")).count() == 0


def test_page_text_by_a_parser():
    """Pages of the test tables against Python's own HTML parser."""
    import html.parser

    path = Path("/root/testdata/sf0.001/pages.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    block = set(re.search(r"\(\?:([^)]*)\)", warc._BLOCK.pattern)[1].replace("h[1-6]", "h1|h2|h3|h4|h5|h6").split("|"))

    class Reader(html.parser.HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.silent = [], 0

        def handle_starttag(self, tag, attrs):
            self.silent += tag in ("script", "style", "noscript", "template", "svg")
            self.out.append(" " if self.silent else "\n" if tag in block else "")

        def handle_endtag(self, tag):
            self.silent -= tag in ("script", "style", "noscript", "template", "svg")
            self.out.append("\n" if tag in block else "")

        def handle_data(self, data):
            if not self.silent:
                self.out.append(data)

    pages = [x for x in pq.read_table(path)["html"].to_pylist() if x]
    same = 0
    for page in pages:
        r = Reader()
        r.feed(page)
        r.close()
        same += "\n".join(filter(None, (" ".join(x.split()) for x in "".join(r.out).split("\n")))) == warc.plain_text(page)
    assert same >= 0.99 * len(pages), (same, len(pages))


def test_warc_files_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    nested = b"x WARC/1.1\r\nWARC-Type: response\r\n\r\nno record WARC/1.0\r\n"
    blocks = [b"", nested, rng.bytes(5000), b"\r\n\r\n" * 3, b"WARC/1.", "é\n".encode() * 50]
    rows = [warc._record(f"<urn:{i}>", "response", None, f"http://x/{i}", warc.DATE, "application/http", "sha1:A", b, {"X-Own": str(i)}) for i, b in enumerate(blocks)]
    df = spark.createDataFrame([tuple(r[n] for n in warc._NAMES) for r in rows], warc.RECORD)
    want = {r["record_id"]: (r["content"], r["headers"], r["target_uri"], r["block_digest"], r["content_length"]) for r in rows}
    seen = lambda d: {r.record_id: (bytes(r.content), dict(r.headers), r.target_uri, r.block_digest, r.content_length) for r in d.collect()}
    warc.write_warc(df.coalesce(2), str(tmp_path / "out"))
    assert [f.name for f in (tmp_path / "out").glob("part-*")] and all(f.name.endswith(".warc.gz") for f in (tmp_path / "out").glob("part-*"))
    assert seen(warc.read_warc(spark, str(tmp_path / "out"))) == want
    for f in (tmp_path / "out").glob("part-*"):
        assert all(r["record_id"] in want for r in warc.parse(f.read_bytes()))
    (tmp_path / "own").mkdir()
    (tmp_path / "own" / "a.warc").write_bytes(b"".join(warc.to_bytes(r, False) for r in rows))
    (tmp_path / "own" / "b.warc.gz").write_bytes(b"".join(warc.to_bytes(r | {"record_id": r["record_id"] + "b"}) for r in rows))
    assert seen(warc.read_warc(spark, str(tmp_path / "own"))) == want | {k + "b": v for k, v in want.items()}
    data = spark.createDataFrame([(b"".join(warc.to_bytes(r) for r in rows),), (None,)], "data binary")
    assert seen(warc.records_of(data)) == want


def test_warc_of_broken_input(spark):
    rng = np.random.default_rng(2)
    whole = gzip.compress(b"<html><title>t</title><p>some text here</p></html>" * 20, mtime=0)
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=%s\r\n\r\n"
    blocks = [head % b"utf-8" + whole]
    for _ in range(200):
        bad = bytearray(whole)
        bad[rng.integers(len(bad))] ^= 1 << rng.integers(8)
        blocks.append(head % b"utf-8" + bytes(bad))
    blocks += [head % c + whole for c in (b"idna", b"punycode", b"undefined", b"rot13", b"utf-16", b"utf-7", b"nonesuch", b"unicode_escape")]
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    blocks += [chunked + b"3\r\nabc\r\n4;x\r\ndefg\r\n0\r\n\r\n", chunked + b"-5\r\nabc\r\n", chunked + b"ffffff\r\nabc", chunked + b"zz\r\n", b"", b"\r\n\r\n", b"no head", rng.bytes(3000)]
    df = spark.createDataFrame([(None if i % 7 == 0 else f"<urn:{i}>", "response", None, None, None, None, None, None, None, None, b) for i, b in enumerate(blocks)], warc.RECORD)
    got = warc.derive(df).collect()
    assert len(got) == 2 * len(blocks) and len({r.record_id for r in got}) >= 2 * len(blocks) - 60
    assert bytes(warc.derivatives(dict.fromkeys(warc._NAMES) | {"content": chunked + b"3\r\nabc\r\n4;x\r\ndefg\r\n0\r\n\r\n"})[1]["content"]) == b"abcdefg"
    files = warc.to_bytes(warc._record("<urn:1>", "response", None, "u", warc.DATE, "t", "d", b"abc" * 99, {}))
    for _ in range(200):
        bad = bytearray(files * 2)
        bad[rng.integers(len(bad))] ^= 1 << rng.integers(8)
        assert len(list(warc.parse(bytes(bad)))) <= 2
    assert list(warc.parse(b"WARC/1.1\r\nContent-Length: -4\r\n\r\nabcd")) == list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabcd")) == []


@pytest.mark.parametrize("unit", ["<p ", "<a ", "<title>", "<html ", "<!--", "<script", "</script ", "<", "&", "<a href", "<a <p >"])
def test_page_text_in_linear_time(unit):
    page = unit * 200_000
    start = time.process_time()
    warc.plain_text(page), warc.said(page)
    assert time.process_time() - start < 5
