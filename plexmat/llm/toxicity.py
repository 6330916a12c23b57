"""Operator 8: toxicity by a weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common

#: Labelled documents of each class that the lexicon and its scale are learned from.
SAMPLE = 4000
THRESHOLD = 0.7
#: Entries: words and word beginnings of so many letters.
PREFIX = range(3, 10)
#: An entry is in so many toxic documents at least, and its weight (log odds) is at least this.
SUPPORT, LEAST = 6, 2.0
#: It is in so many times the share of toxic documents that it is in of clean ones.
RATIO = 8
#: A phrase is an exception if it is in so many clean documents at least, and in over so many times as many clean as toxic ones.
EXCEPTION_SUPPORT, EXCEPTION_RATIO = 5, 5
#: Counts that a task holds before it passes them on.
HELD = 200_000

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ɡ": "g", "н": "h", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "γ": "y", "ı": "i", "ℓ": "l",
}
# Digits and signs that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD |= dict.fromkeys((0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_FAR = re.compile(r"[^\x00-\xac\xae-\xff]").search
_MASKED = re.compile(r"[0134578@$!|€]+(?=[^\W\d_])")
_DIGIT = str.maketrans(DIGITS)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case, look-alike letters as Latin ones, invisible characters gone, and digits within or before letters as letters."""
    text = text.lower()
    if not text.isascii() and _FAR(text):
        text = text.translate(_FOLD)
    return _MASKED.sub(_unmasked, text)


def _unmasked(m: re.Match) -> str:
    """The letters that a run of digits and signs stands for, if it follows a letter or begins a word."""
    text, a, b = m.string, m.start(), m.end()
    before = text[a - 1] if a else " "
    if before.isalpha() or (not before.isalnum() and before != "_" and (text[b + 1 : b + 2].isalpha() or text[b + 1 : b + 2] in DIGITS)):
        return m[0].translate(_DIGIT)
    return m[0]


@dataclass
class Lexicon:
    """Weights of entries (those that end in '*' match word beginnings), exception phrases, and the scale of scores."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Of each string its length, its weights as a word and as a beginning, and whether it is an exception."""
        found: dict[str, list] = {}
        for e, w in self.weights.items():
            found.setdefault(e.rstrip("*"), [0.0, 0.0, False])[e.endswith("*")] = w
        # A phrase takes the place of what it covers.
        for p in self.exceptions:
            found.setdefault(fold(p), [0.0, 0.0, False])[2] = True
        a = ahocorasick.Automaton()
        for x, (word, begin, spare) in found.items():
            a.add_word(x, (len(x), word, begin, spare))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton: ahocorasick.Automaton, folded: str) -> float:
    """Sum of the weights of matches at word boundaries, without those inside an exception phrase; of entries that begin at one place the heaviest counts."""
    if not len(automaton):
        return 0.0
    found, spared = [], []
    for end, (n, word, begin, spare) in automaton.iter(folded):
        start = end + 1 - n
        if start and folded[start - 1].isalpha():
            continue
        whole = end + 1 == len(folded) or not folded[end + 1].isalpha()
        if w := max(begin, word) if whole else begin:
            found.append((start, end + 1, w))
        if spare and whole:
            spared.append((start, end + 1))
    if not found:
        return 0.0
    spared.sort()
    begins, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    best: dict[int, float] = {}
    for a, b, w in found:
        if not ((i := bisect_right(begins, a)) and reach[i - 1] >= b):
            best[a] = max(best.get(a, 0.0), w)
    return sum(best.values())


def features(total: float, n_words: int) -> tuple[float, float]:
    """A text's weight, and its weight for the square root of its length."""
    return math.log1p(total), total / math.sqrt(max(n_words, 1))


def probability(slope: tuple[float, float, float], total: float, n_words: int) -> float:
    if total <= 0:
        z = min(slope[0], -2.0)
    else:
        a, b = features(total, n_words)
        z = slope[0] + slope[1] * a + slope[2] * b
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def words_of(folded: str) -> list[str]:
    return _WORD.findall(folded)


def entries_of(words: list[str]) -> set[str]:
    """A text's words and word beginnings, the latter with a star."""
    own = set(words)
    return own | {w[:n] + "*" for w in own for n in PREFIX if len(w) > n}


def _matches(entries: dict[str, float], word: str) -> bool:
    return word in entries or any(word[:n] + "*" in entries for n in PREFIX)


def phrases_of(words: list[str], entries: dict[str, float]) -> set[str]:
    """A text's matched words, each with the word before it."""
    return {f"{a} {b}" for a, b in zip(words, words[1:]) if _matches(entries, b)}


def choose(counts: dict[str, tuple[int, int]], n_clean: int, n_toxic: int) -> dict[str, float]:
    """Entries and weights from the numbers of clean and toxic texts that have an entry.

    The weight is a lower bound of the log odds ratio. Words and word beginnings compete: those that tell most about the
    class (documents times weight; ties: the longer, then by code point) enter first, and bar what they are a beginning of
    and what is a beginning of them.
    """
    odds = {}
    for e, (c, n) in counts.items():
        if n >= SUPPORT and n * n_clean >= RATIO * c * n_toxic:
            w = math.log((n + 0.5) / (n_toxic - n + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
            w -= math.sqrt(1 / (n + 0.5) + 1 / (c + 0.5))
            if w >= LEAST:
                odds[e] = w
    entries: dict[str, float] = {}
    begun: set[str] = set()
    for e in sorted(odds, key=lambda e: (-odds[e] * counts[e][1], -len(e), e)):
        stem = e.rstrip("*")
        if stem in begun or any(stem[:n] + "*" in entries for n in range(1, len(stem) + 1)):
            continue
        entries[e] = odds[e]
        begun.update(stem[:n] for n in range(1, len(stem) + 1))
    return entries


def learn(sample: list[tuple[str, int]], exceptions: tuple[str, ...] = (), odds_of_clean: float | None = None) -> Lexicon:
    """A lexicon from (text, 0 or 1) in memory; fit() is the same on tables, with its counts made by Spark.

    Entries are chosen by choose(). Phrases of a matched word and the word before it that are in five clean documents or
    more, and in over five times as many clean as toxic ones, become exceptions. The scale is a logistic regression on
    features(), with the clean documents weighted to odds_of_clean (clean documents to a toxic one). Of equal texts one counts.
    """
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    total = [0, 0]
    kept = []
    for text, y in {t: y for t, y in reversed(sample)}.items():
        words = words_of(fold(text))
        kept.append((words, y, text))
        total[y] += 1
        seen[y].update(entries_of(words))
    if not total[0] or not total[1]:
        return Lexicon(exceptions=exceptions)
    entries = choose({e: (seen[0][e], n) for e, n in seen[1].items()}, *total)
    phrases: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y, _ in kept:
        phrases[y].update(phrases_of(words, entries))
    lex = Lexicon(entries, tuple(exceptions) + _exceptions({p: (n, phrases[1][p]) for p, n in phrases[0].items()}))
    a = lex.automaton()
    rows = [(hits(a, fold(text)), len(words), y) for words, y, text in kept]
    return _scaled(lex, [r for r in rows if r[0] > 0], total, odds_of_clean)


def _exceptions(counts: dict[str, tuple[int, int]]) -> tuple[str, ...]:
    return tuple(p for p, (c, n) in sorted(counts.items()) if c >= EXCEPTION_SUPPORT and c > EXCEPTION_RATIO * n)


def _scaled(lex: Lexicon, rows: list[tuple[float, int, int]], total: list[int], odds_of_clean: float | None) -> Lexicon:
    """The lexicon with its slope from (weight, words, label) of the texts that have a match."""
    if rows:
        y = np.array([r[2] for r in rows], float)
        ratio = (total[0] / total[1] if odds_of_clean is None else odds_of_clean) * total[1] / total[0]
        lex.slope = _logistic(np.array([(1.0, *features(t, n)) for t, n, _ in rows]), y, np.where(y == 1, 1.0, ratio))
    return lex


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Gradient descent with a pull to a scale on which a few sure matches speak for themselves."""
    start = np.array([-2.0, 1.5, 0.5])
    w, n = start.copy(), weight.sum()
    for _ in range(4000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - 0.2 * (x.T @ (weight * (p - y)) / n + 0.003 * (w - start))
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def scored(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_i, _x, score): each row's id, hash of its text, and toxicity from 0 to 1. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    src = docs.select(F.col(id_col).alias("_i"), F.xxhash64(common.text_of(text_col)).alias("_x"), common.text_of(text_col).alias("_t"))
    made: dict[str, ahocorasick.Automaton] = {}

    def run(b: pa.RecordBatch) -> dict:
        lex = shared.value
        a = made.get("a") or made.setdefault("a", lex.automaton())
        out = []
        for t in b.column("_t").to_pylist():
            f = fold(t)
            total = hits(a, f)
            out.append(probability(lex.slope, total, len(words_of(f)) if total else 0))
        return {"_i": b.column("_i"), "_x": b.column("_x"), "score": pa.array(out, pa.float64())}

    kind = src.schema["_i"].dataType.simpleString()
    return common.map_text(src, run, f"_i {kind}, _x long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, parts: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of each row, by a lexicon learned from at most `sample` labelled documents of either
    class outside the held-out fold (crc32 of the id as text modulo parts).

    A null or empty text has the score of a text without matches. Without labels of both classes no entry is
    learned, and all texts have that score. Rows without an id or a label are scored, not learned from. Repeated rows are
    scored each; an empty table gives an empty result. A long text is scored whole, in time about linear in its length.
    Ids may be of any type; columns of other names are ignored. Of rows that repeat an id the larger label and the
    smaller text count.
    """
    lex = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample, parts=parts, held=held)
    got = scored(docs, lex, id_col=id_col, text_col=text_col)
    return got.select(F.col("_i").alias(id_col), (common.fold_of("_i", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _counted(sample: DataFrame, names_of: Callable[[str], set[str]]) -> DataFrame:
    """(_e, _c, _n): in how many clean and toxic texts of the sample each name is. Counts are combined in the tasks and before the shuffle."""

    def out(held: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"_e": pa.array(list(held), pa.string()), "_c": pa.array([v[0] for v in held.values()], pa.int64()), "_n": pa.array([v[1] for v in held.values()], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column("_t").to_pylist(), b.column("_y").to_pylist()):
                for e in names_of(t):
                    held.setdefault(e, [0, 0])[y] += 1
                if len(held) > HELD:
                    yield out(held)
                    held = {}
        yield out(held)

    return sample.select("_t", "_y").mapInArrow(run, "_e string, _c long, _n long").groupBy("_e").agg(F.sum("_c").alias("_c"), F.sum("_n").alias("_n"))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, parts: int = 3, held: int = 1, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """learn() from at most `sample` labelled documents of either class outside the held-out fold.

    The texts stay in Spark. To the driver come the entries and phrases that pass the thresholds, and two numbers for each
    sampled document with a match. The shares of the classes are those of the labels outside the held-out fold.
    """
    common.small_batches(docs.sparkSession)
    texts, shares = common.labelled_rows(docs, labels, "toxic", common.fold_of("_id", parts) != held, sample, id_col=id_col, text_col=text_col)
    total = [0, 0]
    for r in texts.groupBy("_y").count().collect():
        total[r._y] = r["count"]
    if not total[0] or not total[1]:
        return Lexicon(exceptions=exceptions)
    found = _counted(texts, lambda t: entries_of(words_of(fold(t)))).where((F.col("_n") >= SUPPORT) & (F.col("_n") * total[0] >= RATIO * F.col("_c") * total[1]))
    entries = choose({r._e: (r._c, r._n) for r in found.collect()}, *total)
    spared = _counted(texts, lambda t: phrases_of(words_of(fold(t)), entries)).where((F.col("_c") >= EXCEPTION_SUPPORT) & (F.col("_c") > EXCEPTION_RATIO * F.col("_n")))
    lex = Lexicon(entries, tuple(exceptions) + _exceptions({r._e: (r._c, r._n) for r in spared.collect()}))
    made: dict[str, ahocorasick.Automaton] = {}

    def measure(b: pa.RecordBatch) -> dict:
        a = made.get("a") or made.setdefault("a", lex.automaton())
        folded = [fold(t) for t in b.column("_t").to_pylist()]
        return {"_k": b.column("_k"), "_y": b.column("_y"), "_w": pa.array([hits(a, f) for f in folded], pa.float64()), "_m": pa.array([len(words_of(f)) for f in folded], pa.int64())}

    rows = common.map_text(texts, measure, "_k string, _y int, _w double, _m long").where("_w > 0").collect()
    return _scaled(lex, [(r._w, r._m, r._y) for r in sorted(rows, key=lambda r: r._k)], total, shares[0] / shares[1])


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns, whatever their names.

    Null and empty texts stay, repeated rows stay or go alike, and an empty table gives an empty result.
    """
    got = scored(docs, fit(docs, labels, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
    bad = got.where(F.col("score") >= threshold).select("_i", "_x").distinct().withColumn("_k", F.lit(False))
    return common.keep_rows(docs, bad, id_col, text_col, 500_000)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
