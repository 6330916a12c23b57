"""Operator 3: language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER bytes long holds how often each byte followed. A byte's code
length in a context is -log2(count / (total + kinds)) if it was seen there, else that of an escape, -log2(kinds /
(total + kinds)), plus its code length in the context without its first byte; below the empty context all bytes weigh
alike (escape method C). Trees are frozen after learning, so the lengths of all n-grams are tabled once for all languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexmat.llm import common, shingles

#: Documents and bytes of each language that its tree is learned from.
SAMPLE, SAMPLE_BYTES = 400, 400_000
#: Languages up to which their counts and samples' ids are broadcast.
LANGUAGES = 1000
ORDER = 3
UNDETERMINED = "und"
_PAD = "   "
#: ASCII signs and digits read as spaces.
_READ = np.array([i if i >= 128 or chr(i).isalpha() else 32 for i in range(256)], np.uint8)
_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts in lower case, letters and spaces alone, each with a context of spaces before it."""
    data, off = shingles.raw(pc.binary_join_element_wise(_PAD, pc.utf8_lower(pc.fill_null(texts, "")), ""))
    return _READ[data], off


def _grams(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each byte of the texts, as one number; the earliest byte is the lowest one."""
    keep = np.ones(len(data), bool)
    for i in range(len(_PAD)):
        keep[off[:-1] + i] = False
    at = np.flatnonzero(keep)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    four = np.ndarray((len(data) + 1,), "<u4", padded, 0, (1,))
    return four[at - (n - 1)] & np.uint32((1 << 8 * n) - 1)


class Table:
    """Rows by 32-bit key, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.key = np.zeros(1 << self.bits, np.int64) - 1
        self.row = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[left[free]]
            self.row[slot[free]] = left[free]
            lost = self.key[slot] != keys[left]
            # Of keys that met in a free slot the last one stays; its row must be its own.
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        slot = self._slot(keys)
        there = self.key[slot]
        out = np.where(there == keys, self.row[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.key[slot[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.row[slot[open_[same]]]
            open_ = open_[~same & (there >= 0)]
        return out


@dataclass
class Model:
    """Of each order: the seen n-grams with their code lengths, and the seen contexts with those of an escape, by language."""

    languages: list[str]
    grams: list[Table]
    lengths: list[np.ndarray]
    contexts: list[Table]
    escapes: list[np.ndarray]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language's tree."""
        data, off = _bytes(texts)
        size = np.diff(off) - len(_PAD)
        ends = np.concatenate(([0], np.cumsum(size)))
        total = np.zeros((len(size), len(self.languages)))
        if ends[-1] == 0:
            return total
        some = np.flatnonzero(size > 0)
        key = _grams(data, off, ORDER + 1)
        row = self.grams[ORDER].find(key)
        extra = np.zeros((1, len(self.languages)), np.float32)
        table = np.concatenate((self.lengths[ORDER], extra))
        lost = np.flatnonzero(row < 0)
        for i in range(len(self.languages)):
            bits = np.take(table[:, i], row)  # row -1 is the last, of no bits
            total[some, i] = np.add.reduceat(bits, ends[some], dtype=np.float64)
        if len(lost):
            # These bytes were seen in no language after the whole context: escape to shorter ones.
            bits = np.zeros((len(lost), len(self.languages)), np.float32)
            key, left = key[lost], np.arange(len(lost))
            for order in range(ORDER, -1, -1):
                context = self.contexts[order].find(key & np.uint32((1 << 8 * order) - 1))
                bits[left[context >= 0]] += self.escapes[order][context[context >= 0]]
                key = key >> np.uint32(8)
                if order == 0:
                    bits[left] += 8
                    break
                row = self.grams[order - 1].find(key)
                bits[left[row >= 0]] += self.lengths[order - 1][row[row >= 0]]
                key, left = key[row < 0], left[row < 0]
            np.add.at(total, np.searchsorted(ends, lost, side="right") - 1, bits)
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Each text's language of the least code length, and that language's share of 2 ** -bits over all."""
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        letters = has_letter(texts)
        return [self.languages[b] if y else UNDETERMINED for b, y in zip(best.tolist(), letters)], np.where(letters, score, 0.0)


def has_letter(texts: pa.Array) -> list[bool]:
    data, off = shingles.raw(texts)
    n = np.concatenate(([0], np.cumsum(_LETTER[data])))
    out = (n[off[1:]] > n[off[:-1]]).tolist()
    for i, t in enumerate(texts.to_pylist()):
        if not out[i] and t:
            out[i] = any(map(str.isalpha, t))
    return out


def learn(samples: dict[str, list[str]]) -> Model | None:
    """Trees of the languages, from their texts."""
    languages = sorted(samples)
    if not languages:
        return None
    data = [_bytes(pa.array(samples[x], pa.string())) for x in languages]
    model = Model(languages, [], [], [], [])
    for order in range(ORDER + 1):
        mask = np.uint32((1 << 8 * order) - 1)
        own = [np.unique(_grams(d, off, order + 1), return_counts=True) for d, off in data]
        keys = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(keys & mask)
        lengths = np.zeros((len(keys), len(languages)), np.float32)
        escapes = np.zeros((len(contexts), len(languages)), np.float32)
        of = np.searchsorted(contexts, keys & mask)
        lower = None
        if order:
            lower = model.lengths[order - 1][model.grams[order - 1].find(keys >> np.uint32(8))]
        for i, (k, c) in enumerate(own):
            count = np.zeros(len(keys))
            count[np.searchsorted(keys, k)] = c
            total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, count > 0, len(contexts))
            seen = kinds > 0
            escapes[seen, i] = np.log2((total + kinds)[seen] / kinds[seen])
            base = lower[:, i] if order else np.full(len(keys), 8.0)
            lengths[:, i] = np.where(count > 0, -np.log2(np.maximum(count, 1) / np.maximum(total + kinds, 1)[of]), escapes[of, i] + base)
        model.grams.append(Table(keys.astype(np.int64)))
        model.lengths.append(lengths)
        model.contexts.append(Table(contexts.astype(np.int64)))
        model.escapes.append(escapes)
    return model


def training_texts(docs: DataFrame, train, *, id_col: str, text_col: str, lang_col: str, sample: int, sample_bytes: int) -> dict[str, list[str]]:
    """Of each language the texts of at most `sample` training rows, in the order of a hash of their ids, as long as they come to
    at most sample_bytes; of a language whose first text alone is longer, that many characters of it.

    Languages are counted first; from the counts a threshold on the hash follows for each, so that about 1.5 times the
    sample of narrow rows is ranked. Only the picked texts are read then. To the driver come sample_bytes a language.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_l")).where(F.col("_id").isNotNull() & F.col("_l").isNotNull()).where(train)
    counts = common.small(common.stored(rows.groupBy("_l").agg(F.count(F.lit(1)).alias("_c")).select(F.col("_l").alias("_cl"), "_c"), "languages"), LANGUAGES)
    h = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    near = rows.withColumn("_h", h).join(counts, F.col("_l") == F.col("_cl")).where(F.col("_h") * F.col("_c") < (1.5 * sample + 30) * (1 << 30)).select("_id", "_l", "_h").distinct()
    ranked = near.withColumn("_n", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_id"))).where(F.col("_n") <= sample).select(F.col("_id").alias("_pid"), F.col("_l").alias("_pl"), "_n")
    picked = common.small(common.stored(ranked, "picked"), LANGUAGES * sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_l"), common.text_of(text_col).alias("_t"))
    texts = texts.join(picked, (F.col("_id") == F.col("_pid")) & (F.col("_l") == F.col("_pl"))).groupBy("_l", "_n").agg(F.min("_t").alias("_t"))
    upto = F.sum(F.octet_length("_t")).over(Window.partitionBy("_l").orderBy("_n"))
    first = F.row_number().over(Window.partitionBy("_l").orderBy("_n")) == 1
    kept = texts.select("_l", "_n", "_t", (upto <= sample_bytes).alias("_in"), first.alias("_first")).where("_in or _first")
    kept = kept.select("_l", "_n", F.when(F.col("_in"), F.col("_t")).otherwise(F.substring("_t", 1, sample_bytes)).alias("_t"))
    out: dict[str, list[str]] = {}
    for r in sorted(kept.collect(), key=lambda r: (r._l, r._n)):
        out.setdefault(r._l, []).append(r._t)
    return out


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, parts: int = 3, held: int = 1) -> DataFrame:
    """(id, held_out, lang_pred, score) of each row, by trees learned from bounded samples of the rows that have a language and
    are not in the held-out fold (crc32 of the id as text modulo parts).

    The language is `und` and the score 0 if the text is null or has no letter, or if nothing could be learned. Rows
    with a null id are predicted but not learned from. Ties go to the first language by name; of rows that repeat an id
    and a language the smallest text is learned. Repeated rows are predicted each; an empty table gives an empty
    result. A long text is scored whole. Ids may be of any type; other columns, whatever their names, are ignored.
    Scoring is one pass without a shuffle.
    """
    train = common.fold_of("_id", parts) != held
    model = learn(training_texts(docs, train, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample, sample_bytes=sample_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("_i"), common.text_of(text_col).alias("_t"))

    def run(b: pa.RecordBatch) -> dict:
        lang, score = shared.value.predict(b.column("_t")) if shared.value else ([UNDETERMINED] * b.num_rows, np.zeros(b.num_rows))
        return {"_i": b.column("_i"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    kind = src.schema["_i"].dataType.simpleString()
    got = common.map_text(src, run, f"_i {kind}, lang_pred string, score double")
    return got.select(F.col("_i").alias(id_col), (common.fold_of("_i", parts) == held).alias("held_out"), "lang_pred", "score")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
