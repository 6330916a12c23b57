"""Operator 4: quality by pooled random-indexing word vectors and a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common, shingles
from plexmat.llm.shingles import U, mix

#: Labelled documents of each class that the vectors and the network are learned from.
SAMPLE = 3000
THRESHOLD = 0.7
#: Vectors that the words share by their hash, half their length, words on either side that make a word's context.
WORDS, DIM, NEAR = 1 << 14, 48, 2
#: Entries of an index vector.
ENTRIES = 4
#: Words of a text that are worked on at once.
STEP = 1 << 18
#: Words whose sums travel as one row.
BLOCK = 256
HIDDEN, EPOCHS, BATCH = 32, 60, 64
FAR = 6.0
#: Runs of letters and digits are words, and so are runs of the other signs.
_SIGN = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


def tokens(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of the texts (words and runs of signs in turn), and the texts' offsets. Case matters."""
    data, off = shingles.raw(texts)
    h1, s1, _ = shingles.spans(data, off, shingles.IN_WORD)
    h2, s2, _ = shingles.spans(data, off, _SIGN)
    at = np.concatenate((s1, s2))
    order = np.argsort(at, kind="stable")
    return (np.concatenate((h1, h2))[order] % U(words)).astype(np.int64), np.searchsorted(at[order], off)


def index_entries(n: int = WORDS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ENTRIES entries of +1 or -1 that each word's sparse random index vector is the sum of, from a hash."""
    h = mix(np.arange(n, dtype=U)[:, None] * U(8) + np.arange(ENTRIES, dtype=U))
    return (h % U(dim)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


def index_vectors(n: int = WORDS, dim: int = DIM) -> np.ndarray:
    at, sign = index_entries(n, dim)
    out = np.zeros((n, dim), np.float32)
    np.add.at(out, (np.repeat(np.arange(n), ENTRIES), at.ravel()), sign.ravel())
    return out


def contexts(texts: pa.Array, at: np.ndarray, sign: np.ndarray, into: np.ndarray) -> None:
    """Add to each word's row the index vectors of the words up to NEAR places from it in the texts. Whole numbers, so their order is free."""
    words, dim = into.shape
    t, off = tokens(texts, words)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for s in range(0, len(t), STEP):
        for d in range(1, NEAR + 1):
            end = min(s + STEP, len(t) - d)
            same = np.flatnonzero(doc[s:end] == doc[s + d : end + d]) + s
            x, y = np.concatenate((t[same], t[same + d])), np.concatenate((t[same + d], t[same]))
            for k in range(ENTRIES):
                into += np.bincount(x * dim + at[y, k], sign[y, k], words * dim).astype(np.int64).reshape(words, dim)


def with_contexts(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Each word's index vector beside the direction of its context."""
    length = np.linalg.norm(context.astype(np.float64), axis=1, keepdims=True)
    return np.concatenate((index / 2, context / np.maximum(length, 1)), axis=1).astype(np.float32)


def word_vectors(docs: DataFrame, text_col: str, words: int, dim: int) -> np.ndarray:
    """with_contexts() of the sums over all texts of docs: one pass without labels, summed in each task, then by blocks of words."""
    common.small_batches(docs.sparkSession)
    at, sign = index_entries(words, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((words, dim), np.int64)
        for batch in batches:
            for part in common.slices(batch, "_t"):
                contexts(part.column("_t"), at, sign, own)
        some = [i for i in range(0, words, BLOCK) if own[i : i + BLOCK].any()]
        yield pa.RecordBatch.from_pydict({"_b": pa.array(some, pa.int32()), "_v": pa.array([own[i : i + BLOCK].tobytes() for i in some], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("_b").to_pylist(), batch.column("_v").to_pylist()):
                v = np.frombuffer(v, np.int64)
                held[i] = held[i] + v if i in held else v
        yield pa.RecordBatch.from_pydict({"_b": pa.array(list(held), pa.int32()), "_v": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    got = docs.select(common.text_of(text_col).alias("_t")).mapInArrow(run, "_b int, _v binary").repartition("_b").mapInArrow(add, "_b int, _v binary")
    context = np.zeros((words, dim), np.int64)
    for r in got.collect():
        context[r._b : r._b + BLOCK] = np.frombuffer(r._v, np.int64).reshape(-1, dim)
    return with_contexts(index_vectors(words, dim), context)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Of each text: the mean of its words' vectors, the mean of their squares, of the products of neighbours, and its log length."""
    t, off = tokens(texts, len(vectors))
    dim = vectors.shape[1]
    half = dim // 2
    out = np.zeros((len(off) - 1, dim * 2 + half + 1), np.float32)
    n = np.diff(off)
    step = 1 << 14  # words of a run
    for i in np.flatnonzero(n).tolist():
        a, b = off[i], off[i + 1]
        for s in range(a, b, step):
            v = vectors[t[s : min(s + step + 1, b)]]
            u = v[:step]
            out[i, :dim] += u.sum(axis=0)
            out[i, dim : 2 * dim] += np.einsum("ij,ij->j", u, u)
            out[i, 2 * dim : 2 * dim + half] += np.einsum("ij,ij->j", v[:-1, :half], v[1:, :half])
    out[:, :-1] /= np.maximum(n, 1)[:, None]
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    shift: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(_standard(x, self.mean, self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x).astype(np.float64) / self.temperature + self.shift)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.probabilities(pooled(texts, self.vectors))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features by their deviation in the sample, but no further out than FAR: a text unlike all of the sample isn't decided by one feature."""
    return np.clip((x - mean) / scale, -FAR, FAR)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, shares: tuple[int, int], seed: int = 7) -> Model | None:
    """The network from four fifths of the pooled texts x (Adam, weight decay), the temperature from the rest.

    Classes weigh alike in training. The logits are then shifted by the log odds of `shares`, the numbers of rows of
    class 0 and 1 that the sample stands for, and the temperature makes the held fifth likeliest with its classes
    weighted to these shares; so a score is a share of documents like the training rows.
    """
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(y)) % 5 == 0
    if len(set(y[fold].tolist())) < 2 or len(set(y[~fold].tolist())) < 2:
        fold[:] = False
    mean, scale = x[~fold].mean(axis=0), x[~fold].std(axis=0) + 1e-3
    z, t = _standard(x[~fold], mean, scale), y[~fold]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-6), 0.5 / max(1 - t.mean(), 1e-6)).astype(np.float32)
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32), np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for s in range(0, len(t), BATCH):
            i = order[s : s + BATCH]
            h = z[i] @ p[0] + p[1]
            a = np.maximum(h, 0)
            g = (_sigmoid(a @ p[2] + p[3]) - t[i]) * weight[i] / len(i)
            back = np.outer(g, p[2]) * (h > 0)
            step += 1
            for j, d in enumerate((z[i].T @ back + 1e-4 * p[0], back.sum(axis=0), a.T @ g + 1e-4 * p[2], g.sum(keepdims=True))):
                m[j] = 0.9 * m[j] + 0.1 * d
                v[j] = 0.999 * v[j] + 0.001 * d * d
                p[j] = p[j] - 3e-3 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0, float(np.log(shares[1] / shares[0])))
    if fold.any():
        logit, truth = model.logits(x[fold]).astype(np.float64), y[fold]
        own = np.where(truth == 1, shares[1] / max(truth.sum(), 1), shares[0] / max((1 - truth).sum(), 1))
        grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
        q = [np.clip(_sigmoid(logit / c + model.shift), 1e-6, 1 - 1e-6) for c in grid]
        model.temperature = float(grid[int(np.argmin([-np.sum(own * (truth * np.log(a) + (1 - truth) * np.log(1 - a))) for a in q]))])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, parts: int = 4, held: int = 2, words: int = WORDS, dim: int = DIM) -> Model | None:
    """learn() from at most `sample` labelled documents of either class outside the held-out fold, with word vectors of all documents.

    The texts stay in Spark; to the driver come `words` vectors and one pooled vector for each sampled document.
    """
    texts, shares = common.labelled_rows(docs, labels, "quality", common.fold_of("_id", parts) != held, sample, id_col=id_col, text_col=text_col)
    if not all(shares):
        return None
    vectors = word_vectors(docs, text_col, words, dim)

    def run(b: pa.RecordBatch) -> dict:
        return {"_k": b.column("_k"), "_y": b.column("_y"), "_v": pa.array([v.tobytes() for v in pooled(b.column("_t"), vectors)], pa.binary())}

    rows = sorted(common.map_text(texts, run, "_k string, _y int, _v binary").collect(), key=lambda r: r._k)
    return learn(np.array([np.frombuffer(r._v, np.float32) for r in rows]), np.array([r._y for r in rows], np.float32), vectors, shares)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, parts: int = 4, held: int = 2, threshold: float = THRESHOLD, words: int = WORDS, dim: int = DIM) -> DataFrame:
    """(id, held_out, score, predicted) of each row, by a model learned from at most `sample` labelled documents of either class
    outside the held-out fold (crc32 of the id as text modulo parts). Words share `words` vectors of 2 * `dim` numbers by their hash.

    A null text counts as empty; an empty text is scored as one of no words. Without labels of both classes every
    score is 0.5. Rows without an id or a label are scored, not learned from; of rows that repeat an id the larger label
    and the smaller text count. Repeated rows are scored each; an empty table gives an empty result. A long text is pooled
    whole, in runs of bounded memory. Ids may be of any type; other columns, whatever their names, are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample, parts=parts, held=held, words=words, dim=dim)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("_i"), common.text_of(text_col).alias("_t"))

    def run(b: pa.RecordBatch) -> dict:
        s = shared.value.scores(b.column("_t")) if shared.value else np.full(b.num_rows, 0.5)
        return {"_i": b.column("_i"), "score": pa.array(s, pa.float64())}

    kind = src.schema["_i"].dataType.simpleString()
    got = common.map_text(src, run, f"_i {kind}, score double")
    return got.select(F.col("_i").alias(id_col), (common.fold_of("_i", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
