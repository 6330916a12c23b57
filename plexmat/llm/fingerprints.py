"""Operator 1: document fingerprints by consistent weighted sampling.

For an element of weight w, sample k draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a hash of the element and k, and
takes t = floor(ln w / r + b), ln a = ln c - r * (t - b + 1). The element and t of the least a are the sample: two
weighted sets agree in it with probability sum(min(w, v)) / sum(max(w, v)) (Ioffe, 2010).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common, shingles
from plexmat.llm.shingles import U, mix

#: Samples of a fingerprint, each kept as 16 bits of its sample's hash.
SAMPLES = 64
#: Elements that one step of the kernel draws for, so that its arrays stay in a core's cache.
_STEP = 16384


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at n even steps, from its distribution function 1 - (1 + x) exp(-x)."""
    u = (np.arange(n) + 0.5) / n
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = 1 - (1 + mid) * np.exp(-mid) < u
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


#: Of an element's 32 bits for a sample, 16 give ln c, 10 give r and 6 give b.
_R = np.repeat(_gamma2(1024), 64).astype(np.float32)
_B = np.tile((np.arange(64) + 0.5) / 64, 1024).astype(np.float32)
_R1B = _R * (1 - _B)
_LNC = np.log(_gamma2(65536)).astype(np.float32)


def draws(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """ln a of sample k for each weighted element. Its bits also name the pair of element and t."""
    e = elements.astype(np.uint32)
    salt = np.uint32(int(mix(np.array([k + 0x51ED], U))[0]) & 0xFFFFFFFF)
    out = np.empty(len(e), np.float32)
    for s in range(0, len(e), _STEP):
        x = e[s : s + _STEP] ^ salt
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x27D4EB2F)
        x ^= x >> np.uint32(15)
        hi, lo = (x >> np.uint32(16)).astype(np.intp), (x & np.uint32(0xFFFF)).astype(np.intp)
        a = np.take(_LNC, hi, mode="clip")
        a -= np.take(_R1B, lo, mode="clip")
        w = weights[s : s + _STEP]
        heavy = np.flatnonzero(w != 1)
        if len(heavy):
            r, b = _R[lo[heavy]], _B[lo[heavy]]
            a[heavy] = _LNC[hi[heavy]] - r * (np.floor(np.log(w[heavy]).astype(np.float32) / r + b) - b + 1)
        out[s : s + _STEP] = a
    return out


def signatures(elements: np.ndarray, weights: np.ndarray, off: np.ndarray, samples: int = SAMPLES, members: np.ndarray | None = None) -> np.ndarray:
    """16-bit samples, a row for each set; a set without elements has zeros.

    Sets are the segments off of elements, or of members, which are then places in elements.
    """
    out = np.zeros((len(off) - 1, samples), np.uint16)
    has = np.flatnonzero(np.diff(off) > 0)
    if len(has) == 0:
        return out
    starts = off[has]
    for k in range(samples):
        a = draws(elements, weights, k)
        least = np.minimum.reduceat(a if members is None else np.take(a, members), starts)
        out[has, k] = (mix(least.view(np.uint32).astype(U)) >> U(48)).astype(np.uint16)
    return out


def fingerprint_texts(texts: pa.Array, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each text's five-word shingles, weighted by their counts, and whether it has any.

    Elements that several of the texts share are drawn for once.
    """
    values, counts, off = shingles.shingles(texts)
    with np.errstate(over="ignore"):
        key = mix(values + counts.astype(U) * U(0xD1342543DE82EF95))
    _, first, members = np.unique(key, return_index=True, return_inverse=True)
    return signatures(values[first], counts[first].astype(np.float64), off, samples, members), np.diff(off) > 0


def as_string(row: np.ndarray, full: bool) -> str:
    return row.astype(">u2").tobytes().hex() if full else ""


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of each row: samples * 4 hex digits; the empty string for a null or empty text.

    One pass over the rows without a shuffle. Repeated rows give repeated results, an empty table none. Long texts count
    whole. Ids may be of any type; other columns, whatever their names, are ignored.
    """
    src = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_t"))

    def run(b: pa.RecordBatch) -> dict:
        sig, full = fingerprint_texts(b.column("_t"), samples)
        return {"_id": b.column("_id"), "fingerprint": pa.array([as_string(*x) for x in zip(sig, full.tolist())], pa.string())}

    kind = src.schema["_id"].dataType.simpleString()
    return common.map_text(src, run, f"_id {kind}, fingerprint string").withColumnRenamed("_id", id_col)


def likeness(a: np.ndarray, fa: bool, b: np.ndarray, fb: bool) -> float:
    """Share of equal samples; 1 for two empty sets, 0 for one."""
    return float(np.mean(a == b)) if fa and fb else float(fa == fb)


def ordered_with_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """(_p, _id, _t, _guest): rows dealt by ranges of descending (id, hash of the text), each range in its order within one
    partition, with the first row of the range that follows (after the last: of the first) as its last row, marked as guest.

    The ranges are those into which Spark deals the narrow keys; each range's first key comes to the driver (`parts`
    rows) and goes to the tasks as one array, in which a row finds its range by binary search. A repeated id is parted by
    its texts' hashes, so only rows that repeat id and text stay together. The texts are shuffled once.
    """
    key = F.struct(F.col("_id").alias("i"), F.xxhash64("_t").alias("h"))
    base = docs.select(F.col(id_col).alias("_id"), common.text_of(text_col).alias("_t")).withColumn("_k", key)
    ranges = base.select("_k").repartitionByRange(parts, F.col("_k").desc())
    firsts = sorted((r._f for r in ranges.groupBy(F.spark_partition_id().alias("_p")).agg(F.max("_k").alias("_f")).collect()), key=lambda f: (f.i is not None, f.i if f.i is not None else 0, f.h), reverse=True)
    if not firsts:
        return base.select(F.lit(0).alias("_p"), "_id", "_t", F.lit(False).alias("_guest"))
    kind = base.schema["_k"].dataType.simpleString()
    known = docs.sparkSession.createDataFrame([(firsts,)], f"_firsts array<{kind}>")
    steps = F.array(*(F.lit(1 << i) for i in range(len(firsts).bit_length() - 1, -1, -1)))
    # Number of first keys from the row's own on, less one.
    upto = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(firsts)) & (F.get("_firsts", at + s - 1) >= F.col("_k")), at + s).otherwise(at))
    own = base.join(F.broadcast(known)).withColumn("_p", upto - 1)
    home = F.array(F.struct(F.col("_p").alias("p"), F.lit(False).alias("g")))
    host = F.pmod(F.col("_p") - 1, F.lit(len(firsts)))
    homes = F.when(F.get("_firsts", "_p") == F.col("_k"), F.concat(home, F.array(F.struct(host.alias("p"), F.lit(True).alias("g"))))).otherwise(home)
    dealt = own.select(F.explode(homes).alias("_h"), "_id", "_k", "_t").select(F.col("_h.p").alias("_p"), "_id", "_k", "_t", F.col("_h.g").alias("_guest"))
    return dealt.repartitionById(len(firsts), F.col("_p")).sortWithinPartitions("_guest", F.col("_k").desc(), "_t").drop("_k")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """Every row's fingerprint beside that of its edited text: the last floor(n / 3) code points replaced by the first as many
    (or all) of the next row in descending id, the first row's after the last.

    Null text counts as empty. Rows of one id follow in the order of a hash of their texts; null ids come last. A single row
    is its own next. Two empty texts have likeness 1, an empty and another 0. A long text counts whole. An empty table
    gives an empty result. Ids may be of any type that has an order; other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = ordered_with_next(docs, id_col, text_col, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def kernel(ids: list, texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        """Results of all but the last row."""
        n = len(ids) - 1
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:])]
        both, some = fingerprint_texts(pa.array(texts + edited, pa.string()), samples)
        (sig, esig), (full, efull) = np.split(both, [n + 1]), np.split(some, [n + 1])
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids[:n], kind),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([as_string(sig[i], full[i]) for i in range(n)], pa.string()),
            "edited_fingerprint": pa.array([as_string(esig[i], efull[i]) for i in range(n)], pa.string()),
            "near_edited": pa.array([likeness(sig[i], full[i], esig[i], efull[i]) for i in range(n)], pa.float64()),
            "near_next": pa.array([likeness(sig[i], full[i], sig[i + 1], full[i + 1]) for i in range(n)], pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, total, guests, kind = [], [], 0, 0, pa.int64()
        for batch in batches:
            kind = batch.column("_id").type
            for i, t, g in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist(), batch.column("_guest").to_pylist()):
                guests += g
                if guests > 1:  # rows that share the first key are the same: one of them is the next one
                    continue
                ids.append(i)
                texts.append(t)
                total += len(t)
                if total > common.CHUNK_BYTES and len(ids) > 1:
                    yield kernel(ids, texts, kind)
                    ids, texts, total = ids[-1:], texts[-1:], len(t)
        if len(ids) > 1:
            yield kernel(ids, texts, kind)

    return rows.mapInArrow(run, f"doc_id {rows.schema['_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
