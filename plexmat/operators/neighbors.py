"""Nearest neighbours between modalities: exact and bucketed search, capped in-degrees, mutual neighbours, and kernel weights."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexmat.functions.rank import rank_zscores
from plexmat.functions.scalar import round_unit_value
from plexmat.sources.modality import Modality, same_ids
from plexmat.sources.shared import Scratch, small, small_batches, stored

#: Bytes of dense and of sparse source vectors up to which they are broadcast whole; more are searched block by block.
BROADCAST_BYTES, SPARSE_BYTES = 256 << 20, 64 << 20
#: Rows of a block of sources, and of a slice of targets that meet it in one task, and bytes of a slice; a block has twice as many at most.
SOURCES, TARGETS, TASK_BYTES = 65536, 16384, 32 << 20
#: Bytes of a dense block that a kernel makes of rows, and sources and targets that it takes at a time.
DENSE_BYTES, BLOCK, AT_ONCE = 32 << 20, 4096, 256
#: Products of sparse entries that a kernel makes at a time, and how many cells of a dense product take the time of one.
PRODUCTS, DENSE_GAIN = 1 << 18, 32
#: Whether a metric's highest scores come first.
METRICS = {"dot": True, "euclidean": False, "angular": False, "manhattan": False, "hamming": False}
#: Lists of the bucketed search at most.
LISTS = 4096
#: Features up to which their places are broadcast.
BROADCAST_ROWS = 500_000
#: What a block of sources and a slice of targets that meet have in common.
PAIR = ("_list", "_block", "_slice")
EDGES = "target_id long, source_id long, rn int, score double"


def vectors(scores: DataFrame, value: str = "z") -> DataFrame:
    """(cell_id, vec) from long scores: the values in order of feature id; cells with nulls are left out."""
    got = scores.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("feat_id", value))).alias("_v"), F.count(F.lit(1)).alias("_n"), F.count(value).alias("_m"))
    return got.where(F.col("_n") == F.col("_m")).select("cell_id", F.transform("_v", lambda x: x[value]).alias("vec"))


def sparse_vectors(scores: DataFrame, features: DataFrame, value: str, base: str | None = None) -> DataFrame:
    """(cell_id, idx, vec, base, width) from long scores: the places in the order of feature ids that a cell has values at, these, and
    the value that all other places have (a column that is the same in all rows of a cell; by default 0)."""
    ids = stored(features.select("feat_id").withColumn("idx", (F.row_number().over(Window.orderBy("feat_id")) - 1).cast("int")), "places")
    width = ids.count()
    placed = scores.where(F.col(value).isNotNull()).join(small(ids, BROADCAST_ROWS), "feat_id")
    rest = F.first(base) if base else F.lit(0.0)
    got = placed.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("_v"), rest.alias("base"))
    return got.select("cell_id", F.transform("_v", lambda x: x["idx"]).alias("idx"), F.transform("_v", lambda x: x["v"]).alias("vec"), "base", F.lit(width).alias("width"))


def score_vectors(m: Modality | DataFrame, sign: int = 1) -> DataFrame:
    """The cells' rank z-scores as vectors; of a sparse modality only what its zeros don't share. A table of long values is a dense one."""
    if isinstance(m, DataFrame):
        return vectors(rank_zscores(m, sign))
    return sparse_vectors(m.zscores(sign), m.features, "z", "zero") if m.sparse else vectors(m.zscores(sign))


def value_vectors(m: Modality) -> DataFrame:
    return sparse_vectors(m.values.where(F.col("value") != 0), m.features, "value") if m.sparse else vectors(m.values, "value")


def check_features(a: DataFrame, b: DataFrame) -> None:
    """Both tables (feat_id) must have the same features."""
    same_ids(a, b, "feat_id")


@dataclass
class Cells:
    """Vectors of cells in order of id, as one matrix or by the places that differ from the row's base."""

    ids: np.ndarray
    flat: np.ndarray
    width: int
    off: np.ndarray | None = None
    idx: np.ndarray | None = None
    base: np.ndarray | None = None
    _columns: dict = field(default_factory=dict)

    @staticmethod
    def of(t: pa.Table | pa.RecordBatch, key: str) -> Cells:
        t = t if isinstance(t, pa.Table) else pa.Table.from_batches([t])
        t = t.sort_by(key).combine_chunks()
        n = t.num_rows
        ids = t[key].to_numpy().astype(np.int64)
        lists = {c: (t[c].chunk(0) if t[c].num_chunks else None) for c in ("vec", "idx") if c in t.column_names}
        flat = lists["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False) if n else np.zeros(0)
        if "idx" not in lists:
            width = len(flat) // max(n, 1)
            if n and len(np.unique(np.diff(lists["vec"].offsets.to_numpy()))) != 1:
                raise ValueError("cells have different numbers of values; a modality with absent values is sparse")
            return Cells(ids, flat, width)
        size = np.diff(lists["vec"].offsets.to_numpy()) if n else np.zeros(0, np.int64)
        return Cells(ids, flat, int(t["width"][0].as_py()) if n else 0, np.concatenate(([0], np.cumsum(size))), lists["idx"].flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64), t["base"].to_numpy())

    def rows(self, a: int, b: int) -> np.ndarray:
        """Cells a to b as a dense matrix."""
        if self.off is None:
            return self.flat.reshape(len(self.ids), self.width)[a:b]
        out = np.repeat(self.base[a:b, None], self.width, axis=1)
        lo, hi = self.off[a], self.off[min(b, len(self.ids))]
        out[np.repeat(np.arange(len(out)), np.diff(self.off[a : b + 1])), self.idx[lo:hi]] = self.flat[lo:hi]
        return out


    def entries(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sparse cells a to b, each entry's row, place and difference from the row's base."""
        lo, hi = self.off[a], self.off[b]
        row = np.repeat(np.arange(b - a), np.diff(self.off[a : b + 1]))
        return row, self.idx[lo:hi], self.flat[lo:hi] - self.base[a:b][row]

    def columns(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """entries() by place: the places that have any, where each one's entries begin, and the entries' rows and differences."""
        if (a, b) not in self._columns:
            row, place, diff = self.entries(a, b)
            order = np.argsort(place, kind="stable")
            own, start = np.unique(place[order], return_index=True)
            self._columns[a, b] = own, np.append(start, len(order)), row[order].astype(np.int32), diff[order]
        return self._columns[a, b]

    def sums(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of sparse cells a to b, each one's sum and sum of squares over all places."""
        row, rest = np.repeat(np.arange(b - a), n := np.diff(self.off[a : b + 1])), self.base[a:b] * (self.width - n)
        flat = self.flat[self.off[a] : self.off[b]]
        return np.bincount(row, flat, b - a) + rest, np.bincount(row, flat * flat, b - a) + rest * self.base[a:b]


def _sparse_dots(t: Cells, i: int, j: int, s: Cells, a: int, b: int) -> np.ndarray | None:
    """Products of sparse cells i to j of t and a to b of s by the places where both have entries; None if a dense product is cheaper."""
    row, place, diff = t.entries(i, j)
    own, start, s_row, s_diff = s.columns(a, b)
    at = np.searchsorted(own, place)
    both = np.flatnonzero(at < len(own))
    both = both[own[at[both]] == place[both]]
    row, diff, at = row[both], diff[both], at[both]
    n = start[at + 1] - start[at]
    upto = np.concatenate(([0], np.cumsum(n)))
    if upto[-1] * DENSE_GAIN > (j - i) * (b - a) * t.width:
        return None
    # With v = base + diff, a product's sum is that of both diffs, and the bases' shares follow from the rows' sums.
    out = np.zeros((j - i) * (b - a))
    cuts = np.unique(np.concatenate((np.searchsorted(upto, np.arange(0, upto[-1], PRODUCTS)), [len(n)])))
    for x, y in zip(cuts[:-1], cuts[1:]):
        of = np.repeat(np.arange(x, y), n[x:y])
        to = start[at[of]] + np.arange(upto[x], upto[y]) - upto[of]
        out += np.bincount(row[of] * (b - a) + s_row[to], diff[of] * s_diff[to], len(out))
    t_sum, s_sum = t.sums(i, j)[0], s.sums(a, b)[0]
    return out.reshape(j - i, b - a) + t.base[i:j, None] * s_sum + (t_sum - t.width * t.base[i:j])[:, None] * s.base[a:b]


def _of_dots(metric: str, out: np.ndarray, tt: np.ndarray, mm: np.ndarray) -> np.ndarray:
    """The scores that follow from products and the rows' sums of squares."""
    if metric == "euclidean":
        return np.sqrt(np.maximum(tt[:, None] + mm - 2 * out, 0))
    if metric == "angular":
        size = np.sqrt(tt[:, None] * mm)
        return np.sqrt(np.maximum(2 - 2 * np.divide(out, size, out=np.zeros_like(out), where=size > 0), 0))
    return out


def _block_scores(metric: str, t: Cells, i: int, j: int, s: Cells, a: int, b: int) -> np.ndarray:
    """Scores of cells i to j of t by cells a to b of s, rounded to nine places; no dense part has over DENSE_BYTES, or more than a row."""
    if t.off is not None and s.off is not None and metric not in ("manhattan", "hamming"):
        if (out := _sparse_dots(t, i, j, s, a, b)) is not None:
            return np.round(_of_dots(metric, out, t.sums(i, j)[1], s.sums(a, b)[1]), 9)
    step = max(1, DENSE_BYTES // (8 * max(s.width, 1)))
    out = np.empty((j - i, b - a))
    for x in range(i, j, step):
        rows = t.rows(x, min(x + step, j))
        for y in range(a, b, step):
            out[x - i : x - i + step, y - a : y - a + step] = _scores(metric, rows, s.rows(y, min(y + step, b)))
    return out


def _scores(metric: str, t: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of t by rows of m, rounded to nine places."""
    if metric == "manhattan":
        out = np.stack([np.abs(m - x).sum(axis=1) for x in t])
    elif metric == "hamming":
        out = np.stack([(m != x).sum(axis=1).astype(np.float64) for x in t])
    else:
        out = t @ m.T if metric == "dot" else _of_dots(metric, t @ m.T, (t * t).sum(1), (m * m).sum(1))
    return np.round(out, 9)


class Best:
    """The k best sources, of those added so far, of the cells i to j of t; ties go to the smaller source id."""

    def __init__(self, metric: str, k: int, t: Cells, i: int, j: int) -> None:
        self.metric, self.k, self.t, self.i, self.j = metric, k, t, i, j
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.most = np.full((j - i, 1), np.inf)

    @staticmethod
    def of(metric: str, k: int, t: Cells) -> list[Best]:
        """For AT_ONCE cells of t each."""
        return [Best(metric, k, t, i, min(i + AT_ONCE, len(t.ids))) for i in range(0, len(t.ids), AT_ONCE)]

    def add(self, s: Cells) -> None:
        if len(s.ids) and self.t.width != s.width:
            raise ValueError(f"vectors of {self.t.width} and of {s.width} values")
        sign = -1.0 if METRICS[self.metric] else 1.0
        for a in range(0, len(s.ids), BLOCK):
            key = sign * _block_scores(self.metric, self.t, self.i, self.j, s, a, min(a + BLOCK, len(s.ids)))
            n = min(self.k, key.shape[1])
            r, c = np.nonzero(key <= np.minimum(self.most, np.partition(key, n - 1, axis=1)[:, n - 1 : n]))
            r, ids, key = (np.concatenate(x) for x in zip(self.held, (r, s.ids[a + c], key[r, c])))
            order = np.lexsort((ids, key, r))
            r, ids, key = r[order], ids[order], key[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            self.held = tuple(x[place < self.k] for x in (r, ids, key))
            full = place == self.k - 1
            self.most[r[full], 0] = key[full]

    def edges(self) -> tuple[np.ndarray, ...]:
        """The targets, sources, places and scores."""
        r, ids, key = self.held
        return self.t.ids[self.i + r], ids, np.arange(len(r)) - np.searchsorted(r, r) + 1, (-1.0 if METRICS[self.metric] else 1.0) * key


def _edges(found: list[Best]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*(x.edges() for x in found))] if found else [np.zeros(0)] * 4
    return pa.RecordBatch.from_arrays([pa.array(x.astype(d)) for x, d in zip(cols, (np.int64, np.int64, np.int32, np.float64))], ["target_id", "source_id", "rn", "score"])


def _best(metric: str, k: int) -> Callable[[Cells, Cells], pa.RecordBatch]:
    """A function of (targets, sources) that gives each target's k best sources."""

    def best(t: Cells, s: Cells) -> pa.RecordBatch:
        found = Best.of(metric, k, t)
        for x in found:
            x.add(s)
        return _edges(found)

    return best


def _streamed(metric: str, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches of vectors in the order of PAIR and _side (0: targets, 1: sources), by cell_id, that gives the k best sources
    of each pair's targets. It holds one pair's targets, and of the sources no more than the batch that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in (*PAIR, "_side")])
            cuts = [0, *(np.flatnonzero((np.diff(marks) != 0).any(axis=0)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                *pair, side = marks[:, lo].tolist()
                if pair != at:
                    yield _edges(found)
                    at, found = pair, []
                part = b.slice(lo, hi - lo)
                lists = [c for c in ("vec", "idx", "base", "width") if c in part.schema.names and not part.column(c).null_count]
                cells = Cells.of(part.select(["cell_id", *lists]), "cell_id")
                if side == 0:
                    found += Best.of(metric, k, cells)
                else:
                    for x in found:
                        x.add(cells)
        yield _edges(found)

    return run


def _bytes(df: DataFrame) -> Column:
    """The bytes of a row's vector."""
    return (F.size("vec") * (12 if "idx" in df.columns else 8) + 8).cast("long")


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows of vectors, and their bytes."""
    n, size = df.select(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return n or 0, size or 0


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("cell_id", F.col("cell_id").cast("long")).withColumnRenamed("cell_id", name)


def top_k(targets: DataFrame, sources: DataFrame, k: int, metric: str = "dot", broadcast_bytes: int | None = None, block: int = SOURCES) -> DataFrame:
    """(target_id, source_id, rn, score) of each target's k best sources, exactly; vectors of both as of vectors() or sparse_vectors().

    metric 'dot': highest product first; 'euclidean', 'angular' (the square root of 2 - 2 cos), 'manhattan' and 'hamming' (places
    that differ): smallest distance first. Scores are rounded to nine places, ties go to the smaller source id; k is
    clipped to the number of sources. While all sources fit the byte bound, each task of targets scans them from a
    broadcast; else blocks of both meet in a task for each pair, and the best of the blocks are merged by rank. Either
    way products are matrix products over blocks of bounded bytes, or of sparse vectors sums over the places that both have.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    n, size = _size(sources)
    k = min(k, n)
    if k < 1:
        return targets.sparkSession.createDataFrame([], EDGES)
    t, s, best = _named(targets, "target_id"), _named(sources, "source_id"), _best(metric, k)
    if size <= ((SPARSE_BYTES if "idx" in s.columns else BROADCAST_BYTES) if broadcast_bytes is None else broadcast_bytes):
        shared = targets.sparkSession.sparkContext.broadcast(Cells.of(s.toArrow(), "source_id"))
        small_batches(targets.sparkSession)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield best(Cells.of(b, "target_id"), shared.value)

        return t.mapInArrow(scan, EDGES)
    return _by_blocks(t.withColumn("_list", F.lit(0)), s.withColumn("_list", F.lit(0)), k, metric, block)


def _by_blocks(t: DataFrame, s: DataFrame, k: int, metric: str, block: int) -> DataFrame:
    """top_k() of targets and sources that share a _list. A list's sources are cut into blocks and its targets into slices by a
    hash of their ids, as its counts and bytes ask for. A task meets one block and one slice after the other, however large a list
    is: it holds the slice and reads the block batch by batch."""
    parts = lambda df, most, size: F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum(_bytes(df)) / size))
    sizes = t.groupBy("_list").agg(parts(t, TARGETS, TASK_BYTES).alias("_slices")).join(s.groupBy("_list").agg(parts(s, block, 2 * TASK_BYTES).alias("_blocks")), "_list")
    cuts = F.broadcast(stored(sizes.select(F.col("_list").alias("_l"), "_blocks", "_slices"), "lists"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    s = s.join(cuts, F.col("_list") == F.col("_l")).withColumn("_block", F.pmod(F.xxhash64("source_id"), "_blocks")).withColumn("_slice", upto("_slices"))
    t = t.join(cuts, F.col("_list") == F.col("_l")).withColumn("_slice", F.pmod(F.xxhash64("target_id"), "_slices")).withColumn("_block", upto("_blocks"))
    t, s = (x.withColumnRenamed(own, "cell_id").withColumn("_side", F.lit(side)).drop("_l", "_blocks", "_slices") for side, (x, own) in enumerate(((t, "target_id"), (s, "source_id"))))
    small_batches(t.sparkSession)
    dealt = t.unionByName(s, allowMissingColumns=True).repartition(*PAIR).sortWithinPartitions(*PAIR, "_side")
    found = dealt.mapInArrow(_streamed(metric, k), EDGES)
    order = F.col("score").desc() if METRICS[metric] else F.col("score")
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("target_id").orderBy(order, "source_id"))).where(F.col("rn") <= k)


def bucketed_top_k(targets: DataFrame, sources: DataFrame, k: int, metric: str = "dot", lists: int | None = None, probes: int | None = None, rounds: int = 2, seed: int = 23, block: int = SOURCES) -> DataFrame:
    """top_k() among the sources of the `probes` lists nearest to each target, with exact scores: approximate, for many sources.

    The lists' centres are source vectors picked by a seeded hash of their ids and moved `rounds` times to the mean of
    their members (by default as many lists as the square root of the sources, LISTS at most, and an eighth of them is
    probed). Every source is in the list of its nearest centre. More probes find more; with all lists it is exact. A target
    that finds fewer than k sources in its lists is searched exactly.
    """
    if metric not in METRICS:
        raise ValueError(f"no such metric: {metric}")
    n = sources.count()
    k, lists = min(k, n), min(lists or math.ceil(n**0.5), LISTS, max(n, 1))
    if k < 1:
        return targets.sparkSession.createDataFrame([], EDGES)
    probes = min(probes or math.ceil(lists / 8), lists)
    t, s = _named(targets, "target_id"), _named(sources, "source_id")
    spark = targets.sparkSession
    first = Cells.of(s.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source_id").cast("string")).cast("binary"))).limit(lists).toArrow(), "source_id")
    centres = Cells(np.arange(lists), first.rows(0, lists).ravel().copy(), first.width)
    near = lambda shared, m: _best("euclidean", m)

    def moved(shared) -> Cells:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((lists, shared.value.width)), np.zeros(lists)
            for b in batches:
                own = Cells.of(b, "source_id")
                to = near(shared, 1)(own, shared.value).column("source_id").to_numpy()
                for i in range(0, len(own.ids), AT_ONCE):
                    np.add.at(total, to[i : i + AT_ONCE], own.rows(i, i + AT_ONCE))
                count += np.bincount(to, minlength=lists)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"_list": pa.array(some, pa.int64()), "_n": pa.array(count[some]), "_v": pa.array([total[i].tobytes() for i in some], pa.binary())})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[float, np.ndarray]] = {}
            for b in batches:
                for i, c, v in zip(*(b.column(x).to_pylist() for x in ("_list", "_n", "_v"))):
                    had = held.get(i, (0.0, 0.0))
                    held[i] = (had[0] + c, had[1] + np.frombuffer(v))
            yield pa.RecordBatch.from_pydict({"_list": pa.array(list(held), pa.int64()), "_n": pa.array([c for c, _ in held.values()]), "_v": pa.array([v.tobytes() for _, v in held.values()], pa.binary())})

        kind = "_list long, _n double, _v binary"
        out = shared.value.rows(0, lists).copy()
        for r in s.mapInArrow(sums, kind).repartition("_list").mapInArrow(add, kind).collect():
            out[r._list] = np.frombuffer(r._v) / r._n
        return Cells(np.arange(lists), out.ravel(), shared.value.width)

    for _ in range(rounds):
        centres = moved(spark.sparkContext.broadcast(centres))
    shared = spark.sparkContext.broadcast(centres)

    def listed(df: DataFrame, key: str, m: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = near(shared, m)(Cells.of(b, key), shared.value)
                yield pa.RecordBatch.from_arrays([got.column("target_id"), got.column("source_id")], [f"_{key}", "_list"])

        to = df.mapInArrow(run, f"_{key} long, _list long")
        return df.join(to, F.col(key) == F.col(f"_{key}")).drop(f"_{key}")

    found = stored(_by_blocks(listed(t, "target_id", probes), listed(s, "source_id", 1), k, metric, block), "near")
    done = found.where(F.col("rn") == k).select("target_id")
    short = stored(t.join(done, "target_id", "left_anti").withColumnRenamed("target_id", "cell_id"), "short")
    if not short.limit(1).count():
        return found
    return found.join(done, "target_id", "left_semi").unionByName(top_k(short, sources, k, metric, block=block))


def spearman_knn(targets: DataFrame | Modality, sources: DataFrame | Modality, k: int = 20, sign: int = 1, search: Callable = top_k) -> DataFrame:
    """Each target cell's k source cells of the highest (sign 1) or lowest (-1) rank correlation; modalities, or long values of dense ones."""
    return search(stored(score_vectors(targets, sign), "targets"), stored(score_vectors(sources), "sources"), k)


def first_k(edges: DataFrame, k: int) -> DataFrame:
    """The first k of the neighbours stored for each target; ValueError if fewer are stored."""
    if (edges.agg(F.max("rn")).first()[0] or 0) < k:
        raise ValueError(f"fewer than {k} neighbours are stored")
    return edges.where(F.col("rn") <= k)


def saturation(n_targets: int, n_sources: int, k: int, relaxation: float) -> int:
    """How many targets may have one source as neighbour."""
    return int(n_targets / n_sources * k * relaxation) + 1


def constrained_knn(targets: DataFrame | Modality, sources: DataFrame | Modality, k: int = 20, relaxation: float = 10, speed: int = 10, seed: int = 23, sign: int = 1, search: Callable = top_k) -> DataFrame:
    """capped_top_k() of rank z-scores; modalities, or long values of dense ones."""
    return capped_top_k(stored(score_vectors(targets, sign), "targets"), stored(score_vectors(sources), "sources"), k, relaxation, speed, seed, search)


def capped_top_k(t: DataFrame, s: DataFrame, k: int = 20, relaxation: float = 10, speed: int = 10, seed: int = 23, search: Callable = top_k) -> DataFrame:
    """(target_id, source_id, rn): k sources for each target, none for more targets than saturation(); t and s are stored vectors.

    Plain neighbours are the answer if none of their in-degrees passes the cap. Otherwise the targets choose one after the other
    in a seeded order (md5 of id, seed and pass), pass by pass: of its best k * speed sources that were open at the
    start of the pass, a target takes the first k that still are, or waits for the next pass. The outcome is that of this
    sequence, but worked out by _chosen() in rounds over tables; only counts come to the driver.
    """
    n_t, n_s = t.count(), s.count()
    if k > n_s:
        raise ValueError(f"{k} neighbours of {n_s} sources")
    cap = saturation(n_t, n_s, k, relaxation)
    plain = stored(search(t, s, k).select("target_id", "source_id", "rn"), "neighbours")
    if (plain.groupBy("source_id").count().agg(F.max("count")).first()[0] or 0) <= cap:
        return plain
    accepted: list[DataFrame] = []
    left, n_left = t, n_t
    while n_left:
        taken = functools.reduce(DataFrame.unionAll, accepted) if accepted else plain.limit(0)
        degree = stored(taken.groupBy("source_id").agg(F.count(F.lit(1)).alias("_d")), "degrees")
        full = degree.where(F.col("_d") >= cap).select(F.col("source_id").alias("cell_id"))
        n_open = n_s - full.count()
        if n_open < k:
            raise RuntimeError("too few sources are below the cap; raise the relaxation")
        open_ = s.join(full, "cell_id", "left_anti") if n_open < n_s else s
        order = F.md5(F.concat_ws(":", F.col("target_id").cast("string"), F.lit(str(seed)), F.lit(str(len(accepted)))).cast("binary"))
        cand = stored(search(left, open_, min(k * speed, n_open)).select("target_id", "source_id", "rn", order.alias("_o")), "candidates")
        # While each target finds k among its first 2 k candidates, none looks at the others, and few targets meet at a source.
        taken = _chosen(cand.where(F.col("rn") <= 2 * k), degree, cap, k) if speed > 2 else None
        if taken is None or taken.select("target_id").distinct().count() < n_left:
            taken = _chosen(cand, degree, cap, k)
        accepted.append(taken)
        done = accepted[-1].select(F.col("target_id").alias("cell_id")).distinct()
        left = stored(left.join(done, "cell_id", "left_anti"), "waiting")
        if left.count() == n_left:
            raise RuntimeError("no target found enough sources below the cap; raise the relaxation")
        n_left = left.count()
    return functools.reduce(DataFrame.unionAll, accepted)


def _chosen(cand: DataFrame, degree: DataFrame, cap: int, k: int) -> DataFrame:
    """(target_id, source_id, rn) of what the targets of cand (target_id, source_id, rn, _o) take if each in turn, in the order of _o and
    id, takes the first k of its candidates that fewer than cap have, or none if there are fewer than k.

    Each round bounds how many earlier targets take a source, from those that surely do (_s = 2) and those that still may (1). A
    candidate is free if those that may leave room, and full if those that do leave none; from this follows what a target
    surely takes, may take, or cannot. The first target that is open has no open one before it, so each round
    settles some. Counts before a target run in two levels (256 parts of the order), so no task gathers a source.
    """
    state = cand.join(degree.select(F.col("source_id").alias("_ds"), "_d"), F.col("source_id") == F.col("_ds"), "left")
    state = state.select("target_id", "source_id", "rn", "_o", F.coalesce("_d", F.lit(0)).alias("_d"), F.conv(F.substring("_o", 1, 2), 16, 10).cast("int").alias("_b"), F.lit(1).alias("_s"))
    sure, may = (F.col("_s") == 2).cast("long"), (F.col("_s") > 0).cast("long")
    with Scratch() as own:
        while True:
            parts = state.groupBy("source_id", "_b").agg(F.sum(sure).alias("_l"), F.sum(may).alias("_u"))
            run = Window.partitionBy("source_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
            parts = parts.select(F.col("source_id").alias("_ps"), F.col("_b").alias("_pb"), *(F.coalesce(F.sum(c).over(run), F.lit(0)).alias(c) for c in ("_l", "_u")))
            before = Window.partitionBy("source_id", "_b").orderBy("_o", "target_id").rowsBetween(Window.unboundedPreceding, -1)
            known = state.select("*", *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(c) for x, c in ((sure, "_il"), (may, "_iu"))))
            known = known.join(parts, (F.col("source_id") == F.col("_ps")) & (F.col("_b") == F.col("_pb")))
            free, room = F.col("_d") + F.col("_u") + F.col("_iu") < cap, F.col("_d") + F.col("_l") + F.col("_il") < cap
            known = known.select("target_id", "source_id", "rn", "_o", "_d", "_b", free.cast("int").alias("_free"), room.cast("int").alias("_room"))
            all_, upto = Window.partitionBy("target_id"), Window.partitionBy("target_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
            takes = (F.sum("_free").over(all_) >= k) & (F.col("_free") == 1) & (F.coalesce(F.sum("_room").over(upto), F.lit(0)) < k)
            could = (F.sum("_room").over(all_) >= k) & (F.col("_room") == 1) & (F.coalesce(F.sum("_free").over(upto), F.lit(0)) < k)
            state = stored(known.select("target_id", "source_id", "rn", "_o", "_d", "_b", F.when(takes, 2).when(could, 1).otherwise(0).alias("_s")), "choices")
            if not state.where("_s = 1").limit(1).count():
                break
        place = F.row_number().over(Window.partitionBy("target_id").orderBy("rn"))
        return own.keep(stored(state.where("_s = 2").select("target_id", "source_id", place.alias("rn")), "accepted"))


def auto_k(n_valid: int, fraction: float, k_max: int) -> int:
    """A share of the cells, to the nearest ten, and no more than k_max."""
    return min(k_max, round_unit_value(math.ceil(fraction * n_valid), 10, "nearest"))


def check_ka(k: int, ka: int) -> int:
    """The place of the neighbour whose distance scales the kernel: below k."""
    if ka >= k:
        ka = math.ceil(k / 2)
    if ka >= k:
        raise ValueError("more neighbours are needed than scale the kernel")
    return ka


def normalised(edges: DataFrame, offset: float = 1e-5, axis: int | None = 1) -> DataFrame:
    """Weights over their sum for the target (axis 1) or source (0), plus offset; None leaves them."""
    if axis is None:
        return edges
    if axis not in (0, 1):
        raise ValueError(f"no such axis: {axis}")
    key = "target_id" if axis == 1 else "source_id"
    return edges.withColumn("weight", F.col("weight") / (F.sum("weight").over(Window.partitionBy(key)) + offset))


def mutual_neighbors(targets: DataFrame | Modality, sources: DataFrame | Modality, k_target: int, k_source: int, sign: int = 1, search: Callable = top_k) -> DataFrame:
    """mutual_top_k() of rank z-scores; modalities, or long values of dense ones."""
    return mutual_top_k(stored(score_vectors(targets, sign), "targets"), stored(score_vectors(sources), "sources"), k_target, k_source, search)


def mutual_top_k(t: DataFrame, s: DataFrame, k_target: int, k_source: int, search: Callable = top_k) -> DataFrame:
    """(target_id, source_id): sources among the target's k_target best, whose k_source best have the target."""
    there = search(t, s, k_target).select("target_id", "source_id")
    back = search(s, t, k_source).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return there.join(back, ["target_id", "source_id"])


def adjacency(edges: DataFrame, n_targets: int | None = None) -> DataFrame:
    """(target_id, source_id, weight) with weight 1 for each neighbour; ValueError if not n_targets targets have neighbours."""
    if n_targets is not None and edges.select("target_id").distinct().count() != n_targets:
        raise ValueError(f"not {n_targets} targets have neighbours")
    return edges.select("target_id", "source_id", F.lit(1.0).alias("weight"))


def rescue_weights(points: DataFrame, anchors: DataFrame, k: int, ka: int = 5, epsilon: float = 1.0, offset: float = 1e-5) -> DataFrame:
    """(target_id, source_id, weight) of each point's k nearest anchors: a Gaussian of the distance over that of the ka-th (from 0),
    normalised. points and anchors are (cell_id, vec)."""
    near = top_k(points, anchors, k, "euclidean")
    if ka > 0:
        scale = F.max(F.when(F.col("rn") == ka + 1, F.col("score"))).over(Window.partitionBy("target_id"))
        near = near.withColumn("score", F.try_divide(F.col("score"), scale))
    d = F.coalesce("score", F.lit(0.0))
    return normalised(near.select("target_id", "source_id", F.exp(-d * d / (2 * epsilon**2)).alias("weight")), offset)
