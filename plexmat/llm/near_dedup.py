"""Operator 10: near-duplicates by DartMinHash signatures, a banded join, an exact check and connected components.

Darts (Christiani, 2020): every element owns a strip of weights [0, inf) by times [0, inf) over which a hash throws
darts at rate 1. Of a set, the darts under each element's weight count. Each dart has one of k coordinates; the
earliest dart of a coordinate is the set's value there. Two sets agree in a coordinate with probability
sum(min(w, v)) / sum(max(w, v)). Darts are thrown only up to the time at which all coordinates have one, so a set costs
about k ln k darts, however many elements it has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexmat.llm import common, shingles
from plexmat.llm.shingles import U, mix

#: Bands of ROWS coordinates each. Two texts of similarity 0.8 miss each other with probability (1 - 0.8**5)**25 = 5e-5.
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
#: Length of the first time slice; each later one is as long as all before it.
FIRST = 2.0**-7
#: Members of a bucket up to which all its pairs are candidates at once; larger ones go round by round.
DIRECT = 32
#: Representatives that the first round takes from a large bucket, and how many times as many each later one takes.
PER_ROUND = 16
GROWTH = 16
BROADCAST_ROWS = 500_000
#: Shingles (16 bytes each) up to which those that members share are sent to the tasks.
SHARED_ROWS = 2_000_000
_NONE = U(0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """The upper 53 bits as numbers in [0, 1)."""
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion; mean is at most 1."""
    k = np.arange(24)
    steps = np.cumsum(np.exp(-mean) * mean**k / np.cumprod(np.maximum(k, 1).astype(float)))
    return np.searchsorted(steps, u, side="right")


def signatures(elements: np.ndarray, weights: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """A row of k values for each set (segments off of elements): time and name of the earliest dart. An empty set has none."""
    n = len(off) - 1
    sig = np.full(n * k, _NONE, U)
    size = np.diff(off)
    owner = np.repeat(np.arange(n), size)
    total = np.bincount(owner, weights, n) if len(owner) else np.zeros(n)
    active = size > 0
    goal = k * (np.log(k) + 2)
    end, length, s = 0.0, FIRST, 0
    while active.any():
        rows = np.flatnonzero(active[owner])
        layer, low = 0, 0.0
        while len(rows):
            high = 1.0 if layer == 0 else low * 2
            area = (high - low) * length
            cells = 1 << max(0, int(np.ceil(np.log2(area))))
            with np.errstate(over="ignore"):
                key = mix(elements[rows] ^ U((s << 8 | layer) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
                who = rows
                cell = np.zeros(1)
                if cells > 1:
                    key = (key[:, None] + np.arange(1, cells + 1, dtype=U) * U(0xD1342543DE82EF95)).ravel()
                    who, cell = np.repeat(rows, cells), np.tile(np.arange(cells, dtype=float), len(rows))
                u = _unit(mix(key))
                hit = np.flatnonzero(u >= np.exp(-area / cells))
                count = _poisson(u[hit], area / cells)
                many = np.repeat(hit, count)
                nth = np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix(key[many] ^ (nth.astype(U) + U(1)) * U(0xA0761D6478BD642F))
                more = mix(dart)
            who = who[many]
            keep = low + (high - low) * _unit(more) < weights[who]
            dart, more, who = dart[keep], more[keep], who[keep]
            time = end + length * ((cell[many][keep] if cells > 1 else 0.0) + _unit(dart)) / cells
            place = ((more & U(0xFFFFFFFF)) * U(k)) >> U(32)
            named = (time.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mix(dart) & U(0xFFFFFFFF))
            np.minimum.at(sig, owner[who] * k + place.astype(np.int64), named)
            low, layer = high, layer + 1
            rows = rows[weights[rows] > low]
        end, length, s = end + length, max(length, end + length), s + 1
        ready = total * end >= goal
        open_ = np.zeros(n, bool)
        check = np.flatnonzero(active & ready)
        if len(check):
            open_[check] = (sig.reshape(n, k)[check] == _NONE).any(axis=1)
        active &= ~ready | open_
    return sig.reshape(n, k)


def weight_of(counts: np.ndarray, counted: bool = False) -> np.ndarray:
    """Weights of the shingles: 1 each, as in the exact check. If counted, repeats count, but damped: this loses pairs whose repeats differ."""
    return 1 + np.log(counts) if counted else np.ones(len(counts))


def bands_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), U)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(sig), b + 1, U)
            for r in range(rows):
                h = mix(h ^ sig[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def _names(values: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A 16-byte name of each set of shingles."""
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _list(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, counted: bool = False) -> DataFrame:
    """(_i, _x, _g, _z, _bands) of each row: id, hash of the text, name and size of its set of shingles, band keys (none of an empty text)."""
    src = docs.select(F.col(id_col).alias("_i"), F.xxhash64(common.text_of(text_col)).alias("_x"), common.text_of(text_col).alias("_t"))

    def run(b: pa.RecordBatch) -> dict:
        values, counts, off = shingles.shingles(b.column("_t"))
        keys = bands_of(signatures(values, weight_of(counts, counted), off, bands * rows), bands, rows)
        some = np.diff(off) > 0
        ends = np.concatenate(([0], np.cumsum(some * bands)))
        return {"_i": b.column("_i"), "_x": b.column("_x"), "_g": pa.array(_names(values, off), pa.binary()), "_z": pa.array(np.diff(off).astype(np.int32)), "_bands": _list(keys[some].ravel(), ends)}

    kind = src.schema["_i"].dataType.simpleString()
    return common.map_text(src, run, f"_i {kind}, _x long, _g binary, _z int, _bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_g, _s): the shingles of the wanted sets (_g, _i: the id of one text of it), a row for each."""
    ids = common.small(common.stored(wanted.select(F.col("_i").alias("_w")).distinct(), "wanted"), BROADCAST_ROWS)
    src = docs.select(F.col(id_col).alias("_i"), common.text_of(text_col).alias("_t")).join(ids, F.col("_i").eqNullSafe(F.col("_w")), "left_semi").select("_t")

    def run(b: pa.RecordBatch) -> dict:
        values, _, off = shingles.shingles(b.column("_t"))
        return {"_g": pa.array(_names(values, off), pa.binary()), "_s": _list(values.view(np.int64), off)}

    found = common.stored(common.map_text(src, run, "_g binary, _s array<long>"), "shingles")
    # An id that several rows have also brings texts that aren't wanted, and a set may come more than once.
    return found.join(wanted.select(F.col("_g").alias("_wg")), F.col("_g") == F.col("_wg"), "left_semi").dropDuplicates(["_g"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (_a, _b), those whose sets have at least that Jaccard similarity; the sets are joined by their names."""
    a = sets.select(F.col("_g").alias("_ga"), F.col("_s").alias("_sa"))
    b = sets.select(F.col("_g").alias("_gb"), F.col("_s").alias("_sb"))
    both = pairs.join(a, F.col("_a") == F.col("_ga")).join(b, F.col("_b") == F.col("_gb"))
    common_ = F.size(F.array_intersect("_sa", "_sb"))
    return both.where(common_ >= F.lit(threshold) * (F.size("_sa") + F.size("_sb") - common_)).select("_a", "_b")


def components(edges: DataFrame) -> DataFrame:
    """(_n, _c): each node of the edges (_a, _b) with the smallest node of its component.

    Each round, a node goes to the smallest among itself and its neighbours, and the edges are drawn between the nodes gone
    to; equal ones and loops drop out, so a group around a few nodes is one node after a round or two, whatever its size.
    Nodes are hashes, in an order without meaning, so the number of nodes falls by a constant factor each round. In the
    end the rounds' tables are joined, the last and smallest first. Minima are combined before each shuffle.
    """
    a, b = F.col("_a"), F.col("_b")
    with common.Scratch() as own:
        left, moves = common.stored(edges.where(a != b).select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct(), "edges"), []
        while not moves or left.limit(1).count():
            both = left.unionAll(left.select(b, a))
            moves.append(common.stored(both.groupBy("_a").agg(F.min("_b").alias("_c")).select(F.col("_a").alias("_n"), F.least("_a", "_c").alias("_c")), "moves"))
            first = left.join(moves[-1], a == F.col("_n")).select(F.col("_c").alias("_to"), "_b")
            ends = first.join(moves[-1], b == F.col("_n")).select(F.col("_to").alias("_a"), F.col("_c").alias("_b")).where(a != b)
            left = common.stored(ends.select(F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b")).distinct(), "edges")
        label = moves.pop()
        while moves:
            later = label.select(F.col("_n").alias("_k"), F.col("_c").alias("_cc"))
            label = moves.pop().join(later, F.col("_c") == F.col("_k"), "left").select("_n", F.coalesce("_cc", "_c").alias("_c"))
        return own.keep(common.stored(label, "labels"))


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, direct: int = DIRECT, per_round: int = PER_ROUND, counted: bool = False, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """Rows (_i, _x, _g, _class), one per row of docs: its id, hash of its text, name of its set, and class.

    A class is a connected component of texts whose sets of five-word shingles (words: letters and digits, in lower
    case) have Jaccard similarity of `threshold` or more. Texts of one set are one node, whatever their number.
    Candidates share a band of the signatures, which are of the plain sets unless `counted` (see weight_of()). All pairs
    of a bucket of at most `direct` sets are checked exactly. Of a larger bucket, representatives are compared with all members in other components so far, round by round, until
    its remaining members are in one component: so no candidate link between components is lost. The first are of the
    bucket's `per_round` foremost members one of each component, see _leads(). The members left are then dealt anew by
    their rare shingles, see _by_rare(), which parts texts that share a frequent passage alone. Each later round takes up to GROWTH times as
    many representatives, from outside a bucket's largest component alone. The rounds thus grow with the logarithm of
    what is left outside.

    Null text counts as empty; empty texts are one class. A text of fewer than five words is its one shingle. An
    empty table gives an empty result; repeated rows share their class. Long texts count whole.
    """
    sk = common.stored(sketches(docs, id_col, text_col, bands, rows, counted), "sketches")
    nodes = sk.groupBy("_g").agg(F.min("_i").alias("_i"), F.max("_z").alias("_z"), F.min("_bands").alias("_bands"))
    keys = nodes.select("_g", "_z", F.explode("_bands").alias("_key"))
    full = keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    full = full.select(common.dealt_anew("_key").alias("_k"), "_n").hint("merge")
    members = common.stored(keys.join(full, F.col("_key") == F.col("_k")).select("_key", "_g", "_z", "_n"), "buckets")
    one = members.select("_key", F.col("_g").alias("_a"), "_z").where(F.col("_n") <= direct)
    two = members.select(F.col("_key").alias("_k"), F.col("_g").alias("_b"), F.col("_z").alias("_zb")).where(F.col("_n") <= direct)
    pairs = one.join(two, (F.col("_key") == F.col("_k")) & (F.col("_a") < F.col("_b")) & _may_reach("_z", "_zb", "_z", "_zb", threshold)).select("_a", "_b").distinct()
    wanted = nodes.select("_g", "_i").join(members.select(F.col("_g").alias("_m")).distinct(), F.col("_g") == F.col("_m"), "left_semi")
    sets = common.stored(_sets(docs, common.stored(wanted, "nodes"), id_col, text_col), "sets")
    label = components(_links(pairs, sets, threshold))
    # Texts in many and large buckets come first as representatives: what others are copies of is among them.
    rank = members.groupBy("_g").agg(F.sum("_n").alias("_w")).select(F.col("_g").alias("_rg"), "_w")
    large = members.where(F.col("_n") > direct).select("_key", "_g", "_z").join(rank, F.col("_g") == F.col("_rg"))
    large = common.stored(large.select("_key", "_g", "_w", "_z", F.col("_z").cast("long").alias("_left"), F.lit(True).alias("_lead")), "large")
    # Members of large buckets that have not yet been representatives, while a bucket has more than one component.
    round_ = 0
    while True:
        # After a round without links the members keep the components they have.
        now = large if "_c" in large.columns else large.join(label.select(F.col("_n").alias("_l"), "_c"), F.col("_g") == F.col("_l"), "left").select(*large.columns, F.coalesce("_c", "_g").alias("_c"))
        parts = now.groupBy("_key", "_c").agg(F.count(F.lit(1)).alias("_m"), F.max("_lead").alias("_lead"), F.max("_left").alias("_most"), F.min("_z").alias("_least"))
        mixed = parts.groupBy("_key").agg(F.max(F.struct("_m", "_c")).alias("_main"), F.count(F.lit(1)).alias("_m"), F.max("_lead").alias("_lead"), F.max("_most").alias("_most"), F.min("_least").alias("_least")).where("_m > 1 and _lead")
        mixed = mixed.select(common.dealt_anew("_key").alias("_k"), F.col("_main._c").alias("_main"), "_most", "_least")
        # A member that could reach none of its bucket, by the most shingles left and the least size there, has no pair in it.
        reach = (F.col("_key") == F.col("_k")) & _may_reach("_left", "_most", "_z", "_least", threshold)
        live = common.stored(now.join(mixed.hint("merge"), reach).select(*now.columns, "_main"), "live")
        if not live.limit(1).count():
            break
        round_ += 1
        if round_ == 2:
            large = common.stored(_by_rare(live, sets, threshold, shared_rows), "large")
            continue
        # When all members outside a bucket's largest component have been representatives, the bucket is done.
        reps = _foremost(live if round_ == 1 else live.where(F.col("_c") != F.col("_main")), per_round).select(F.col("_key").alias("_rk"), F.col("_g").alias("_rep"), F.col("_c").alias("_rc"), F.col("_w").alias("_rw"), F.col("_z").alias("_rz"), F.col("_left").alias("_rl"))
        reps = common.stored(reps, "reps")
        if round_ == 1:
            reps, label = _leads(reps, label, sets, threshold)
        cand = live.join(reps, (F.col("_key") == F.col("_rk")) & (F.col("_c") != F.col("_rc")) & _may_reach("_left", "_rl", "_z", "_rz", threshold))
        cand = cand.select(F.least("_g", "_rep").alias("_a"), F.greatest("_g", "_rep").alias("_b")).distinct()
        found = common.stored(_links(cand, sets, threshold), "links")
        large = live.drop("_main").join(reps, (F.col("_key") == F.col("_rk")) & (F.col("_g") == F.col("_rep")), "left_anti")
        if found.limit(1).count():
            label = common.stored(_joined(label, found), "labels")
        if round_ == 1 or found.limit(1).count():
            large = large.drop("_c")
        per_round *= GROWTH
    classed = label.select(F.col("_n").alias("_ln"), "_c")
    tagged = nodes.select("_g").join(classed, F.col("_g") == F.col("_ln"), "left").select(F.concat(F.col("_g"), F.lit(b"")).alias("_ng"), F.coalesce("_c", "_g").alias("_class")).hint("merge")
    return sk.select("_i", "_x", "_g").join(tagged, F.col("_g") == F.col("_ng")).select("_i", "_x", "_g", "_class")


def _may_reach(left_a: str, left_b: str, size_a: str, size_b: str, threshold: float) -> Column:
    """Whether two sets with at most the smaller of two numbers of shingles in common can have that similarity: t / (1 + t) of both sizes."""
    return F.least(left_a, left_b) >= (F.col(size_a) + F.col(size_b)) * (threshold / (1 + threshold)) - 1e-6


def _leads(reps: DataFrame, label: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of representatives that a bucket has, one for each component, after they were compared with each other; and the labels then.

    Members are compared with these alone: in a bucket of copies of one text a member is so compared once or twice, not
    once for each representative. The others stay members, for later rounds.
    """
    other = reps.select(F.col("_rk").alias("_ok"), F.col("_rep").alias("_other"), F.col("_rc").alias("_oc"), F.col("_rz").alias("_oz"), F.col("_rl").alias("_ol"))
    pairs = reps.join(other, (F.col("_rk") == F.col("_ok")) & (F.col("_rep") < F.col("_other")) & (F.col("_rc") != F.col("_oc")) & _may_reach("_rl", "_ol", "_rz", "_oz", threshold))
    found = common.stored(_links(pairs.select(F.col("_rep").alias("_a"), F.col("_other").alias("_b")).distinct(), sets, threshold), "links")
    label = common.stored(_joined(label, found), "labels")
    now = reps.drop("_rc").join(label.select(F.col("_n").alias("_l"), F.col("_c").alias("_rc")), F.col("_rep") == F.col("_l"), "left").withColumn("_rc", F.coalesce("_rc", "_rep"))
    one = now.groupBy("_rk", "_rc").agg(F.max(F.struct("_rw", "_rep", "_rz", "_rl")).alias("_r")).select("_rk", "_rc", "_r.*")
    return common.stored(one, "leads"), label


def _by_rare(members: DataFrame, sets: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """(_key, _g, _w, _c, _z, _left, _lead): members under the rarest of their shingles, so many that two similar members share a key.

    Members (_g, _w, _c, _main) outside the largest component _main of one of their buckets are outsiders. Two members
    that a bucket shares and a component doesn't have an outsider among them, so only shingles that an outsider and some
    other member have are dealt. Of a set of z shingles in any one order, a set of similarity t shares one of the first
    z - ceil(t z) + 1. The order here: shingles that aren't dealt, then by how many members have a shingle, then by
    shingle. While at most broadcast_rows shingles are dealt, tasks look them up in a sorted array; beyond that they are
    joined. _left counts the set's shingles from the key on: if the key is the first that two sets share, they have at
    most the smaller _left in common, and need t / (1 + t) of the sum of their sizes. _lead tells if _left lets a set be
    the smaller one of a pair; a key without such a member has no pair.
    """
    some = members.groupBy("_g").agg(F.max("_w").alias("_w"), F.max("_c").alias("_c"), F.max(F.col("_c") != F.col("_main")).alias("_out")).select(F.col("_g").alias("_m"), "_w", "_c", "_out")
    own = common.stored(sets.join(some, F.col("_g") == F.col("_m")).select("_g", "_w", "_c", "_out", "_s"), "members")

    def count(b: pa.RecordBatch) -> dict:
        """A batch's shingles, each once, with how many of its members have it and whether an outsider does."""
        s = b.column("_s")
        names, at, f = np.unique(s.flatten().to_numpy(zero_copy_only=False), return_inverse=True, return_counts=True)
        out = np.repeat(b.column("_out").to_numpy(zero_copy_only=False), np.diff(s.offsets.to_numpy()))
        return {"_t": pa.array(names), "_f": pa.array(f), "_out": pa.array(np.bincount(at, out, len(names)) > 0)}

    often = common.map_text(own.select("_g", "_out", "_s"), count, "_t long, _f long, _out boolean", "_g").groupBy("_t").agg(F.sum("_f").alias("_f"), F.max("_out").alias("_out"))
    often = common.stored(often.where("_f > 1 and _out").select(common.dealt_anew("_t").alias("_ft"), "_f"), "often")
    if often.count() <= broadcast_rows:
        table = often.toArrow()
        name, f = table["_ft"].to_numpy(), table["_f"].to_numpy()
        by_name, rank = np.argsort(name), np.empty(len(name), np.int64)
        rank[np.lexsort((name, f))] = np.arange(len(name))
        known = members.sparkSession.sparkContext.broadcast((name[by_name], rank[by_name]))

        def run(b: pa.RecordBatch) -> dict:
            names, order = known.value
            s = b.column("_s")
            flat, off = s.flatten().to_numpy(zero_copy_only=False), s.offsets.to_numpy()
            who = np.repeat(np.arange(len(s)), np.diff(off))
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            dealt = np.flatnonzero(names[at] == flat) if len(names) else np.zeros(0, np.int64)
            dealt = dealt[np.lexsort((order[at[dealt]], who[dealt]))]
            z, n = np.diff(off), np.bincount(who[dealt], minlength=len(s))
            upto = np.concatenate(([0], np.cumsum(n)))
            most = z - np.ceil(z * threshold - 1e-6).astype(np.int64) + 1 - (z - n)
            dealt = dealt[np.arange(len(dealt)) - upto[who[dealt]] < most[who[dealt]]]
            ends = np.concatenate(([0], np.cumsum(np.bincount(who[dealt], minlength=len(s)))))
            return {"_g": b.column("_g"), "_w": b.column("_w"), "_c": b.column("_c"), "_z": pa.array(z.astype(np.int32)), "_o": pa.array((z - n).astype(np.int32)), "_p": _list(flat[dealt], ends)}

        placed = common.map_text(own.select("_g", "_w", "_c", "_s"), run, "_g binary, _w long, _c binary, _z int, _o int, _p array<long>", "_g")
    else:
        joined = own.select("_g", "_w", "_c", F.size("_s").alias("_z"), F.explode("_s").alias("_t")).join(often.hint("merge"), F.col("_t") == F.col("_ft"))
        joined = joined.groupBy("_g", "_w", "_c", "_z").agg(F.sort_array(F.collect_list(F.struct("_f", "_t"))).alias("_p")).withColumn("_o", F.col("_z") - F.size("_p"))
        most = (F.col("_z") - F.ceil(F.col("_z") * threshold - 1e-6) + 1 - F.col("_o")).cast("int")
        placed = joined.where(most > 0).select("_g", "_w", "_c", "_z", "_o", F.transform(F.slice("_p", 1, most), lambda x: x["_t"]).alias("_p"))
    placed = placed.select("_g", "_w", "_c", "_z", "_o", F.posexplode("_p").alias("_i", "_key"))
    placed = placed.select("_key", "_g", "_w", "_c", "_z", (F.col("_z") - F.col("_o") - F.col("_i")).alias("_left"))
    return placed.withColumn("_lead", F.col("_left") >= F.col("_z") * (2 * threshold / (1 + threshold)) - 1e-6)


def _foremost(live: DataFrame, n: int) -> DataFrame:
    """Of each bucket, up to n members: the foremost by rank of each of n hash parts. Combined before the shuffle."""
    part = F.pmod(F.xxhash64("_g"), F.lit(n))
    return live.groupBy("_key", part.alias("_part")).agg(F.max(F.struct("_w", "_g", "_c", "_z", "_left")).alias("_r")).select("_key", "_r.*")


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """Labels with the components that further links join: found on the graph of components alone."""
    of = label.select(F.col("_n").alias("_l"), "_c")
    ends = links.join(of, F.col("_a") == F.col("_l"), "left").select(F.coalesce("_c", "_a").alias("_a"), "_b")
    ends = ends.join(of, F.col("_b") == F.col("_l"), "left").select("_a", F.coalesce("_c", "_b").alias("_b")).distinct()
    merged = components(ends).select(F.col("_n").alias("_m"), F.col("_c").alias("_new"))
    known = label.join(merged, F.col("_c") == F.col("_m"), "left").select("_n", F.coalesce("_new", "_c").alias("_c"))
    fresh = merged.join(label.select(F.col("_n").alias("_l")), F.col("_m") == F.col("_l"), "left_anti").select(F.col("_m").alias("_n"), F.col("_new").alias("_c"))
    return known.unionByName(fresh)


def _classes(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """near_classes() as a table; what it is made from is deleted."""
    with common.Scratch() as own:
        return own.keep(common.stored(near_classes(docs, id_col=id_col, text_col=text_col, **options), "classes"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, class_size, kept) of each row: class_id is the smallest id of its class of near-duplicates.

    See near_classes(). The row with that id is kept; of rows that repeat it, all are marked. A class of null ids alone has
    class_id null and keeps its rows. Ids may be of any type that has an order; other columns, whatever their names, are ignored.
    """
    found = _classes(docs, id_col, text_col, options)
    return _with_class_id(found).select(F.col("_i").alias(id_col), "class_id", "class_size", F.col("_i").eqNullSafe(F.col("class_id")).alias("kept"))


def _with_class_id(found: DataFrame) -> DataFrame:
    sizes = found.groupBy("_class").agg(F.min("_i").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    sizes = sizes.select(F.concat(F.col("_class"), F.lit(b"")).alias("_cl"), "class_id", "class_size").hint("merge")
    return found.join(sizes, F.col("_class") == F.col("_cl"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with one of each class left, the one with the smallest id, with all their columns, whatever their names.

    Null ids come last; of rows that tie by id, those of the smallest hash of the text, and of these one, stays. Null texts are
    empty ones and one class. An empty table gives an empty result.
    """
    found = _classes(docs, id_col, text_col, options)
    tied = found.groupBy("_class").agg(F.min(F.struct(F.col("_i").isNull().alias("n"), F.col("_i").alias("i"), F.col("_x").alias("x"))).alias("_k"), F.count(F.lit(1)).alias("_m"))
    tied = tied.where(F.col("_m") > 1).select(F.concat(F.col("_class"), F.lit(b"")).alias("_cl"), "_k").hint("merge")
    told = found.join(tied, F.col("_class") == F.col("_cl"))
    verdict = told.select("_i", "_x", (F.col("_i").eqNullSafe(F.col("_k.i")) & (F.col("_x") == F.col("_k.x"))).alias("_k"))
    return common.keep_rows(docs, verdict, id_col, text_col, BROADCAST_ROWS)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
