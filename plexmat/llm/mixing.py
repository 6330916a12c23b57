"""Operator 9: mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexmat.llm import common

#: Relative weights, dealt in turn to the sources by code point.
WEIGHTS = (5, 2, 1)
#: Size of the mix as a share of all words, and how often a word may be taken at most.
SHARE, EPOCHS = 1.5, 2
#: Words of a block.
BLOCK = 1024
GOLDEN = 0.6180339887498949
#: Points for each block: an interval of share w meets a golden-ratio point at least every 3.7 / w points.
REACH = 4
#: Cells that join schedule points to the sources whose interval they may lie in.
CELLS = 4096
#: Buckets of a source's shuffled order, and how many of them the next level sums.
BUCKETS, COARSE = 65536, 256
#: Sources up to which their table (under 100 bytes a row) is broadcast.
SOURCES = 100_000
SPACE = r"[\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text: maximal runs of what isn't white space; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """(source, source_size, weight, target, blocks, before) from (source, source_size), a row for each source.

    A source's target is min(epochs * size, level * weight) with the one level at which the targets sum to
    share * all sizes: the sources in order of epochs * size / weight are capped as long as that ratio is below
    the level which the rest would have. blocks is how many blocks reach the target (to the nearest word), before
    how many those of the sources before it have. The windows here run over one narrow row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("_cap", (F.col("source_size") * epochs).cast("double"))
    ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("source_size").over(every) * F.lit(float(share))
    left = goal - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("_level", left / weight_left).withColumn("_open", F.col("_level") * F.col("weight") <= F.col("_cap"))
    s = s.withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level").alias("l")))).over(every)["l"])
    s = s.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap"))))
    s = s.withColumn("blocks", F.ceil(F.round("target") / block).cast("long"))
    return s.select("source", "source_size", "weight", "target", "blocks", F.coalesce(F.sum("blocks").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def _offsets(rows: DataFrame, key: list[str], fine: str, coarse: str, value: str) -> DataFrame:
    """For each (key, fine), the sum of value over the key's smaller fines: in two levels, none of which gathers a key."""
    same = [F.col(k) for k in key]
    f = rows.groupBy(*same, coarse, fine).agg(F.sum(value).alias("_v"))
    c = f.groupBy(*same, coarse).agg(F.sum("_v").alias("_cv"))
    run = Window.partitionBy(*same).orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col(coarse).alias("_kc"), F.coalesce(F.sum("_cv").over(run), F.lit(0)).alias("_before"))
    run = Window.partitionBy(*same, coarse).orderBy(fine).rowsBetween(Window.unboundedPreceding, -1)
    f = f.withColumn("_in", F.coalesce(F.sum("_v").over(run), F.lit(0)))
    on = F.col(coarse) == F.col("_kc")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return f.join(c, on).select(*(F.col(k).alias(f"_o{i}") for i, k in enumerate(key)), F.col(fine).alias("_of"), (F.col("_before") + F.col("_in")).alias("_offset"))


def streams(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """(_id, _source, _size, _at): each document's place in its source's shuffled stream of words.

    The order is that of md5(seed:id). Places come from sums by bucket of that hash, so that no window holds more
    than a bucket of a source, and the sums over buckets run in two levels of at most 256 rows.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    d = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), size_of(F.col(text_col)).alias("_size"), h.alias("_h"))
    d = d.withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")).withColumn("_c", (F.col("_b") / COARSE).cast("int"))
    d = common.stored(d.withColumn("_r", F.monotonically_increasing_id()), "sizes")
    run = Window.partitionBy("_source", "_b").orderBy("_h", "_size", "_r").rowsBetween(Window.unboundedPreceding, -1)
    inner = d.withColumn("_in", F.coalesce(F.sum("_size").over(run), F.lit(0)))
    o = _offsets(d, ["_source"], "_b", "_c", "_size")
    on = F.col("_source").eqNullSafe(F.col("_o0")) & (F.col("_b") == F.col("_of"))
    return inner.join(o, on).select("_id", "_source", "_size", "_r", (F.col("_in") + F.col("_offset")).alias("_at"))


def schedule(spark: SparkSession, goals: DataFrame, golden: float = GOLDEN) -> DataFrame:
    """(source, rank, position): which block number of which source comes at which place of the mix.

    Point i is frac((i + 1) * golden). The sources' numbers of blocks cut [0, 1) into intervals; the source whose
    interval holds a point gets the slot, and a source's slots are ranked. Slots beyond a source's last block are dropped,
    so places have gaps. Every source meets its number of blocks among the first REACH points for each block of the mix
    (golden-ratio points return to an interval of share w after 3.7 / w points at most); points after the first one for
    each block are made for the sources that lack slots by then alone. A source takes no block without a slot.
    """
    n = goals.agg(F.sum("blocks")).first()[0] or 0
    g = goals.where(F.col("blocks") > 0).select(F.col("source").alias("_source"), F.col("blocks").alias("_due"), (F.col("before") / n).alias("_c0"), ((F.col("before") + F.col("blocks")) / n).alias("_c1"))
    cells = F.sequence(F.floor(F.col("_c0") * CELLS), F.least(F.floor(F.col("_c1") * CELLS), F.lit(CELLS - 1).cast("long")))

    def dealt(first: int, last: int, to: DataFrame) -> DataFrame:
        x = (F.col("id") + 1).cast("double") * F.lit(float(golden))
        pts = spark.range(first, last).select(F.col("id").alias("_i"), (x - F.floor(x)).alias("_x")).withColumn("_cell", F.floor(F.col("_x") * CELLS).cast("long"))
        near = to.withColumn("_gc", F.explode(cells))
        return pts.join(near, (F.col("_cell") == F.col("_gc")) & (F.col("_x") >= F.col("_c0")) & (F.col("_x") < F.col("_c1"))).select("_source", "_due", "_i")

    met = dealt(0, n, g).groupBy(F.col("_source").alias("_s")).agg(F.count(F.lit(1)).alias("_met"))
    lack = g.join(met, F.col("_source").eqNullSafe(F.col("_s")), "left").where(F.coalesce("_met", F.lit(0)) < F.col("_due")).select(*g.columns)
    hit = dealt(0, n, g).unionByName(dealt(n, REACH * n, lack))
    hit = hit.select("_source", "_due", "_i", F.floor(F.col("_i") / 256).alias("_b"), F.floor(F.col("_i") / (256 * 1024)).alias("_c"), F.lit(1).alias("_one"))
    run = Window.partitionBy("_source", "_b").orderBy("_i")
    inner = hit.withColumn("_in", F.row_number().over(run) - 1)
    o = _offsets(hit, ["_source"], "_b", "_c", "_one")
    ranked = inner.join(o, F.col("_source").eqNullSafe(F.col("_o0")) & (F.col("_b") == F.col("_of")))
    return ranked.select(F.col("_source").alias("source"), (F.col("_in") + F.col("_offset")).cast("long").alias("rank"), F.col("_i").alias("position"), "_due").where(F.col("rank") < F.col("_due")).drop("_due")


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, block: int = BLOCK, seed: int = 0, golden: float = GOLDEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, targets) of a mix of the sources by weight.

    Each source's documents, in a shuffled order, make a stream of words that is cut into equal blocks. The
    schedule deals the mix's slots to the sources; a source's slot of rank r takes words [r * block, (r + 1) *
    block) of its stream, which starts again at its end, up to its target (to the nearest word). A block without a
    slot is not taken, see schedule(). So a source's words come to its target, no document is taken more than
    `epochs` times, and any first part of the mix has the sources in about their shares.
    documents: (_id, _source, _size, _r, _at), pieces: (_r, start, length, epoch, position), the words of a
    document that a slot takes; targets: as of targets(). _r names a row, so repeated ids stay apart.

    Null text has size 0 and is not taken; a null source is a source, the last. Ties in the order go by size, then by
    place in the table. A long text lies in many blocks, whole. An empty table gives empty results. Ids may be of any
    type; other columns, whatever their names, are ignored. Repeated rows are rows of their own.
    """
    spark = docs.sparkSession
    placed = common.stored(streams(docs, id_col, source_col, text_col, seed), "streams")
    sizes = placed.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    goals = common.stored(targets(sizes, weights, share, epochs, block), "targets")
    due = goals.select(F.col("source").alias("_s"), "source_size", F.round("target").cast("long").alias("goal"))
    slots = schedule(spark, goals, golden)
    slots = slots.join(F.broadcast(due) if goals.count() <= SOURCES else due, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # A block of the mix, as one or more runs of words of the unrepeated stream, each within one block of it.
    a, b = F.col("rank") * block, F.least((F.col("rank") + 1) * block, F.col("goal"))
    e = F.explode(F.sequence(F.floor(a / F.col("source_size")), F.floor((b - 1) / F.col("source_size"))))
    runs = slots.select("source", "source_size", "position", a.alias("_a"), b.alias("_z"), e.alias("epoch"))
    lo = F.greatest(F.col("_a"), F.col("epoch") * F.col("source_size")) - F.col("epoch") * F.col("source_size")
    hi = F.least(F.col("_z"), (F.col("epoch") + 1) * F.col("source_size")) - F.col("epoch") * F.col("source_size")
    runs = runs.select(F.col("source").alias("_s"), "position", "epoch", lo.alias("_lo"), hi.alias("_hi"))
    runs = runs.withColumn("_blk", F.explode(F.sequence(F.floor(F.col("_lo") / block), F.floor((F.col("_hi") - 1) / block))))
    parts = placed.where(F.col("_size") > 0).withColumn("_blk2", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("_size") - 1) / block))))
    start = F.greatest(F.col("_at"), F.col("_lo"), F.col("_blk") * block)
    end = F.least(F.col("_at") + F.col("_size"), F.col("_hi"), (F.col("_blk") + 1) * block)
    pieces = parts.join(runs, (F.col("_blk") == F.col("_blk2")) & F.col("_source").eqNullSafe(F.col("_s"))).where(end > start)
    return placed, pieces.select("_r", (start - F.col("_at")).alias("start"), (end - start).alias("length"), "epoch", "position"), goals


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", n_chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows of docs as the mix takes them: one row for each time, with the words taken as text, in ranges of the mix's places.

    A row stands where its first word has its place in the mix. A text that is taken whole stays as it is; of one taken in
    part (at most a few at the ends of a source's stream) the words are joined by single spaces. Rows that the mix
    does not take are left out, so empty texts are. Cases as of mix(); the columns of docs, whatever their names, stay.
    """
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    placed, pieces, _ = mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
    taken = pieces.groupBy("_r", "epoch").agg(F.min("start").alias("_from"), F.sum("length").alias("_len"), F.min("position").alias("_place"))
    taken = common.stored(placed.select("_id", "_source", "_size", "_r").join(taken, "_r").withColumnRenamed("_id", "_tid"), "taken")
    # Rows that repeat an id, a source and a size are told apart by their number among these.
    tie = Window.partitionBy("_tid", "_source", "_size", "epoch").orderBy("_r")
    taken = taken.withColumn("_nth", F.row_number().over(tie))
    own = Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64("_row"))
    field = lambda c: F.col("_row").getField(c)
    left = keyed.select(field(id_col).alias("_i"), field(source_col).cast("string").alias("_s"), size_of(field(text_col)).alias("_z"), "_row").withColumn("_n", F.row_number().over(own))
    on = F.col("_i").eqNullSafe(F.col("_tid")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_z") == F.col("_size")) & (F.col("_n") == F.col("_nth"))
    both = left.join(taken, on)
    both = both.repartitionByRange(F.col("_place")).sortWithinPartitions("_place", "_r", "epoch")
    text = field(text_col)
    cut = F.array_join(F.slice(F.filter(F.split(text, SPACE), lambda w: w != ""), (F.col("_from") + 1).cast("int"), F.col("_len").cast("int")), " ")
    now = F.when(F.col("_len") >= F.col("_size"), text).otherwise(cut)
    new = {text_col: now}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(F.col("_len") >= F.col("_size"), field(n_chars_col)).otherwise(F.length(now).cast(docs.schema[n_chars_col].dataType))
    return both.select(*(new[c].alias(c) if c in new else field(c).alias(c) for c in docs.columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of each row of docs: position is the place of its first word in the mix,
    null if nothing of it is taken. Cases as of mix()."""
    placed, pieces, goals = mix(docs, **options)
    taken = pieces.groupBy(F.col("_r").alias("_tr")).agg(F.sum("length").alias("taken"), F.min("position").alias("position"))
    out = placed.join(taken, F.col("_r") == F.col("_tr"), "left")
    out = out.join(F.broadcast(goals) if goals.count() <= SOURCES else goals, F.col("_source").eqNullSafe(F.col("source")))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('0:' || doc_id) AS h FROM documents),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM d),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size::DOUBLE AS cap FROM s),
c AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
l AS (SELECT *, (SELECT arg_min(level, cap / weight) FROM c WHERE level * weight <= cap) AS lv FROM c),
t AS (SELECT source, source_size, weight, least(cap, coalesce(lv * weight, cap)) AS target, ceil(round(target) / 1024.0)::BIGINT AS blocks FROM l),
u AS (SELECT *, (coalesce(sum(blocks) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(blocks) OVER ())::DOUBLE AS c0,
  (sum(blocks) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / (sum(blocks) OVER ())::DOUBLE AS c1 FROM t),
x AS (SELECT i, (i + 1)::DOUBLE * 0.6180339887498949::DOUBLE AS v FROM range((SELECT 4 * sum(blocks) FROM t)::BIGINT) r(i)),
h AS (SELECT source, blocks, i, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM x JOIN u ON v - floor(v) >= c0 AND v - floor(v) < c1),
k AS (SELECT source, rank, i FROM h WHERE rank < blocks)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (greatest(0, least(pos + size, round(target)) - least(pos, round(target)))
   + greatest(0, least(pos + size, round(target) - source_size) - pos))::BIGINT AS taken,
  CASE WHEN size > 0 AND pos < round(target) THEN k.i END AS position
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.source IS NOT DISTINCT FROM p.source AND k.rank = p.pos // 1024
"""
