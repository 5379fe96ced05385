"""Mixing sources to target weights with a low-discrepancy schedule.

Slot t of the schedule falls on the golden-ratio point frac(t * phi); the point's place among the cumulative
target shares names the source. Slots are ranked within their source, and rank r takes block r (modulo the
number of blocks) of the source's shuffled documents: blocks of ``BLOCK`` tokens, so a long document spans
several. The last slot of a source is cut so that the taken tokens equal its rounded target.
The schedule also gives the order of the mix: a document comes at the slot of the first of its blocks,
and its copies come a cycle of its source later each.

Ranks and running sums are taken in two levels (sums of small ranges, then within a range), so a source that
holds most rows is spread over many tasks. Windows over all sources hold a row for each source.

Defined results: null text has size 0, takes 0 and has no slot; a null source is a source of its own and comes last in
weight order; repeated rows each keep their row (and shuffle by id and text, so equal ids do not share a range); a
very long text spans blocks; ties in the shuffle go by size; an empty table gives an empty result; other columns,
whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored
from .quality_rules import WORD_GAP

#: Tokens in a block.
BLOCK = 1024
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
PHI = 0.6180339887498949
_CELLS = 4096
_CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, WORD_GAP, -1), "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, size`` (a row for each source) to ``source, source_size, target``: shares by weight, held at ``most`` times the size.

    Sources are filled in order of cap / weight: those below the water line stop at their cap.
    """
    place = W.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1))
    s = s.withColumn("cap", most * F.col("size").cast("double"))
    fill = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    left = F.sum(F.col("size").cast("double")).over(W.partitionBy()) - F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("i", F.row_number().over(fill)).withColumn("line", left / F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", F.min_by(F.when(F.col("line") * F.col("w") <= F.col("cap"), F.col("line")), F.when(F.col("line") * F.col("w") <= F.col("cap"), F.col("i"))).over(W.partitionBy()))
    return s.select("source", F.col("size").alias("source_size"), F.round(F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("w")), 6).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Slots ``source, slot, rank`` in order of ``slot``; ``rank`` counts from 0 within the source up to the slots it needs."""
    spark = targets.sparkSession
    t = targets.filter("source_size > 0").withColumns({"quota": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / block)})
    t = t.withColumn("need", F.expr(f"(quota div source_size) * blocks + least(blocks, cast(ceil((quota % source_size) / {block}) as bigint))"))
    upto = F.sum("need").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    t = stored(t.withColumn("upto", upto).select("source", "need", (F.col("upto") - F.col("need")).alias("from"), "upto"))
    total = t.agg(F.coalesce(F.max("upto"), F.lit(0)).alias("n")).first().n
    t = t.withColumns({"lo": F.col("from") / max(1, total), "hi": F.col("upto") / max(1, total)}).filter("need > 0")
    cells = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.least(F.lit(_CELLS - 1).cast("long"), F.floor(F.col("hi") * _CELLS)))))
    u = F.col("slot") * F.lit(PHI)
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * _CELLS))
    slots = slots.join(cells, "cell").filter("u >= lo and u < hi").select("source", "slot", "need", F.expr(f"slot div {_CHUNK}").alias("chunk"))
    per = slots.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("r", F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1).alias("a").join(per.alias("b"), _same("a.source", "b.source") & F.expr("a.chunk = b.chunk"))
    ranked = ranked.select("a.source", "slot", (F.col("r") + F.col("before")).alias("rank"), "need").filter("rank < need")
    # the discrepancy of the points leaves a source a few slots short: they follow at the end
    got = slots.groupBy("source").agg(F.count(F.lit(1)).alias("got"))
    short = t.alias("t").join(got.alias("g"), _same("t.source", "g.source"), "left").select("t.source", "need", F.coalesce("got", F.lit(0)).alias("got")).filter("got < need")
    short = short.select("source", F.lit(total).alias("slot"), F.explode(F.expr("sequence(got, need - 1)")).alias("rank"))
    return ranked.select("source", "slot", "rank").unionByName(short)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, slot (null: takes none) and cycle (slots from copy to copy)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), h.alias("h")).withColumn("range", F.substring("h", 1, 3))
    d = stored(d)
    ranges = stored(d.groupBy("source", "range").agg(F.sum("size").alias("n")))
    targets = stored(source_targets(ranges.groupBy("source").agg(F.sum("n").alias("size")), weights, most).withColumn("all_size", F.sum("source_size").over(W.partitionBy())))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("source", "range").orderBy("h", "size", F.col("doc_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("upto", F.sum("size").over(inside)).alias("d").join(ranges.alias("r"), _same("d.source", "r.source") & F.expr("d.range = r.range"))
    d = d.select("doc_id", "d.source", "size", (F.col("before") + F.col("upto") - F.col("size")).alias("start"))
    d = d.alias("d").join(targets.alias("t"), _same("d.source", "t.source")).select("doc_id", "d.source", "size", "start", "source_size", "target", "all_size")
    # slots meet blocks: how often a block is taken whole, and how far by the last slot
    slots = schedule(targets, block).alias("s").join(targets.alias("t"), _same("s.source", "t.source")).select("s.source", "slot", "rank", "source_size", F.round("target").cast("long").alias("quota"))
    slots = slots.withColumn("blocks", F.ceil(F.col("source_size") / block)).withColumn("block", F.expr("rank % blocks"))
    slots = slots.withColumn("width", F.expr(f"least({block}, source_size - block * {block})"))
    slots = slots.withColumn("take", F.expr(f"least(width, quota - (rank div blocks) * source_size - block * {block})"))
    taken = slots.groupBy("source", "block").agg(F.sum((F.col("take") == F.col("width")).cast("long")).alias("whole"), F.max(F.when(F.col("take") < F.col("width"), F.col("take"))).alias("part"), F.min("slot").alias("slot"))
    pieces = d.filter("size > 0").withColumn("block", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")))
    pieces = pieces.select("source", "block", F.col("doc_id").alias("p_id"), F.col("start").alias("p_start"), F.expr(f"greatest(0, start - block * {block})").alias("a"), F.expr(f"least({block}, start + size - block * {block})").alias("b"))
    pieces = pieces.alias("p").join(taken.alias("k"), _same("p.source", "k.source") & F.expr("p.block = k.block"))
    pieces = pieces.select("p.source", "p_start", "slot", (F.col("whole") * (F.col("b") - F.col("a")) + F.greatest(F.lit(0), F.least("b", F.coalesce("part", F.lit(0))) - F.col("a"))).alias("n"))
    pieces = pieces.groupBy("source", "p_start").agg(F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("slot"))).alias("slot"))  # documents with words start at places of their own
    out = d.alias("d").join(pieces.alias("p"), _same("d.source", "p.source") & F.expr("d.start = p.p_start and d.size > 0"), "left")
    # a source's blocks are gone through once in about this many slots of the schedule
    cycle = F.round(F.col("source_size") / F.greatest("target", F.lit(1.0)) * F.col("all_size") / block, 6)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"), "slot", cycle.alias("cycle"))
