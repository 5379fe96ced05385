"""Joins of survey tables. Theta conditions always stand on top of an equality (frame, survey, band, digest)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.storage import stored

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)


def tile_annotations(tiles: DataFrame, ann: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """Tiles (frame_id, x0, y0) that a box (xywh: bx, by, bw, bh) of their frame overlaps; meets on the tile's index, not on all tiles."""
    first = lambda lo: F.greatest(F.lit(0), F.floor((F.col(lo) - size) / stride) + 1).cast("int")
    last = lambda lo, n: F.greatest(F.lit(0), F.ceil((F.col(lo) + F.col(n)) / stride) - 1).cast("int")
    spread = ann.withColumn("_i", F.explode(F.sequence(first("bx"), F.greatest(first("bx"), last("bx", "bw"))))).withColumn("_j", F.explode(F.sequence(first("by"), F.greatest(first("by"), last("by", "bh")))))
    t = tiles.withColumn("_i", (F.col("x0") / stride).cast("int")).withColumn("_j", (F.col("y0") / stride).cast("int"))
    return spread.join(t, ["frame_id", "_i", "_j"]).filter((F.col("bx") < F.col("x0") + size) & (F.col("bx") + F.col("bw") > F.col("x0")) & (F.col("by") < F.col("y0") + size) & (F.col("by") + F.col("bh") > F.col("y0"))).drop("_i", "_j")


def annotated_tiles(frames: DataFrame, ann: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """``tile_annotations`` on the grid of each frame (frame_id, width, height): only tiles that a box meets are ever made.

    Frames grow with the boxes, so they are not sent to all tasks.
    """
    both = ann.join(frames.select("frame_id", "width", "height").hint("merge"), "frame_id")

    def places(lo: str, n: str, length: str) -> Column:
        tiles = F.when(F.col(length) <= size, 1).otherwise(F.ceil(F.col(length) / stride))
        first = F.greatest(F.lit(0), F.floor((F.col(lo) - size) / stride) + 1)
        last = F.least(F.greatest(first, F.ceil((F.col(lo) + F.col(n)) / stride) - 1), tiles - 1)
        return F.when(tiles.isNotNull() & (first <= last), F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda i: i * stride))

    out = both.withColumn("x0", F.explode(places("bx", "bw", "width"))).withColumn("y0", F.explode(places("by", "bh", "height"))).drop("width", "height")
    return out.filter((F.col("bx") < F.col("x0") + size) & (F.col("bx") + F.col("bw") > F.col("x0")) & (F.col("by") < F.col("y0") + size) & (F.col("by") + F.col("bh") > F.col("y0")))


def overlapping_pairs(det: DataFrame, keys: list[str], condition: Column | None = None, least: float = 0.30) -> DataFrame:
    """Ordered pairs (a, b) of detections with equal ``keys`` whose IoU is at least ``least``; each with itself too."""
    a, b = det.alias("a"), det.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on).filter(boxes.iou(boxes.named("a."), boxes.named("b.")) >= least)


#: Bits of the difference hash in each band; hashes that differ in four bits or fewer agree in four of the eight bands.
BANDS = (8, 8, 8, 8, 8, 8, 8, 7)
#: Different hashes that are compared with each other where they share a key; more of them get a longer key.
MOST_ALIKE = 128


def with_difference_hash(images: DataFrame, column: str = "x") -> DataFrame:
    """``images`` (64 samples each) with ``h``: a bit for each neighbour pair that rises, 63 in all."""
    x = F.col(column)
    bits = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: F.when(F.get(x, i) < F.get(x, i + 1), F.expr("1L")).otherwise(F.expr("0L")))
    value = F.aggregate(F.reverse(bits), F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return images.withColumn("h", value)


def _key_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n"))


def _flips(mask: str, n: int) -> Column:
    """Values with up to ``n`` of the 63 bits set, none of which ``mask`` covers."""
    free = F.filter(F.expr("transform(sequence(0, 62), i -> shiftleft(1L, i))"), lambda v: v.bitwiseAND(F.col(mask)) == 0)
    sets = F.array(F.lit(0).cast("bigint"))
    for _ in range(n):  # each set grows by bits above its highest
        sets = F.array_distinct(F.concat(sets, F.flatten(F.transform(sets, lambda s: F.transform(F.filter(free, lambda v: v > s), lambda v: v.bitwiseOR(s))))))
    return sets


def near_hashes(hashes: DataFrame, most: int = 4, most_alike: int = MOST_ALIKE) -> DataFrame:
    """Pairs ``p <= q`` of hashes (h: 63 bits, distinct; splits: sorted names) that differ in ``most`` (4 at most) bits or fewer and have different splits, with ``distance``.

    Such hashes agree in at least four of eight bands. They meet on two of these; a key that more than ``most_alike``
    hashes share gives way to keys with one band more, up to four bands. Where even those are shared by many, each
    hash is joined with the values one or two bits away from it (outside of the bands that agree): two hashes at
    distance 4 have one of these in common, and hashes that share one are near. So no key compares many hashes that
    are not near, however the hashes are spread.
    """
    if not 0 <= most <= 4:
        raise ValueError("at most four bits may differ")
    at, masks = 0, []
    for width in BANDS:
        masks.append(((1 << width) - 1) << at)
        at += width
    # the two first of four bands that agree; each further one lies behind
    start = [F.struct(F.lit(j).alias("last"), F.lit(masks[i] | masks[j]).cast("bigint").alias("mask")) for j in range(1, 6) for i in range(j)]
    keys = hashes.select("h", "splits", F.inline(F.array(*start))).withColumn("bits", F.col("h").bitwiseAND(F.col("mask")))
    differ = "(size(a.splits) > 1 or size(b.splits) > 1 or a.splits <> b.splits)"
    apart = F.bit_count(F.col("a.h").bitwiseXOR(F.col("b.h")))
    found = []

    def met(keys: DataFrame) -> DataFrame:
        both = keys.alias("a").join(keys.alias("b"), F.expr(f"a.mask = b.mask and a.bits = b.bits and a.h <= b.h and {differ}") & (apart <= most))
        return both.select(F.col("a.h").alias("p"), F.col("b.h").alias("q"), apart.cast("bigint").alias("distance"))

    for bands in (2, 3, 4):
        keys = stored(keys)
        often = stored(_key_counts(keys).filter(F.col("n") > most_alike).select("mask", "bits"))
        found.append(met(keys.join(often, ["mask", "bits"], "left_anti")))
        keys = keys.join(often, ["mask", "bits"])
        if often.isEmpty():
            return _all(found)
        if bands < 4:
            longer = F.array(*[F.struct(F.lit(k).alias("next"), F.lit(m).cast("bigint").alias("more")) for k, m in enumerate(masks)])
            keys = keys.select("h", "splits", "last", "mask", F.inline(longer)).filter(f"next > last and next < {len(BANDS) - 3 + bands}")
            keys = keys.select("h", "splits", F.col("next").alias("last"), F.col("mask").bitwiseOR(F.col("more")).alias("mask")).withColumn("bits", F.col("h").bitwiseAND(F.col("mask")))
    near = keys.select("h", "splits", "mask", F.explode(_flips("mask", 2)).alias("flip")).withColumn("bits", F.col("h").bitwiseXOR(F.col("flip")))
    found.append(met(near))
    return _all(found)


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(images: DataFrame, most: int = 4, mean: float = 2.0, q95: float = 8.0, most_alike: int = MOST_ALIKE) -> DataFrame:
    """``a_id, b_id, distance``: images (id, split, x, h) of different splits whose hashes differ in ``most`` bits or fewer, confirmed by their samples.

    Equal hashes are one row while hashes are compared, with the splits that hold them; images join in only for pairs
    of hashes that are near. A pair is confirmed by the mean and the 95 % quantile of its sample differences.
    """
    hashes = stored(images.filter("h is not null").groupBy("h").agg(F.array_sort(F.collect_set("split")).alias("splits")))  # a set of a few names
    met = near_hashes(hashes, most, most_alike)
    one, two = images.select(F.col("h").alias("p"), F.col("id").alias("i"), F.col("split").alias("s"), F.col("x").alias("x")), images.select(F.col("h").alias("q"), F.col("id").alias("j"), F.col("split").alias("t"), F.col("x").alias("y"))
    pairs = met.join(one, "p").join(two, "q").filter("s <> t and (p <> q or i < j)")
    d = F.zip_with("x", "y", lambda u, w: F.abs(u - w))
    pairs = pairs.withColumn("d", F.array_sort(d)).withColumn("n", F.size("d"))
    place = (F.col("n") - 1) * 0.95
    low = F.floor(place).cast("int")
    quantile = F.get("d", low) + (place - low) * (F.get("d", F.least(low + 1, F.col("n") - 1)) - F.get("d", low))
    sure = (F.aggregate("d", F.lit(0.0), lambda s, z: s + z) / F.col("n") <= mean) & (quantile <= q95)
    return pairs.filter(sure).select(F.least("i", "j").alias("a_id"), F.greatest("i", "j").alias("b_id"), "distance")


LEVELS = ("L0", "L1", "L2", "L3")


def compare_surveys(baseline: DataFrame, new: DataFrame, level: str = "L2", confirmed_only: bool = False) -> DataFrame:
    """Changes from baseline (id, covered) to new (id, matched_id): each new record answers for one baseline record only.

    UNCHANGED where matched; else NOT_DETECTED where covered and NOT_SURVEYED where not; left-over new ones are NEW.
    Removal is never inferred. Surveys placed below L2 are refused. ``confirmed_only``: baseline records whose
    ``verdict`` is CONFIRMED.
    """
    if LEVELS.index(level) < LEVELS.index("L2"):
        raise ValueError(f"surveys of level {level} cannot be compared")
    if confirmed_only:
        baseline = baseline.filter("verdict = 'CONFIRMED'")
    from pyspark.sql import Window as W

    one = new.filter("matched_id is not null").withColumn("_n", F.row_number().over(W.partitionBy("matched_id").orderBy("new_id"))).filter("_n = 1").drop("_n")
    old = baseline.join(one, baseline["base_id"] == one["matched_id"], "left")
    kept = old.select("base_id", "new_id", F.when(F.col("new_id").isNotNull(), "UNCHANGED").when(F.col("covered"), "NOT_DETECTED").otherwise("NOT_SURVEYED").alias("status"))
    used = kept.filter("new_id is not null").select("new_id")
    fresh = new.join(used, "new_id", "left_anti").select(F.lit(None).cast("string").alias("base_id"), "new_id", F.lit("NEW").alias("status"))
    return kept.unionByName(fresh)


def _shift_keys(share: float):
    """Hashes of the last height - k rows (side 0) and the first height - k rows (side 1) of each content, for k from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, height, rows, hashes in zip(*(b.column(c).to_pylist() for c in ("content", "height", "idx", "hashes")), strict=True):
                x, gap = np.zeros(height, np.int64), np.ones(height, np.int64)
                x[rows], gap[rows] = hashes, 0
                power, back = (np.cumprod(np.append(np.uint64(1), np.full(height, r, np.uint64)), dtype=np.uint64) for r in (_R, _R_INV))
                sums = np.append(np.uint64(0), np.cumsum(x.view(np.uint64) * power[:-1], dtype=np.uint64))
                gaps = np.append(0, np.cumsum(gap))
                k = np.arange(1, int(height * share) + 1)
                k = k[k < height]
                last, first = (sums[height] - sums[k]) * back[k], sums[height - k]
                whole = np.concatenate([gaps[height] == gaps[k], gaps[height - k] == 0])  # a missing row equals none
                side = np.repeat([0, 1], len(k))[whole]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([content] * len(side), pa.string()), pa.array(np.full(len(side), height)), pa.array(np.tile(k, 2)[whole]), pa.array(side), pa.array(np.concatenate([last, first]).view(np.int64)[whole])],
                    names=["content", "height", "k", "side", "key"],
                )

    return run


def row_shift_pairs(rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Frames of one geometry whose rows repeat at exactly one shift: ``later, earlier, k``.

    ``rows``: frame_id, height, row_idx, digest. A pair matches at k if all rows of later from k on equal those of
    earlier up to height - k. Runs of rows meet by hash on (height, k) and are confirmed by their digests; a pair that
    matches at several shifts is refused. Frames with equal rows all through match at k = 0 too and never verify with
    each other, so each content is compared once, however many frames hold it.
    """
    kept = rows.filter("digest is not null and row_idx >= 0 and row_idx < height").withColumn("row_idx", F.col("row_idx").cast("int"))
    whole = kept.groupBy("frame_id", F.col("height").cast("bigint").alias("height")).agg(F.sort_array(F.collect_list(F.struct("row_idx", "digest"))).alias("rows"))
    whole = stored(whole.withColumn("content", F.sha2(F.to_json("rows"), 256)))
    contents = whole.groupBy("height", "content").agg(F.first("rows").alias("rows"))
    held = contents.select("content", "height", F.col("rows.row_idx").alias("idx"), F.transform("rows", lambda r: F.xxhash64(r["digest"])).alias("hashes"))
    keys = stored(held.mapInArrow(_shift_keys(share), "content string, height bigint, k bigint, side bigint, key bigint"))
    a, b = keys.filter("side = 0").alias("a"), keys.filter("side = 1").alias("b")
    met = a.join(b, F.expr("a.height = b.height and a.k = b.k and a.key = b.key and a.content <> b.content"))
    met = met.select("a.height", "a.k", F.col("a.content").alias("later"), F.col("b.content").alias("earlier"))
    digests = contents.select("height", "content", F.col("rows.digest").alias("d"))
    met = met.join(digests.withColumnsRenamed({"content": "later", "d": "x"}), ["height", "later"]).join(digests.withColumnsRenamed({"content": "earlier", "d": "y"}), ["height", "earlier"])
    n = (F.col("height") - F.col("k")).cast("int")
    full = met.filter(F.slice("x", -n, n) == F.slice("y", F.lit(1), n))
    one = full.groupBy("height", F.array_sort(F.array("later", "earlier")).alias("pair")).agg(F.count("*").alias("n"), F.max("k").alias("k"), F.max("later").alias("later"), F.max("earlier").alias("earlier")).filter("n = 1")
    frames = lambda side: whole.select("height", F.col("content").alias(side), F.col("frame_id").alias(f"{side}_frame"))
    out = one.join(frames("later"), ["height", "later"]).join(frames("earlier"), ["height", "earlier"])
    return out.select(F.col("later_frame").alias("later"), F.col("earlier_frame").alias("earlier"), "k")


def key_difference(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``key, side`` (missing or extra)."""
    missing = expected.select(key).distinct().join(present.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(present.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("extra")))
