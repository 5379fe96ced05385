"""Order-dependent operators: greedy folds, chains and components.

A fold runs over the sorted members of one exact partition key (a frame, a stretch of a survey), as a higher-order
function in the JVM. Surveys are cut where nothing before can meet anything behind, and scanned in ranges
(``ordered``), so their size is not bounded by a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.storage import stored
from .ordered import chains, laid_out, numbered, with_previous, with_running


def class_aware_nms(det: DataFrame, threshold: float = 0.45, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per frame and class, best confidence first: a detection stays if its overlap with all kept ones is at most ``threshold``.

    Columns of ``carry`` go along.
    """
    item = F.struct((-F.col("raw_confidence")).alias("k"), "detection_id", "x1", "y1", "x2", "y2", "raw_confidence", *carry)
    groups = det.groupBy("frame_id", "raw_class").agg(F.array_sort(F.collect_list(item)).alias("all"))
    over = lambda c: lambda a: boxes.iou(boxes.fields(a), boxes.fields(c)) > threshold
    kept = F.aggregate("all", F.filter("all", lambda c: F.lit(False)), lambda acc, c: F.when(F.exists(acc, over(c)), acc).otherwise(F.array_append(acc, c)))
    return groups.select("frame_id", "raw_class", F.explode(kept).alias("d")).select("frame_id", "raw_class", "d.detection_id", "d.raw_confidence", "d.x1", "d.y1", "d.x2", "d.y2", *[f"d.{c}" for c in carry])


def number_detections(det: DataFrame) -> DataFrame:
    """Number within the frame by confidence (best first), then place; the id carries it in four digits."""
    n = F.row_number().over(W.partitionBy("frame_id").orderBy(F.col("raw_confidence").desc(), "x1", "y1", "detection_id"))
    return det.withColumn("number", n).withColumn("numbered_id", F.format_string("%s_%04d", F.col("frame_id").cast("string"), n))


def relation(a: str, b: str, min_iou: float = 0.30) -> Column:
    """Why observation b may join the contact of a (column prefixes), or null.

    Same class. In one frame: duplicates of overlapping tiles. Across frames: only on the ping axis of one
    verified survey, where windows overlap and boxes share area there, or pipelines go on in the next ping at
    the same slant range.
    """
    c = lambda p, n: F.col(f"{p}{n}")
    na, nb = (boxes.named(p, ("nx1", "ny1", "nx2", "ny2")) for p in (a, b))
    duplicate = (c(a, "inference_mode") == "TILED") & (c(b, "inference_mode") == "TILED") & (c(a, "tile_id") != c(b, "tile_id"))
    duplicate = duplicate & ((boxes.iou(na, nb) >= min_iou) | boxes.contains_centre(na, nb) | boxes.contains_centre(nb, na))
    gap = F.greatest(c(a, "ping_start"), c(b, "ping_start")) - F.least(c(a, "ping_end"), c(b, "ping_end"))
    columns = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    pings = F.least(c(a, "ping_start") + c(a, "y2"), c(b, "ping_start") + c(b, "y2")) - F.greatest(c(a, "ping_start") + c(a, "y1"), c(b, "ping_start") + c(b, "y1"))
    offset = F.abs((c(a, "x1") + c(a, "x2")) / 2 - (c(b, "x1") + c(b, "x2")) / 2)
    near = offset <= F.greatest(F.least(c(a, "x2") - c(a, "x1"), c(b, "x2") - c(b, "x1")) * 0.25, F.lit(20.0))
    placed = c(a, "ping_start").isNotNull() & c(b, "ping_start").isNotNull() & (c(a, "survey_ref") == c(b, "survey_ref"))
    across = F.when(gap <= 0, F.when((columns > 0) & (pings > 0), "SAME_LOOK_OVERLAPPING_WINDOWS")).when((gap == 1) & (c(a, "raw_class") == "PIPELINE") & near, "INDEPENDENT_LOOKS_ALONG_TRACK")
    return F.when(c(a, "raw_class") == c(b, "raw_class"), F.when(c(a, "frame_id") == c(b, "frame_id"), F.when(duplicate, "TILE_OVERLAP_DUPLICATE")).when(placed, across))


_RELATIONS = ("TILE_OVERLAP_DUPLICATE", "SAME_LOOK_OVERLAPPING_WINDOWS", "INDEPENDENT_LOOKS_ALONG_TRACK")
_NUMBERS = ("tile_id", "x1", "y1", "x2", "y2", "nx1", "ny1", "nx2", "ny2", "ping_start", "ping_end")
#: Pairs of observations that are compared at a time.
PAIRS = 1 << 20


def _related(frame: np.ndarray, x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``relation`` of rows a with rows b of one survey and class, as a place in ``_RELATIONS``, or -1. NaN is null."""
    va, vb = ({n: v[at] for n, v in x.items()} for at in (a, b))
    lower, upper = np.fmin, np.fmax  # of a null and a value, the value
    same = frame[a] == frame[b]
    w, h = lower(va["nx2"], vb["nx2"]) - upper(va["nx1"], vb["nx1"]), lower(va["ny2"], vb["ny2"]) - upper(va["ny1"], vb["ny1"])
    area = [(v["nx2"] - v["nx1"]) * (v["ny2"] - v["ny1"]) for v in (va, vb)]
    iou = np.where((w <= 0) | (h <= 0), 0.0, w * h / (area[0] + area[1] - w * h))
    holds = lambda p, q: ((q["nx1"] + q["nx2"]) / 2 >= p["nx1"]) & ((q["nx1"] + q["nx2"]) / 2 <= p["nx2"]) & ((q["ny1"] + q["ny2"]) / 2 >= p["ny1"]) & ((q["ny1"] + q["ny2"]) / 2 <= p["ny2"])
    duplicate = same & va["tiled"] & vb["tiled"] & ((va["tile_id"] < vb["tile_id"]) | (va["tile_id"] > vb["tile_id"])) & ((iou >= 0.30) | holds(va, vb) | holds(vb, va))
    placed = ~same & ~np.isnan(va["ping_start"]) & ~np.isnan(vb["ping_start"])
    gap = upper(va["ping_start"], vb["ping_start"]) - lower(va["ping_end"], vb["ping_end"])
    columns = lower(va["x2"], vb["x2"]) - upper(va["x1"], vb["x1"])
    pings = lower(va["ping_start"] + va["y2"], vb["ping_start"] + vb["y2"]) - upper(va["ping_start"] + va["y1"], vb["ping_start"] + vb["y1"])
    offset = np.abs((va["x1"] + va["x2"]) / 2 - (vb["x1"] + vb["x2"]) / 2)
    near = offset <= upper(lower(va["x2"] - va["x1"], vb["x2"] - vb["x1"]) * 0.25, 20.0)
    return np.select([duplicate, placed & (gap <= 0) & (columns > 0) & (pings > 0), placed & (gap == 1) & va["pipeline"] & near], [0, 1, 2], -1)


def _pairs_of(reach: int):
    """Related pairs in rows that are sorted by survey, class, frame and id. Only frames that later rows can reach are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            rows = [x for x in (held, batch) if x is not None and x.num_rows]
            if not rows:
                continue
            t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            n, frame = t.num_rows, t.column("frame_id").to_numpy()
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = np.logical_or(*(pc.not_equal(t.column(c)[1:], t.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in ("survey_ref", "raw_class")))
            starts = [*np.flatnonzero(new).tolist(), n]
            end = np.concatenate([lo + np.searchsorted(frame[lo:hi], frame[lo:hi] + reach, "right") for lo, hi in zip(starts, starts[1:], strict=False)])
            done = n if batch is None else int(np.flatnonzero(end == n)[0])  # what comes next may belong to those that reach the last row
            held = None if batch is None else t.slice(done)
            if not done:
                continue
            x = {c: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _NUMBERS} | {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("tiled", "pipeline")}
            upto = np.cumsum(end[:done] - np.arange(done) - 1)
            at = 0
            while at < done:
                first = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, first + PAIRS, "right")))
                counts = end[at:to] - np.arange(at, to) - 1
                a = np.repeat(np.arange(at, to), counts)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
                kind = _related(frame, x, a, b)
                hit = np.flatnonzero(kind >= 0)
                ids = t.column("detection_id")
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a[hit])), ids.take(pa.array(b[hit])), pa.array(_RELATIONS, pa.string()).take(pa.array(kind[hit]))], names=["a", "b", "relation"])
                at = to

    return run


def related_pairs(obs: DataFrame, reach: int, block: str | None = None) -> DataFrame:
    """``a_id, b_id, relation``: pairs (a_id < b_id) of one survey whose frames lie at most ``reach`` apart and that ``relation`` names.

    Observations are sorted by survey, class and frame, and each meets those that follow it up to ``reach``: no pair of
    frames further apart is made. ``block``: a column that obs is dealt out by and that holds whole surveys; without it
    obs is dealt out by survey and class.
    """
    rows = obs.filter("survey_ref is not null and raw_class is not null and frame_id is not null and detection_id is not null")
    if block is None:
        rows = rows.repartition("survey_ref", "raw_class")
    numbers = [F.col(c).cast("double").alias(c) for c in _NUMBERS]
    flags = [F.coalesce(F.col("inference_mode") == "TILED", F.lit(False)).alias("tiled"), (F.col("raw_class") == "PIPELINE").alias("pipeline")]
    rows = rows.select("survey_ref", "raw_class", F.col("frame_id").cast("long").alias("frame_id"), "detection_id", *numbers, *flags)
    kind = obs.schema["detection_id"].dataType.simpleString()
    found = rows.sortWithinPartitions("survey_ref", "raw_class", "frame_id", "detection_id").mapInArrow(_pairs_of(reach), f"a {kind}, b {kind}, relation string")
    return found.filter("a <> b").select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), "relation")


OBSERVATION = ("detection_id", "frame_id", "tile_id", "raw_class", "inference_mode", "raw_confidence", "x1", "y1", "x2", "y2", "nx1", "ny1", "nx2", "ny2", "survey_ref", "ping_start", "ping_end")


def _relation_of(a: Column, b: Column) -> Column:
    """``relation`` on two structs."""
    duplicate = (a["inference_mode"] == "TILED") & (b["inference_mode"] == "TILED") & (a["tile_id"] != b["tile_id"])
    na, nb = boxes.fields(a, ("nx1", "ny1", "nx2", "ny2")), boxes.fields(b, ("nx1", "ny1", "nx2", "ny2"))
    duplicate = duplicate & ((boxes.iou(na, nb) >= 0.30) | boxes.contains_centre(na, nb) | boxes.contains_centre(nb, na))
    gap = F.greatest(a["ping_start"], b["ping_start"]) - F.least(a["ping_end"], b["ping_end"])
    columns = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    pings = F.least(a["ping_start"] + a["y2"], b["ping_start"] + b["y2"]) - F.greatest(a["ping_start"] + a["y1"], b["ping_start"] + b["y1"])
    near = F.abs((a["x1"] + a["x2"]) / 2 - (b["x1"] + b["x2"]) / 2) <= F.greatest(F.least(a["x2"] - a["x1"], b["x2"] - b["x1"]) * 0.25, F.lit(20.0))
    across = (gap <= 0) & (columns > 0) & (pings > 0) | (gap == 1) & (a["raw_class"] == "PIPELINE") & near
    return F.when(a["frame_id"] == b["frame_id"], duplicate).otherwise(F.coalesce(across, F.lit(False)))


def contact_segments(obs: DataFrame, block: str | None = None) -> DataFrame:
    """Observations with ``key``, ``segment`` (from 1 within the key) and ``member_no`` (from 0): pieces that no contact can cross.

    The key is exact: nothing relates across classes, nor across surveys or (unplaced) frames. In the order of pings, a
    contact reaches an observation only if its last member ends at the ping before or later. Where all that came before
    ended earlier, a segment begins. (Observations of one frame start at one ping.)

    ``block``: a column that obs is dealt out by, whose groups are bounded and hold whole keys. They are scanned where they
    are; without it keys are of any size and go through an ordered scan.
    """
    key = F.concat_ws("|", "raw_class", F.when(F.col("ping_start").isNotNull(), F.col("survey_ref")).otherwise(F.concat(F.lit("f"), F.col("frame_id").cast("string"))))
    order = [F.when(F.col("ping_start").isNotNull(), 0).otherwise(1), F.coalesce("ping_start", F.lit(0)), "frame_id", "detection_id"]
    if block:
        before = W.partitionBy(block, "key").orderBy(*order)
        rows = obs.select(block, *OBSERVATION).withColumn("key", key).withColumns({"_count": F.row_number().over(before), "_reach": F.max(F.greatest("ping_start", "ping_end")).over(before.rowsBetween(W.unboundedPreceding, -1))})
        cut = F.when(F.col("_reach").isNull(), F.col("_count") == 1).otherwise(F.col("_reach") < F.col("ping_start") - 1)
        rows = rows.withColumn("segment", F.sum(cut.cast("long")).over(before.rowsBetween(W.unboundedPreceding, 0)))
        return rows.withColumn("member_no", F.col("_count") - 1).drop("_count", "_reach")
    rows = laid_out(obs.select(*OBSERVATION).withColumn("key", key), ["key"], order)
    rows = with_running(rows, ["key"], sums={"_count": F.lit(1)}, highs={"_reach": F.greatest("ping_start", "ping_end")})
    cut = F.when(F.col("_reach").isNull(), F.col("_count") == 1).otherwise(F.col("_reach") < F.col("ping_start") - 1)
    rows = with_running(rows.withColumn("_cut", cut.cast("int")), ["key"], sums={"segment": F.col("_cut")})
    return rows.withColumn("member_no", F.col("_count") - 1).drop("_part", "_at", "_count", "_reach", "_cut")


def fuse_contacts(obs: DataFrame, block: str | None = None) -> DataFrame:
    """``detection_id, contact_no, member_no, key``: observations in ping order join the first contact whose last member relates.

    Each segment of a key is folded by itself; contacts are then numbered through the key. With ``block`` (as in
    ``contact_segments``) nothing is shuffled and the members keep that column.
    """
    segments, where = contact_segments(obs, block), [block] if block else []
    groups = segments.groupBy(*where, "key", "segment").agg(F.array_sort(F.collect_list(F.struct("member_no", F.struct(*OBSERVATION).alias("obs")))).alias("members"))
    groups = groups.withColumn("all", F.transform("members", lambda x: x["obs"]))
    # state: number and last member of the contacts that can still grow, how many there are, and where each observation went
    member = "struct<" + ",".join(f"{n}:{obs.schema[n].dataType.simpleString()}" for n in OBSERVATION) + ">"
    start = F.struct(F.array().cast(f"array<struct<no:int,o:{member}>>").alias("live"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("went"))

    def joined(acc: Column, x: Column, live: Column, at: Column) -> Column:
        """The next state; ``at``: place of the first related contact among ``live``, 0 for none."""
        to = F.when(at > 0, F.get(live, at - 1)["no"]).otherwise(acc["n"] + 1)
        entry = F.struct(to.alias("no"), x.alias("o"))
        grown = F.when(at > 0, F.transform(live, lambda a, i: F.when(i == at - 1, entry).otherwise(a))).otherwise(F.array_append(live, entry))
        return F.struct(grown.alias("live"), F.when(at > 0, acc["n"]).otherwise(acc["n"] + 1).alias("n"), F.array_append(acc["went"], to).alias("went"))

    def step(acc: Column, x: Column) -> Column:
        # in ping order, a contact that ended before the ping above this one relates to nothing that follows
        live = F.filter(acc["live"], lambda a: x["ping_start"].isNull() | (a["o"]["ping_end"] >= x["ping_start"] - 1))
        return _let(live, lambda v: _let(F.array_position(F.transform(v, lambda a: _relation_of(a["o"], x)), F.lit(True)).cast("int"), lambda at: joined(acc, x, v, at)))

    went = F.aggregate("all", start, step, lambda acc: acc["went"])
    if block:
        counted = groups.select(block, "key", "segment", "members", went.alias("went"))
        counted = counted.withColumn("n", F.array_max("went").cast("long")).withColumn("earlier", F.sum("n").over(W.partitionBy(block, "key").orderBy("segment").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        return _members(counted, block)
    folded = stored(groups.select("key", "segment", "members", went.alias("went")))
    counts = laid_out(folded.select("key", "segment", F.array_max("went").alias("n")), ["key"], ["segment"])
    before = with_running(counts, ["key"], sums={"upto": F.col("n")}).select("key", "segment", (F.col("upto") - F.col("n")).alias("earlier"))
    return _members(folded.join(before, ["key", "segment"]))


def _members(folded: DataFrame, *more: str) -> DataFrame:
    out = folded.select(*more, "key", "earlier", F.explode(F.arrays_zip("members", "went")).alias("z"))
    return out.select(*more, "key", (F.col("z.went") + F.col("earlier")).cast("int").alias("contact_no"), F.col("z.members.member_no").cast("int").alias("member_no"), "z.members.obs.*")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_detections(det: DataFrame, gt: DataFrame, tau: float) -> DataFrame:
    """Greedy one-to-one matching per frame and class: ``detection_id, gt_id`` of true positives.

    Detections go by score, then coordinates; each takes the free truth box of best overlap of at least ``tau``,
    the first by coordinates among equals.
    """
    d = F.array_sort(F.collect_list(F.struct((-F.col("raw_confidence")).alias("k"), "x1", "y1", "x2", "y2", "detection_id"))).alias("ds")
    g = F.array_sort(F.collect_list(F.struct(F.col("gx1").alias("x1"), F.col("gy1").alias("y1"), F.col("gx2").alias("x2"), F.col("gy2").alias("y2"), "gt_id"))).alias("gs")
    both = det.groupBy("frame_id", "raw_class").agg(d).join(gt.groupBy("frame_id", F.col("gt_class").alias("raw_class")).agg(g), ["frame_id", "raw_class"])
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<detection_id:string,gt_id:string>>").alias("pairs"))

    def step(acc: Column, x: Column) -> Column:
        free = F.transform(F.col("gs"), lambda t: F.struct(F.when(~F.array_contains(acc["used"], t["gt_id"]), boxes.iou(boxes.fields(x), boxes.fields(t))).alias("iou"), t["gt_id"].alias("gt_id")))
        ok = F.filter(free, lambda t: t["iou"] >= tau)
        best = lambda ok: F.aggregate(ok, F.get(ok, F.lit(0)), lambda m, t: F.when(t["iou"] > m["iou"], t).otherwise(m))["gt_id"]
        took = lambda g: F.struct(F.array_append(acc["used"], g).alias("used"), F.array_append(acc["pairs"], F.struct(x["detection_id"].alias("detection_id"), g.alias("gt_id"))).alias("pairs"))
        return _let(ok, lambda k: F.when(F.size(k) == 0, acc).otherwise(_let(best(k), took)))

    pairs = F.aggregate("ds", start, step, lambda acc: acc["pairs"])
    return both.select("frame_id", "raw_class", F.explode(pairs).alias("p")).select("frame_id", "raw_class", "p.detection_id", "p.gt_id")


def disjoint_lattice(frames: DataFrame, key: str, seconds: float = 25.0) -> DataFrame:
    """Per key: the first frame, then always the earliest at least ``seconds`` after the last chosen.

    A frame that follows the one before by ``seconds`` or more is chosen whatever came earlier, so keys are cut there
    and each stretch is folded by itself.
    """
    step_us = int(seconds * 1e6)
    rows = frames.select(key, "frame_id", F.unix_micros("ts").alias("t"))
    rows = chains(rows, [key], ["t", "frame_id"], ["t"], F.col("t") - F.col("prev_t") < step_us)
    g = rows.groupBy(key, "chain").agg(F.array_sort(F.collect_list(F.struct("t", "frame_id"))).alias("all"))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.filter("all", lambda x: F.lit(False)).alias("out"))
    step = lambda acc, x: F.when(acc["last"].isNull() | (x["t"] - acc["last"] >= step_us), F.struct(x["t"].alias("last"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)
    return g.select(key, F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("x")).select(key, "x.frame_id")


SPLITS = ("test", "train", "val")


def _filled(filled: dict[str, float], target: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = dict(filled)
        for b in batches:
            went = []
            for n in b.column("n").to_pylist():
                best = min(SPLITS, key=lambda k: (have[k] / target[k], have[k], k))
                have[best] += n
                went.append(best)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group_key", "n", "place")), pa.array(went, pa.string()), *(pa.array([have[k]] * len(went), pa.float64()) for k in SPLITS)], names=["group_key", "n", "place", "split", *SPLITS])

    return run


def assign_groups(groups: DataFrame, seed: int = 20260831, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), chunk: int = 100_000) -> DataFrame:
    """Groups (group_key, n) in seeded hash order; each goes to the split filled least for its share, then smallest, then first by name.

    Each choice depends on all before it, so chunks of ``chunk`` groups are filled one after another: a job for each,
    which hands three sums to the next. No task and no group holds more than a chunk.
    """
    spark = groups.sparkSession
    rows = groups.select("group_key", F.col("n").cast("double").alias("n"), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_key").cast("string")), 256).alias("h"))
    rows = stored(numbered(rows, ["h", "group_key"], "place").drop("h"))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("total")).first()
    target = {k: max(size.total * s, 1.0) for k, s in zip(("train", "val", "test"), shares, strict=True)}
    filled, done = dict.fromkeys(SPLITS, 0.0), None
    for first in range(0, size.rows, chunk):
        part = rows.filter(F.col("place").between(first + 1, first + chunk)).repartition(1).sortWithinPartitions("place")
        kind = rows.schema["group_key"].dataType.simpleString()
        part = stored(part.mapInArrow(_filled(filled, target), f"group_key {kind}, n double, place long, split string, {', '.join(f'{k} double' for k in SPLITS)}"))
        last = part.orderBy(F.col("place").desc()).select(*SPLITS).first()
        filled = last.asDict()
        done = part if done is None else done.unionByName(part)
    if done is None:
        return rows.select("group_key", "n", F.lit("").alias("split")).limit(0)
    return done.select("group_key", "n", "split")


def verified_chains(frames: DataFrame, pairs: DataFrame) -> DataFrame:
    """``frame_id, channel, chain, start``: frames (frame_id, channel, ts, width, height, split) of a channel in the order of time.

    A frame goes on with the chain of the one before if both have one geometry and their rows were verified to be
    shifted (``pairs``: later, earlier; either order). A linked pair in different splits shares pings across them and
    fails. ``start`` is the time of the chain's first frame.
    """
    rows = with_previous(laid_out(frames, ["channel"], ["ts", "frame_id"]), ["channel"], ["frame_id", "width", "height", "split"])
    both = pairs.select(F.least("later", "earlier").alias("_a"), F.greatest("later", "earlier").alias("_b")).distinct().withColumn("_verified", F.lit(True))
    rows = rows.withColumns({"_a": F.least("frame_id", "prev_frame_id"), "_b": F.greatest("frame_id", "prev_frame_id")}).join(both, ["_a", "_b"], "left")
    linked = F.col("prev_frame_id").isNotNull() & F.col("_verified").isNotNull() & F.col("width").eqNullSafe(F.col("prev_width")) & F.col("height").eqNullSafe(F.col("prev_height"))
    told = F.concat(F.lit("a verified chain crosses splits: frames "), F.col("prev_frame_id").cast("string"), F.lit(" and "), F.col("frame_id").cast("string"))
    opens = F.when(linked & ~F.col("split").eqNullSafe(F.col("prev_split")), F.raise_error(told).cast("int")).when(linked, 0).otherwise(1)
    rows = with_running(rows.withColumn("_new", opens), ["channel"], sums={"chain": F.col("_new")}, highs={"_s": F.when(F.col("_new") == 1, F.struct("ts", "frame_id"))})
    start = F.when(F.col("_new") == 1, F.col("ts")).otherwise(F.col("_s.ts"))  # the latest opening so far
    return rows.select("frame_id", "channel", "chain", start.alias("start"))
