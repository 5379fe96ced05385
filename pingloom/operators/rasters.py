"""Measures of rasters, from tables of samples (image_id, row_idx, col_idx, sample): two-level aggregates, no pixel loops.

Boxes are measured where their image is (``_measured``): each box is shuffled once, and no sample is copied to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def raster_condition(px: DataFrame) -> DataFrame:
    """Dynamic range, near-black share, dropout rows, entropy, central dark band, score, grade and flags (joined by pipes)."""
    x = F.col("sample").cast("double")
    base = px.groupBy("image_id").agg(F.percentile(x, 0.02).alias("p02"), F.percentile(x, 0.98).alias("p98"), F.percentile(x, 0.01).alias("p01"), F.min(x).alias("low"), F.max(x).alias("high"), (F.max("col_idx") + 1).alias("width"), (F.max("row_idx") + 1).alias("height"), F.count("*").alias("n"))
    base = base.withColumn("dynamic_range", (F.col("p98") - F.col("p02")) / F.greatest(F.lit(1.0), F.col("high") - F.col("low"))).withColumn("dark", F.greatest(F.lit(1.0), F.col("p01")))
    p = px.join(base.select("image_id", "dark", "low", "high", "width"), "image_id").withColumn("black", (x <= F.col("dark")).cast("double"))
    rows = p.groupBy("image_id", "row_idx").agg(F.avg("black").alias("b")).groupBy("image_id").agg(F.avg((F.col("b") >= 0.92).cast("double")).alias("dropout_fraction"), F.avg("b").alias("near_black_fraction"))
    centre = F.floor(F.col("width") / 2)
    eighth = F.floor(F.col("width") / 8)
    cols = p.groupBy("image_id", "width", "col_idx").agg(F.avg("black").alias("b")).filter((F.col("col_idx") >= centre - eighth) & (F.col("col_idx") < centre + eighth))
    cols = cols.groupBy("image_id", "width").agg(F.count_if(F.col("b") > 0.5).alias("run")).select("image_id", F.when(F.col("run") >= F.greatest(F.lit(3), F.floor(F.col("width") / 100)), F.col("run") / F.col("width")).otherwise(0.0).alias("nadir_fraction"))
    bin_ = F.least(F.lit(63), F.floor((x - F.col("low")) * 64 / (F.col("high") + 1e-6 - F.col("low"))))
    share = p.filter("high > low").groupBy("image_id", bin_.alias("bin")).agg(F.count("*").alias("c")).join(base.select("image_id", "n"), "image_id").withColumn("q", F.col("c") / F.col("n"))
    entropy = share.groupBy("image_id").agg((-F.sum(F.col("q") * F.log2("q")) / 6).alias("entropy"))
    out = base.join(rows, "image_id").join(cols, "image_id").join(entropy, "image_id", "left").withColumn("entropy", F.coalesce("entropy", F.lit(0.0)))  # one value only: no entropy
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.45 * F.col("dynamic_range") + 0.25 * F.col("entropy") + 0.30 * (1 - F.col("dropout_fraction") - F.col("near_black_fraction"))))
    flags = {
        "LOW_DYNAMIC_RANGE": F.col("dynamic_range") < 0.12, "HORIZONTAL_DARK_BAND": F.col("dropout_fraction") > 0.02,
        "HIGH_INVALID_PIXEL_FRACTION": F.col("near_black_fraction") > 0.2, "CENTRAL_DARK_BAND_ESTIMATED": F.col("nadir_fraction") > 0,
    }
    out = out.withColumn("quality_flags", F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return out.withColumn("quality_score", score).withColumn("quality_grade", F.when(F.col("quality_score") >= 0.7, "GOOD").when(F.col("quality_score") >= 0.45, "FAIR").otherwise("POOR"))


def raster_quality(px: DataFrame) -> DataFrame:
    """Speckle, dropout share and banding of row means."""
    x = F.col("sample").cast("double")
    whole = px.groupBy("image_id").agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg((x <= 1).cast("double")).alias("dropout"))
    rows = px.groupBy("image_id", "row_idx").agg(F.avg(x).alias("m"))
    diff = rows.withColumn("d", F.col("m") - F.lag("m").over(W.partitionBy("image_id").orderBy("row_idx"))).groupBy("image_id").agg(F.stddev_pop("d").alias("sd"))
    out = whole.join(diff, "image_id")
    return out.select("image_id", (F.col("std") / (F.col("mean") + 1e-6)).alias("speckle_index"), F.col("dropout").alias("dropout_fraction"), (F.col("sd") / (F.col("std") + 1e-6)).alias("banding"), ((F.col("dropout") < 0.35) & (F.col("std") > 3)).alias("usable"))


def nadir_by_profile(px: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Darkest row of the smoothed profile of row medians within the central 60 %, with its confidence."""
    rows = px.groupBy("image_id", "row_idx").agg(F.median("sample").alias("m"))
    near = W.partitionBy("image_id").orderBy("row_idx").rowsBetween(-7, 7)
    rows = rows.withColumn("s", F.sum("m").over(near) / 15).withColumn("h", F.count("*").over(W.partitionBy("image_id")))  # a row for each ping, few for an image
    lo, hi = F.floor(F.col("h") * 0.2), F.floor(F.col("h") * 0.8)
    r = rows.withColumns({"lo": lo, "hi": hi}).filter("row_idx >= lo and row_idx < hi")
    g = r.groupBy("image_id", "lo", "hi").agg(F.min_by("row_idx", F.struct("s", "row_idx")).alias("at"), F.min("s").alias("least"), F.percentile("s", F.lit(0.75)).alias("q3"), F.percentile("s", F.lit(0.25)).alias("q1"), F.percentile("s", F.lit(0.5)).alias("q2"))
    depth = F.greatest(F.lit(0.0), (F.col("q2") - F.col("least")) / (F.col("q3") - F.col("q1") + 1e-6))
    edge = F.least(F.col("at") - F.col("lo"), F.col("hi") - 1 - F.col("at")) / F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")) / 2)
    confidence = F.least(F.lit(1.0), 0.5 * F.least(depth / 2, F.lit(1.0)) + 0.5 * F.greatest(F.lit(0.0), edge))
    return g.select("image_id", confidence.alias("confidence"), F.when(confidence >= threshold, F.col("at").cast("double")).alias("nadir_row"), F.when(confidence >= threshold, "RECOVERED").otherwise("LOW_QUALITY").alias("state"))


def nadir_by_column_sum(px: DataFrame, share: float = 0.05) -> DataFrame:
    """Brightest column sum within ``share`` of the centre; the middle of a tie."""
    size = px.groupBy("image_id").agg((F.max("col_idx") + 1).alias("width"))
    sums = px.groupBy("image_id", "col_idx").agg(F.sum("sample").cast("bigint").alias("total")).join(size, "image_id")
    lo = F.greatest(F.lit(0), F.ceil(F.col("width") / 2 - share * F.col("width")))
    hi = F.least(F.col("width") - 1, F.floor(F.col("width") / 2 + share * F.col("width")))
    s = sums.filter(F.col("col_idx").between(lo, hi))
    top = s.groupBy("image_id").agg(F.max("total").alias("top"))
    return s.join(top, "image_id").filter("total = top").groupBy("image_id").agg(((F.min("col_idx") + F.max("col_idx")) / 2).alias("nadir_col"), F.count("*").alias("tied_columns"))


def equalise_lut(px: DataFrame) -> DataFrame:
    """Histogram equalisation table of the values that occur; an image of one value keeps it."""
    counts = px.groupBy("image_id", "sample").agg(F.count("*").alias("c"))
    w = W.partitionBy("image_id").orderBy("sample")  # 256 rows for an image at most
    counts = counts.withColumn("cdf", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("first", F.min("cdf").over(W.partitionBy("image_id"))).withColumn("total", F.sum("c").over(W.partitionBy("image_id")))
    level = F.bround(F.lit(255.0) * (F.col("cdf") - F.col("first")) / (F.col("total") - F.col("first"))).cast("int")
    return counts.select("image_id", "sample", F.when(F.col("total") == F.col("first"), F.col("sample")).otherwise(level).alias("level"))


def pool_cells(px: DataFrame, block: int = 4) -> DataFrame:
    """Block means of a feature map (channel = image), and each cell's vector scaled to length 1."""
    cell = px.groupBy("image_id", F.floor(F.col("row_idx") / block).alias("cy"), F.floor(F.col("col_idx") / block).alias("cx")).agg(F.avg("sample").alias("m"))
    norm = cell.groupBy("cy", "cx").agg(F.greatest(F.sqrt(F.sum(F.col("m") * F.col("m"))), F.lit(1e-12)).alias("len"))
    return cell.join(norm, ["cy", "cx"]).select("image_id", "cy", "cx", (F.col("m") / F.col("len")).alias("value"))


#: Samples of windows that are held at a time.
HELD = 1 << 21


class _Raster:
    """One image: its samples by row and column, a layer more where a place has several; ``lost`` rows and values for the whole."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, samples: np.ndarray, lost: np.ndarray, whole: dict):
        self.lost, self.whole = np.sort(lost), whole
        ok = ~np.isnan(samples) & (rows >= 0)
        rows, cols, samples = rows[ok], cols[ok], samples[ok]
        self.rows, r = np.unique(rows, return_inverse=True)
        self.cols, c = np.unique(cols, return_inverse=True)
        cell = r * len(self.cols) + c
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        layer = np.empty(len(cell), np.int64)
        layer[order] = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        whole_numbers = bool((np.abs(samples) < 1 << 20).all() and (samples == np.floor(samples)).all())  # these and their halves are exact in 32 bits
        self.grid = np.full((layer.max(initial=0) + 1, len(self.rows) + 1, len(self.cols) + 1), np.nan, np.float32 if whole_numbers else np.float64)
        self.grid[layer, r, c] = samples

    def windows(self, top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows (bottom and right are outside) of like size together: which they are, rows and columns, and samples (window, layer, row, column), NaN where there is none."""
        if not len(self.rows):
            return
        wide = np.maximum(bottom - top, 0) * np.maximum(right - left, 0) * len(self.grid) > HELD
        top, bottom = (np.where(wide, np.clip(x, self.rows[0], self.rows[-1] + 1), x) for x in (top, bottom))
        left, right = (np.where(wide, np.clip(x, self.cols[0], self.cols[-1] + 1), x) for x in (left, right))
        high, broad = bottom - top, right - left
        sizes, which = np.unique(np.stack([high, broad], 1), axis=0, return_inverse=True)
        for k, (h, w) in enumerate(sizes.tolist()):
            if h <= 0 or w <= 0:
                continue
            same, step = np.flatnonzero(which.reshape(-1) == k), max(1, HELD // (h * w * len(self.grid)))
            for at in (same[i : i + step] for i in range(0, len(same), step)):
                r, c = top[at, None] + np.arange(h), left[at, None] + np.arange(w)
                yield at, r, c, self.grid[:, self._place(self.rows, r)[:, :, None], self._place(self.cols, c)[:, None, :]].swapaxes(0, 1)

    @staticmethod
    def _place(present: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(present, wanted)
        return np.where(present[np.minimum(at, len(present) - 1)] == wanted, at, len(present))


def _measured(px: DataFrame, boxes: DataFrame, key: list[str], measure: Callable[[_Raster, dict], dict], names: list[str], whole: DataFrame | None = None, lost: DataFrame | None = None) -> DataFrame:
    """``boxes`` with the columns ``names`` (doubles) of ``measure``, which gets an image and different values of ``key``; null where it gives NaN.

    Images and their boxes are sorted into one stream, first the rows of an image, then its boxes by ``key``. A task
    holds one image and a batch of boxes; boxes of equal keys are measured once a batch. ``whole``: values of images;
    ``lost`` (image_id, row_idx): rows marked as such.
    """
    rows = px.groupBy("image_id", F.col("row_idx").cast("bigint").alias("row_idx")).agg(F.collect_list(F.struct(F.col("col_idx").cast("bigint").alias("c"), F.col("sample").cast("double").alias("s"))).alias("s"))
    rows = rows.select("image_id", "row_idx", F.col("s.c").alias("_cols"), F.col("s.s").alias("_samples"))
    if lost is not None:
        rows = rows.join(lost.select("image_id", F.col("row_idx").cast("bigint").alias("row_idx"), F.lit(True).alias("_lost")).distinct(), ["image_id", "row_idx"], "full")
    else:
        rows = rows.withColumn("_lost", F.lit(False))
    of_whole = [c for c in whole.columns if c != "image_id"] if whole is not None else []
    if whole is not None:
        rows = rows.join(whole.select("image_id", *[F.col(c).cast("double").alias(f"_w_{c}") for c in of_whole]), "image_id", "left")
    rows = rows.filter("image_id is not null").withColumn("_kind", F.lit(0)).withColumnRenamed("row_idx", "_row")
    kept = boxes.columns
    both = rows.unionByName(boxes.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    kind = both.schema["image_id"].dataType
    if boxes.schema["image_id"].dataType != kind:
        both = both.withColumn("image_id", F.col("image_id").cast(kind))
    both = both.repartition("image_id").sortWithinPartitions("image_id", "_kind", *key)

    def numbers(column: pa.Array) -> np.ndarray:
        return column.cast(pa.float64()).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the image that comes next
        image, raster = None, None
        for b in batches:
            ids, kinds = b.column("image_id"), b.column("_kind").to_numpy(zero_copy_only=False)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            differ = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) if len(ids) > 1 else np.zeros(0, bool)
            cuts = np.flatnonzero(differ | (np.diff(null.astype(np.int8)) != 0) | (np.diff(kinds) != 0)) + 1
            found = np.full((len(names), b.num_rows), np.nan)
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                now = ids[start].as_py()
                if image is None or now != image:
                    image, raster, held = now, None, []
                if not kinds[start]:
                    held.append(b.slice(start, end - start))
                    continue
                if now is None:
                    continue
                if raster is None:
                    raster, held = _raster(held, of_whole), []
                values = {k: numbers(b.column(k).slice(start, end - start)) for k in key}
                table = np.stack(list(values.values()))
                new = np.ones(end - start, bool)
                new[1:] = ((table[:, 1:] != table[:, :-1]) & ~(np.isnan(table[:, 1:]) & np.isnan(table[:, :-1]))).any(0)
                got = measure(raster, {k: x[new] for k, x in values.items()})
                for i, n in enumerate(names):
                    found[i, start:end] = got[n][np.cumsum(new) - 1]
            asked = np.flatnonzero(kinds)
            if len(asked):
                out = b.select(kept).take(pa.array(asked))
                yield pa.RecordBatch.from_arrays([*out.columns, *(pa.array(f[asked], pa.float64(), from_pandas=True) for f in found)], names=[*kept, *names])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*kept).schema] + [f"`{n}` double" for n in names])
    return both.mapInArrow(run, fields)


def _raster(held: list[pa.RecordBatch], of_whole: list[str]) -> _Raster:
    if not held:
        none = np.zeros(0)
        return _Raster(none.astype(np.int64), none.astype(np.int64), none, none, dict.fromkeys(of_whole, np.nan))
    t = pa.Table.from_batches(held).combine_chunks()
    rows = t.column("_row").to_numpy()
    size = pc.fill_null(pc.list_value_length(t.column("_cols")), 0).to_numpy()
    flat = lambda c, kind: np.asarray(pc.list_flatten(t.column(c)).cast(kind).to_numpy())
    lost = rows[pc.fill_null(t.column("_lost"), False).to_numpy()]
    whole = {c: x if (x := t.column(f"_w_{c}")[0].as_py()) is not None else np.nan for c in of_whole}
    return _Raster(np.repeat(rows, size), flat("_cols", pa.int64()), flat("_samples", pa.float64()), lost, whole)


def _middle(ordered: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Medians of rows in order, of which the first ``n`` count."""
    at = np.arange(len(n))
    return 0.5 * ordered[at, np.maximum(n - 1, 0) // 2].astype(float) + 0.5 * ordered[at, np.minimum(n // 2, ordered.shape[1] - 1)].astype(float)


def _mean(x: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Mean over rows, columns and layers where a sample stands and ``where`` (window, 1, row, column) holds; NaN without any."""
    ok = where & ~np.isnan(x)
    n = ok.sum((1, 2, 3))
    with np.errstate(invalid="ignore"):
        return np.where(ok, x, 0).sum((1, 2, 3), dtype=float) / np.where(n, n, np.nan)


def _contrasts(raster: _Raster, box: dict) -> dict:
    x1, y1, x2, y2 = (box[c].astype(np.int64) for c in ("x1", "y1", "x2", "y2"))
    pad = np.maximum(3, np.floor(np.maximum(x2 - x1, y2 - y1) * 0.5)).astype(np.int64)
    out = {n: np.full(len(pad), np.nan) for n in ("bg", "scale", "bright", "dark", "mean")}
    for at, r, c, x in raster.windows(y1 - pad, y2 + pad, x1 - pad, x2 + pad):
        flat = x.reshape(len(at), -1)
        n = (~np.isnan(flat)).sum(1)
        bg = _middle(np.sort(flat, 1), n)
        scale = np.maximum(1.0, _middle(np.sort(np.abs(flat - bg[:, None].astype(flat.dtype)), 1), n) * 1.4826)
        where = (((r >= y1[at, None]) & (r < y2[at, None]))[:, :, None] & ((c >= x1[at, None]) & (c < x2[at, None]))[:, None, :])[:, None]
        ok = where & ~np.isnan(x)
        inside = ok.sum((1, 2, 3))
        some = np.where(inside, inside, np.nan)
        share = lambda hit: (hit & ok).sum((1, 2, 3)) / some  # noqa: E731, B023
        on = lambda v: v[:, None, None, None]
        for name, value in (("bg", bg), ("scale", scale), ("bright", share(x >= on(bg + scale))), ("dark", share(x <= on(bg - scale))), ("mean", np.where(ok, x, 0).sum((1, 2, 3), dtype=float) / some)):
            out[name][at] = np.where(inside, value, np.nan)
    return out


def _whole(x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Whole numbers; 0 where it is not ``ok``."""
    return np.where(ok, x, 0).astype(np.int64)


def _sides(raster: _Raster, box: dict) -> dict:
    """Means within columns x1..x2 and s1..s2 of rows y1..y2, whether a lost row is among these, and values of the image; nothing without a nadir."""
    ok = ~np.isnan(box["nadir"])
    x1, x2, s1, s2, y1, y2 = (_whole(box[c], ok) for c in ("x1", "x2", "s1", "s2", "y1", "y2"))
    out = {n: np.full(len(ok), np.nan) for n in ("inside", "shade")}
    for at, _, c, x in raster.windows(y1, y2, np.minimum(x1, s1), np.maximum(x2, s2)):
        for name, lo, hi in (("inside", x1, x2), ("shade", s1, s2)):
            out[name][at] = _mean(x, ((c >= lo[at, None]) & (c < hi[at, None]))[:, None, None, :])
    out["lost"] = np.where(ok, np.maximum(np.searchsorted(raster.lost, y2) - np.searchsorted(raster.lost, y1), 0), np.nan)
    return out | {n: np.full(len(ok), v) for n, v in raster.whole.items()}


def _shades(raster: _Raster, box: dict) -> dict:
    """Mean and deviation beside a box's band of rows a..z, means of the band and of rows u..w behind and before the box, share of dark lines."""
    ok = box["_none"] == 0
    x1, x2, a, z, u, w = (box[c] for c in ("x1", "x2", "a", "z", "u", "w"))
    side = x2 - x1
    out = {n: np.full(len(ok), np.nan) for n in ("mean", "std", "dark", "bright", "lines")}
    top, bottom = (_whole(np.trunc(f(p, q)), ok) for f, p, q in ((np.minimum, a, u), (np.maximum, z, w)))
    for at, r, c, x in raster.windows(top, bottom, _whole(np.ceil(x1 - side), ok), _whole(np.ceil(x2 + side), ok)):
        part = lambda v, lo, hi: (v >= lo[at, None]) & (v < hi[at, None])  # noqa: E731, B023
        inside, band, light = part(c, x1, x2)[:, None, None, :], part(r, a, z)[:, None, :, None], part(r, u, w)[:, None, :, None]
        there = ~np.isnan(x)
        beside = band & ~inside
        mean = _mean(x, beside)
        std = np.sqrt(_mean((x - mean[:, None, None, None]) ** 2, beside))
        lit = there & band & inside
        held = lit.sum((1, 3))
        with np.errstate(invalid="ignore"):
            line = np.where(lit, x, 0).sum((1, 3), dtype=float) / np.where(held, held, np.nan)
            lines = (held > 0).sum(1)
            share = (line < (mean - 1.5 * std)[:, None]).sum(1) / np.where(lines, lines, np.nan)
        for name, value in (("mean", mean), ("std", std), ("dark", _mean(x, band & inside)), ("bright", _mean(x, light & inside)), ("lines", np.where(np.isnan(mean), np.nan, share))):
            out[name][at] = value
    return out


def hard_return(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bright and dark shares of each box (box_id, image_id, integer x1, y1, x2, y2) against its padded surroundings."""
    out = _measured(px, boxes.select("box_id", "image_id", "x1", "y1", "x2", "y2"), ["x1", "x2", "y1", "y2"], _contrasts, ["bg", "scale", "bright", "dark", "mean"]).filter("bg is not null")
    hard = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("bright") - 0.08) / 0.45))
    long = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / F.greatest(F.lit(1), F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    status = F.when((hard >= 0.55) & (long >= 3), "SUPPORTED").when(hard > 0.10, "WEAK_SUPPORT").when((F.col("dark") >= 0.70) & (F.col("bright") <= 0.08), "ACOUSTICALLY_INCONSISTENT").otherwise("INSUFFICIENT_EVIDENCE")
    return out.select("box_id", "bg", ((F.col("mean") - F.col("bg")) / F.col("scale")).alias("contrast"), "bright", "dark", hard.alias("hard"), status.alias("status"))


def orientation(px: DataFrame, boxes: DataFrame, dropped: DataFrame, width: int) -> DataFrame:
    """Highlight, shadow, direction and geometry scores of boxes (box_id, image_id, x1, y1, x2, y2, nadir, nadir_share) and their mean.

    The shadow lies on the side away from the ``nadir`` column; boxes without one have no score and the flag
    UNKNOWN_ORIENTATION, those without a sample INVALID_BBOX. ``dropped`` (image_id, row_idx) are rows without data;
    ``nadir_share`` is the width of the dark centre as a share of the image.
    """
    whole = px.groupBy("image_id").agg(F.median("sample").alias("base"), F.greatest(F.lit(1.0), F.stddev_pop("sample") * 2).alias("spread"))
    mid = (F.col("x1") + F.col("x2")) / 2
    away = mid > F.col("nadir")
    span = F.greatest(F.lit(2), F.col("x2") - F.col("x1"))
    b = boxes.withColumn("s1", F.when(away, F.col("x2")).otherwise(F.greatest(F.lit(0), F.col("x1") - span))).withColumn("s2", F.when(away, F.least(F.lit(width), F.col("x2") + span)).otherwise(F.col("x1"))).withColumn("span", span)
    b = b.select("box_id", "image_id", "x1", "y1", "x2", "y2", "nadir", "nadir_share", "s1", "s2", "span")  # what goes along is shuffled
    b = _measured(px, b, ["x1", "x2", "s1", "s2", "y1", "y2", "nadir"], _sides, ["inside", "shade", "lost", "base", "spread"], whole, dropped)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    seen, cols = F.col("shade").isNotNull(), F.col("s2") - F.col("s1")
    parts = {"highlight_score": clip((F.col("inside") - F.col("base")) / F.col("spread")), "shadow_score": F.when(seen, clip((F.col("base") - F.col("shade")) / F.col("spread"))), "direction_score": F.when(seen & (cols > 0), 1.0), "geometry_score": F.when(seen, F.least(F.lit(1.0), cols / F.col("span")))}
    met = F.col("inside").isNotNull()
    out = b.withColumns({n: F.when(met, c) for n, c in parts.items()})
    present = F.array_compact(F.array(*parts))
    out = out.withColumn("physics_consistency", F.when(met, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present)))
    nadir = (F.col("nadir_share") > 0) & (F.abs(mid - width / 2) <= F.col("nadir_share") * width / 2)
    flags = F.concat_ws(",", F.when(nadir, "NADIR_OVERLAP"), F.when(F.col("lost") > 0, "DROPOUT_OVERLAP"), F.lit("SHADOW_IS_NOT_ARTIFICIALITY"))
    return out.withColumn("flags", F.when(F.col("nadir").isNull(), "UNKNOWN_ORIENTATION").when(F.col("highlight_score").isNull(), "INVALID_BBOX").otherwise(flags))


def shadow(px: DataFrame, boxes: DataFrame, height: int, width: int) -> DataFrame:
    """Score of the dark band behind each box (the row side away from ``nadir``) against columns at its sides; or why there is none.

    contrast_z, continuity (share of dark lines), ordering_ok (the rows before the box are brighter than the sides) and
    score = 0.5 tanh(max(0, z) / 2) + 0.35 continuity + 0.15 ordering.
    """
    mid, high = (F.col("y1") + F.col("y2")) / 2, F.col("y2") - F.col("y1")
    length = F.least(3 * F.greatest(F.lit(1), high), F.lit(max(1, height / 4))).cast("int")
    down = mid > F.col("nadir")
    b = boxes.withColumn("len", length).withColumn("a", F.when(down, F.col("y2")).otherwise(F.col("y1") - F.col("len"))).withColumn("z", F.when(down, F.col("y2") + F.col("len")).otherwise(F.col("y1")))
    b = b.withColumn("u", F.when(down, F.col("y1") - high).otherwise(F.col("y2"))).withColumn("w", F.when(down, F.col("y1")).otherwise(F.col("y2") + high))
    reason = (
        F.when(F.col("nadir").isNull(), "NADIR_NOT_RECOVERABLE").when((F.col("x1") >= width) | (F.col("y1") >= height) | (F.col("x2") <= F.col("x1")) | (high <= 0), "INVALID_CANDIDATE_GEOMETRY")
        .when(F.abs(mid - F.col("nadir")) < F.greatest(F.lit(2.0), high / 2), "CANDIDATE_IN_NADIR_BAND").when((F.col("a") < 0) | (F.col("z") > height), "SHADOW_TRUNCATED_AT_RANGE_EDGE")
    )
    b = b.withColumn("reason", reason)
    measured = ["mean", "std", "dark", "bright", "lines"]
    b = b.select("box_id", "image_id", "x1", "x2", "a", "z", "u", "w", "reason", F.col("reason").isNotNull().cast("int").alias("_none"))  # what goes along is shuffled
    out = _measured(px, b, ["x1", "x2", "a", "z", "u", "w", "_none"], _shades, measured).drop("_none")
    late = F.when(F.col("mean").isNull(), "RANGE_MATCHED_BACKGROUND_UNAVAILABLE").when(F.col("std") < 1e-6, "RANGE_MATCHED_BACKGROUND_LOW_VARIANCE")
    out = out.withColumn("reason", F.coalesce("reason", late))
    given = lambda c: F.when(F.col("reason").isNull(), c)
    out = out.withColumns({"contrast_z": given(F.expr("try_divide(mean - dark, std)")), "continuity": given(F.col("lines")), "ordering_ok": given(F.coalesce(F.col("bright") > F.col("mean"), F.lit(False)))})
    score = 0.5 * F.tanh(F.greatest(F.lit(0.0), F.col("contrast_z")) / 2) + 0.35 * F.col("continuity") + 0.15 * F.col("ordering_ok").cast("double")
    return out.withColumn("score", given(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
