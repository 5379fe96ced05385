"""Measures of boxes on rasters: no sample is copied to a box, and the figures are those of plain loops."""

import statistics

from pingloom.operators import rasters as R

PX = {(r, c): (r * 37 + c * 11 + r * c) % 97 for r in range(12) for c in range(9) if (r, c) not in {(3, 3), (3, 4)} and r != 7}
BOXES = [("a", 1, 2, 2, 5, 5), ("same", 1, 2, 2, 5, 5), ("edge", 1, 0, 0, 4, 3), ("over", 1, 7, 10, 12, 14), ("outside", 1, 40, 40, 44, 44), ("lone", 2, 0, 0, 2, 2), ("no image", 3, 0, 0, 2, 2), (None, None, 0, 0, 2, 2)]


def _tables(spark, fields="box_id string, image_id long, x1 int, y1 int, x2 int, y2 int", boxes=BOXES):
    px = [(1, r, c, v) for (r, c), v in PX.items()] + [(1, 4, 4, 90), (2, 0, 0, 5), (2, 1, 1, 8)]  # one place has two samples
    return spark.createDataFrame(px, "image_id long, row_idx long, col_idx int, sample int").repartition(3), spark.createDataFrame(boxes, fields)


def _samples(px, image, top, bottom, left, right):
    return [r.sample for r in px if r.image_id == image and max(0, top) <= r.row_idx < bottom and left <= r.col_idx < right]


def test_hard_return_joins_no_samples(spark):
    px, boxes = _tables(spark)
    out = R.hard_return(px, boxes)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, rows = {r.box_id: r for r in out.collect()}, px.collect()
    assert set(got) == {"a", "same", "edge", "over", "lone"}
    for name, image, x1, y1, x2, y2 in BOXES:
        if name not in got:
            continue
        pad = max(3, max(x2 - x1, y2 - y1) // 2)
        near, inside = _samples(rows, image, y1 - pad, y2 + pad, x1 - pad, x2 + pad), _samples(rows, image, y1, y2, x1, x2)
        bg = statistics.median(near)
        scale = max(1, 1.4826 * statistics.median(abs(s - bg) for s in near))
        assert got[name].bg == bg
        assert abs(got[name].contrast - (statistics.mean(inside) - bg) / scale) < 1e-9
        assert abs(got[name].bright - sum(s >= bg + scale for s in inside) / len(inside)) < 1e-12
        assert abs(got[name].dark - sum(s <= bg - scale for s in inside) / len(inside)) < 1e-12


def test_shadow_joins_no_samples(spark):
    boxes = [("down", 1, 2, 4, 5, 6, 1.0), ("up", 1, 2, 5, 5, 7, 11.0), ("no nadir", 1, 2, 4, 5, 6, None), ("cut", 1, 2, 10, 5, 12, 1.0), ("no image", 3, 2, 4, 5, 6, 1.0)]
    px, boxes = _tables(spark, "box_id string, image_id long, x1 int, y1 int, x2 int, y2 int, nadir double", boxes)
    out = R.shadow(px, boxes, 12, 9)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, rows = {r.box_id: r for r in out.collect()}, px.collect()
    assert {n: r.reason for n, r in got.items()} == {"down": None, "up": None, "no nadir": "NADIR_NOT_RECOVERABLE", "cut": "SHADOW_TRUNCATED_AT_RANGE_EDGE", "no image": "RANGE_MATCHED_BACKGROUND_UNAVAILABLE"}
    for name, a, z, u, w in (("down", 6, 9, 2, 4), ("up", 2, 5, 7, 9)):  # length 3: a quarter of the height
        beside = _samples(rows, 1, a, z, -1, 2) + _samples(rows, 1, a, z, 5, 8)
        mean, std = statistics.mean(beside), statistics.pstdev(beside)
        lines = [statistics.mean(x) < mean - 1.5 * std for r in range(a, z) if (x := _samples(rows, 1, r, r + 1, 2, 5))]
        assert abs(got[name].contrast_z - (mean - statistics.mean(_samples(rows, 1, a, z, 2, 5))) / std) < 1e-9
        assert got[name].continuity == sum(lines) / len(lines)
        assert got[name].ordering_ok == (statistics.mean(_samples(rows, 1, u, w, 2, 5)) > mean)


def test_orientation_copies_no_box_to_rows(spark):
    boxes = [("right", 1, 5, 2, 7, 5, 3.0, 0.1), ("left", 1, 2, 6, 4, 9, 6.0, 0.0), ("unknown", 1, 2, 2, 4, 4, None, 0.0), ("outside", 1, 40, 2, 44, 5, 3.0, 0.0)]
    px, boxes = _tables(spark, "box_id string, image_id long, x1 int, y1 int, x2 int, y2 int, nadir double, nadir_share double", boxes)
    out = R.orientation(px, boxes, spark.createDataFrame([(1, 4), (1, 4), (9, 1)], "image_id long, row_idx long"), 9)
    assert "Explode" not in out._jdf.queryExecution().optimizedPlan().toString() and "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, rows = {r.box_id: r for r in out.collect()}, px.collect()
    assert {n: r.flags for n, r in got.items()} == {"right": "DROPOUT_OVERLAP,SHADOW_IS_NOT_ARTIFICIALITY", "left": "SHADOW_IS_NOT_ARTIFICIALITY", "unknown": "UNKNOWN_ORIENTATION", "outside": "INVALID_BBOX"}
    image = [r.sample for r in rows if r.image_id == 1]
    base, spread = statistics.median(image), max(1, 2 * statistics.pstdev(image))
    for name, y1, y2, x1, x2, s1, s2 in (("right", 2, 5, 5, 7, 7, 9), ("left", 6, 9, 2, 4, 0, 2)):
        inside, shade = (statistics.mean(_samples(rows, 1, y1, y2, *x)) for x in ((x1, x2), (s1, s2)))
        clip = lambda v: max(0.0, min(1.0, v))
        assert abs(got[name].highlight_score - clip((inside - base) / spread)) < 1e-9
        assert abs(got[name].shadow_score - clip((base - shade) / spread)) < 1e-9
        assert got[name].geometry_score == 1.0
