"""Queries of ping-row rasters and component operators."""

from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import components as C
from ..operators import joins as J
from ..operators import rasters as R
from .catalog_boxes import IOU_SQL
from ..operators.rules import form_surveys
from .catalog_joins import PING_FRAMES, j11, ping_rows
from .catalog_more import DROPPED, PLACED, dropped, placed
from .registry import register

_R = lambda *names: [F.round(n, 6).alias(n) for n in names]


@register(
    "A23_raster_condition",
    """WITH b AS (SELECT image_id, quantile_cont(sample::DOUBLE, 0.02) AS p02, quantile_cont(sample::DOUBLE, 0.98) AS p98, greatest(1e0, quantile_cont(sample::DOUBLE, 0.01)) AS dark, min(sample)::DOUBLE AS low, max(sample)::DOUBLE AS high, max(col_idx) + 1 AS width, count(*) AS n FROM v_imgs GROUP BY image_id),
    p AS (SELECT i.*, b.low, b.high, b.width, b.n, CASE WHEN sample <= dark THEN 1e0 ELSE 0e0 END AS black FROM v_imgs AS i JOIN b ON i.image_id = b.image_id),
    r AS (SELECT image_id, avg(CASE WHEN m >= 0.92 THEN 1e0 ELSE 0e0 END) AS dropout_fraction, avg(m) AS near_black_fraction FROM (SELECT image_id, row_idx, avg(black) AS m FROM p GROUP BY ALL) AS x GROUP BY image_id),
    c AS (SELECT image_id, width, count(*) FILTER (WHERE m > 0.5) AS run FROM (SELECT image_id, width, col_idx, avg(black) AS m FROM p GROUP BY ALL) AS x WHERE col_idx >= floor(width / 2) - floor(width / 8) AND col_idx < floor(width / 2) + floor(width / 8) GROUP BY image_id, width),
    h AS (SELECT image_id, n, least(63, floor((sample - low) * 64 / (high + 1e-6 - low))) AS bin, count(*) AS c FROM p WHERE high > low GROUP BY ALL), e AS (SELECT image_id, -sum(c * 1e0 / n * log2(c * 1e0 / n)) / 6 AS entropy FROM h GROUP BY image_id),
    o AS (SELECT b.image_id, (p98 - p02) / greatest(1e0, high - low) AS dynamic_range, coalesce(entropy, 0e0) AS entropy, dropout_fraction, near_black_fraction, CASE WHEN run >= greatest(3, floor(b.width / 100)) THEN run * 1e0 / b.width ELSE 0e0 END AS nadir_fraction FROM b JOIN r ON b.image_id = r.image_id JOIN c ON b.image_id = c.image_id LEFT JOIN e ON b.image_id = e.image_id),
    q AS (SELECT *, greatest(0e0, least(1e0, 0.45e0 * dynamic_range + 0.25e0 * entropy + 0.30e0 * (1 - dropout_fraction - near_black_fraction))) AS s FROM o)
    SELECT image_id, round(dynamic_range, 6) AS dynamic_range, round(entropy, 6) AS entropy, round(dropout_fraction, 6) AS dropout_fraction, round(near_black_fraction, 6) AS near_black_fraction, round(nadir_fraction, 6) AS nadir_fraction, round(s, 6) AS quality_score, CASE WHEN s >= 0.7 THEN 'GOOD' WHEN s >= 0.45 THEN 'FAIR' ELSE 'POOR' END AS quality_grade,
    concat_ws('|', CASE WHEN dynamic_range < 0.12 THEN 'LOW_DYNAMIC_RANGE' END, CASE WHEN dropout_fraction > 0.02 THEN 'HORIZONTAL_DARK_BAND' END, CASE WHEN near_black_fraction > 0.2 THEN 'HIGH_INVALID_PIXEL_FRACTION' END, CASE WHEN nadir_fraction > 0 THEN 'CENTRAL_DARK_BAND_ESTIMATED' END) AS quality_flags FROM q""",
)
def a23(v):
    return R.raster_condition(v["v_imgs"]).select("image_id", *_R("dynamic_range", "entropy", "dropout_fraction", "near_black_fraction", "nadir_fraction", "quality_score"), "quality_grade", "quality_flags")


@register(
    "A24_raster_quality",
    """WITH w AS (SELECT image_id, avg(sample) AS mean, stddev_pop(sample) AS std, avg(CASE WHEN sample <= 1 THEN 1e0 ELSE 0e0 END) AS dropout FROM v_imgs GROUP BY image_id), r AS (SELECT image_id, row_idx, avg(sample) AS m FROM v_imgs GROUP BY ALL),
    d AS (SELECT image_id, stddev_pop(x) AS sd FROM (SELECT image_id, m - lag(m) OVER (PARTITION BY image_id ORDER BY row_idx) AS x FROM r) AS y GROUP BY image_id)
    SELECT w.image_id, round(std / (mean + 1e-6), 6) AS speckle_index, round(dropout, 6) AS dropout_fraction, round(sd / (std + 1e-6), 6) AS banding, dropout < 0.35 AND std > 3 AS usable FROM w JOIN d ON w.image_id = d.image_id""",
)
def a24(v):
    return R.raster_quality(v["v_imgs"]).select("image_id", *_R("speckle_index", "dropout_fraction", "banding"), "usable")


@register(
    "A25_nadir_by_profile",
    """WITH r AS (SELECT image_id, row_idx, median(sample::DOUBLE) AS m FROM v_imgs GROUP BY ALL), s AS (SELECT *, sum(m) OVER (PARTITION BY image_id ORDER BY row_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 AS s, count(*) OVER (PARTITION BY image_id) AS h FROM r),
    g AS (SELECT image_id, floor(h * 0.2e0) AS lo, floor(h * 0.8e0) AS hi, arg_min(row_idx, (s, row_idx)) AS pos, min(s) AS least, quantile_cont(s, 0.75) AS q3, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS q2 FROM s WHERE row_idx >= floor(h * 0.2e0) AND row_idx < floor(h * 0.8e0) GROUP BY image_id, h),
    c AS (SELECT image_id, pos, least(1e0, 0.5e0 * least(greatest(0e0, (q2 - least) / (q3 - q1 + 1e-6)) / 2, 1e0) + 0.5e0 * greatest(0e0, least(pos - lo, hi - 1 - pos) / greatest(1e0, (hi - lo) / 2))) AS conf FROM g)
    SELECT image_id, round(conf, 6) AS confidence, CASE WHEN conf >= 0.55 THEN pos::DOUBLE END AS nadir_row, CASE WHEN conf >= 0.55 THEN 'RECOVERED' ELSE 'LOW_QUALITY' END AS state FROM c""",
)
def a25(v):
    return R.nadir_by_profile(v["v_imgs"]).withColumn("confidence", F.round("confidence", 6))


@register(
    "A26_nadir_by_column_sum",
    """WITH s AS (SELECT image_id, col_idx, sum(sample) AS total FROM v_imgs WHERE col_idx BETWEEN greatest(0, ceil(64 / 2 - 0.05e0 * 64)) AND least(63, floor(64 / 2 + 0.05e0 * 64)) GROUP BY ALL), t AS (SELECT *, max(total) OVER (PARTITION BY image_id) AS top FROM s)
    SELECT image_id, (min(col_idx) + max(col_idx)) / 2e0 AS nadir_col, count(*) AS tied_columns FROM t WHERE total = top GROUP BY image_id""",
)
def a26(v):
    return R.nadir_by_column_sum(v["v_imgs"])


@register(
    "A46_histogram_equalise_lut",
    """WITH c AS (SELECT image_id, sample, count(*) AS c FROM v_imgs GROUP BY ALL), d AS (SELECT *, sum(c) OVER (PARTITION BY image_id ORDER BY sample) AS cdf, sum(c) OVER (PARTITION BY image_id) AS total FROM c), e AS (SELECT *, min(cdf) OVER (PARTITION BY image_id) AS f FROM d)
    SELECT image_id, sample, CASE WHEN total = f THEN sample ELSE CAST(round_even(255e0 * (cdf - f) / (total - f), 0) AS INTEGER) END AS level FROM e""",
)
def a46(v):
    return R.equalise_lut(v["v_imgs"])


@register("A47_pool_cells", "WITH c AS (SELECT image_id, floor(row_idx / 4)::BIGINT AS cy, floor(col_idx / 4)::BIGINT AS cx, avg(sample) AS m FROM v_imgs GROUP BY ALL) SELECT image_id, cy, cx, round(m / greatest(sqrt(sum(m * m) OVER (PARTITION BY cy, cx)), 1e-12), 9) AS value FROM c")
def a47(v):
    return R.pool_cells(v["v_imgs"]).withColumn("value", F.round("value", 9))


BOXES = "SELECT box_id, image_id, x1, y1, x1 + 6 + tile_id AS x2, y1 + 4 AS y2, tile_id FROM (" + PLACED + ") AS q"


def _boxes(v):
    return placed(v).withColumn("x2", F.col("x1") + 6 + F.col("tile_id"))


@register(
    "A28_hard_return_evidence",
    f"""WITH b AS (SELECT *, greatest(3, floor(greatest(x2 - x1, y2 - y1) * 0.5e0)) AS pad FROM ({BOXES}) AS z), n AS (SELECT *, unnest(range(greatest(0, y1 - pad)::BIGINT, (y2 + pad)::BIGINT)) AS row_at FROM b), m AS (SELECT n.*, sample, col_idx >= x1 AND col_idx < x2 AND row_idx >= y1 AND row_idx < y2 AS inside FROM v_imgs AS i JOIN n ON i.image_id = n.image_id AND i.row_idx = n.row_at AND col_idx >= x1 - pad AND col_idx < x2 + pad),
    l AS (SELECT box_id, median(sample::DOUBLE) AS bg FROM m GROUP BY box_id), s AS (SELECT m.box_id, greatest(1e0, median(abs(sample - bg)) * 1.4826e0) AS scale FROM m JOIN l ON m.box_id = l.box_id GROUP BY m.box_id),
    o AS (SELECT m.box_id, bg, x1, x2, y1, y2, (avg(sample) - bg) / scale AS contrast, avg(CASE WHEN sample >= bg + scale THEN 1e0 ELSE 0e0 END) AS bright, avg(CASE WHEN sample <= bg - scale THEN 1e0 ELSE 0e0 END) AS dark FROM m JOIN l ON m.box_id = l.box_id JOIN s ON m.box_id = s.box_id WHERE inside GROUP BY m.box_id, bg, scale, x1, x2, y1, y2),
    h AS (SELECT *, greatest(0e0, least(1e0, (bright - 0.08e0) / 0.45e0)) AS hard, greatest(x2 - x1, y2 - y1) * 1e0 / greatest(1, least(x2 - x1, y2 - y1)) AS long FROM o)
    SELECT box_id, bg, round(contrast, 6) AS contrast, round(bright, 6) AS bright, round(dark, 6) AS dark, round(hard, 6) AS hard, CASE WHEN hard >= 0.55 AND long >= 3 THEN 'SUPPORTED' WHEN hard > 0.10 THEN 'WEAK_SUPPORT' WHEN dark >= 0.70 AND bright <= 0.08 THEN 'ACOUSTICALLY_INCONSISTENT' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM h""",
)
def a28(v):
    return R.hard_return(v["v_imgs"], _boxes(v)).select("box_id", "bg", *_R("contrast", "bright", "dark", "hard"), "status")


@register("G12_mask_to_box", "SELECT image_id, min(col_idx) FILTER (WHERE sample >= 215) AS x, min(row_idx) FILTER (WHERE sample >= 215) AS y, max(col_idx) FILTER (WHERE sample >= 215) - min(col_idx) FILTER (WHERE sample >= 215) + 1 AS w, max(row_idx) FILTER (WHERE sample >= 215) - min(row_idx) FILTER (WHERE sample >= 215) + 1 AS h FROM v_imgs GROUP BY image_id")
def g12(v):
    on = lambda c: F.when(F.col("sample") >= 215, F.col(c))
    return v["v_imgs"].groupBy("image_id").agg(F.min(on("col_idx")).alias("x"), F.min(on("row_idx")).alias("y"), (F.max(on("col_idx")) - F.min(on("col_idx")) + 1).alias("w"), (F.max(on("row_idx")) - F.min(on("row_idx")) + 1).alias("h"))


@register(
    "G11_mask_components",
    """WITH o AS (SELECT image_id, row_idx, col_idx, col_idx - row_number() OVER (PARTITION BY image_id, row_idx ORDER BY col_idx) AS g FROM v_imgs WHERE sample >= 165), r AS (SELECT image_id, row_idx, min(col_idx) AS x1, max(col_idx) AS x2, [image_id, row_idx, min(col_idx)] AS node FROM o GROUP BY image_id, row_idx, g),
    t AS (SELECT a.node AS a, b.node AS b FROM r AS a JOIN r AS b ON a.image_id = b.image_id AND abs(a.row_idx - b.row_idx) = 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1), c AS (SELECT node AS a, node AS b FROM r UNION SELECT c.a, t.b FROM c JOIN t ON c.b = t.a), l AS (SELECT a AS node, min(b) AS label FROM c GROUP BY a)
    SELECT image_id, array_to_string(label, '/') AS label, min(x1) AS x, min(row_idx) AS y, max(x2) - min(x1) + 1 AS w, max(row_idx) - min(row_idx) + 1 AS h, sum(x2 - x1 + 1) AS area, round(sum(x2 - x1 + 1) * 1e0 / ((max(x2) - min(x1) + 1) * (max(row_idx) - min(row_idx) + 1)), 9) AS fill, sum(x2 - x1 + 1) >= 256 AS large FROM r JOIN l ON r.node = l.node GROUP BY image_id, label""",
    recursive=True,
)
def g11(v):
    return C.mask_components(v["v_imgs"], 165)


G02 = f"""WITH p AS (SELECT detection_id, frame_id, tile_id, raw_confidence, x1, y1, x2, y2 FROM v_det WHERE raw_class = 'SHIPWRECK' AND raw_confidence < 0.5), e AS (SELECT a.detection_id AS a, b.detection_id AS b FROM p AS a JOIN p AS b ON a.frame_id = b.frame_id AND {IOU_SQL.format(a='a.', b='b.')} >= 0.15),
    c AS (SELECT a, b FROM e WHERE a = b UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a), l AS (SELECT a AS detection_id, min(b) AS label FROM c GROUP BY a),
    g AS (SELECT frame_id, label, count(*) AS n, max(raw_confidence) AS best, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(DISTINCT tile_id) AS tiles FROM p JOIN l ON p.detection_id = l.detection_id GROUP BY frame_id, label HAVING count(*) >= 3),
    t AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, best DESC, label) AS k FROM g) SELECT t.frame_id, t.label, n, best, t.x1, t.y1, t.x2, t.y2, tiles, round(avg((p.x2 - p.x1) * (p.y2 - p.y1) / ((t.x2 - t.x1) * (t.y2 - t.y1))), 9) AS mean_iou FROM t JOIN l ON l.label = t.label JOIN p ON p.detection_id = l.detection_id WHERE k = 1 GROUP BY ALL"""


@register(
    "G02_coherent_cluster",
    G02,
    recursive=True,
)
def g02(v):
    from pyspark.sql import Window as W

    p = v["v_det"].filter("raw_class = 'SHIPWRECK' and raw_confidence < 0.5").select("detection_id", "frame_id", "tile_id", "raw_confidence", "x1", "y1", "x2", "y2")
    pairs = J.overlapping_pairs(p, ["frame_id"], least=0.15).filter("a.detection_id <> b.detection_id").select(F.col("a.detection_id").alias("a"), F.col("b.detection_id").alias("b"))
    label = C.components(pairs).select(F.col("node").alias("detection_id"), F.col("component").alias("label"))
    g = p.join(label, "detection_id").groupBy("frame_id", "label").agg(F.count("*").alias("n"), F.max("raw_confidence").alias("best"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.countDistinct("tile_id").alias("tiles")).filter("n >= 3")
    w = W.partitionBy("frame_id").orderBy(F.col("n").desc(), F.col("best").desc(), "label")
    best = g.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    # members lie inside the envelope: their overlap with it is their share of it
    share = F.expr("(b.x2 - b.x1) * (b.y2 - b.y1) / ((g.x2 - g.x1) * (g.y2 - g.y1))")
    mean = best.alias("g").join(label, "label").join(p.alias("b"), "detection_id").groupBy("label").agg(F.round(F.avg(share), 9).alias("mean_iou"))
    return best.join(mean, "label")


@register(
    "P16_spatial_consensus",
    G02.replace("SELECT t.frame_id, t.label", ", z AS (SELECT t.frame_id, t.label") + ") SELECT frame_id, label, 'SHIPWRECK' AS display_class, round(least(0.85e0, greatest(0.55e0, 0.55e0 + (0.4e0 * least(1e0, n / 10e0) + 0.3e0 * least(1e0, tiles / 4e0) + 0.3e0 * greatest(0e0, least(1e0, mean_iou))) * 0.30e0)), 4) AS display_confidence FROM z",
    recursive=True,
)
def p16_consensus(v):
    """What is shown of a cluster of weak proposals that agree in space; the raw confidence stays as it is."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    agree = 0.4 * clip(F.col("n") / 10) + 0.3 * clip(F.col("tiles") / 4) + 0.3 * clip(F.col("mean_iou"))
    shown = F.least(F.lit(0.85), F.greatest(F.lit(0.55), 0.55 + agree * 0.30))
    return g02(v).select("frame_id", "label", F.lit("SHIPWRECK").alias("display_class"), F.round(shown, 4).alias("display_confidence"))


SHIFTS = f"""p AS ({PING_FRAMES}), rr AS (SELECT frame_id, height, row_idx, md5(e.embedding::VARCHAR) AS digest FROM p JOIN embeddings AS e ON p.vec_id = e.vec_id),
mm AS (SELECT a.frame_id AS later, b.frame_id AS earlier, a.row_idx - b.row_idx AS k, a.height FROM rr AS a JOIN rr AS b ON a.digest = b.digest AND a.frame_id <> b.frame_id AND a.row_idx >= b.row_idx),
ff AS (SELECT later, earlier, k FROM mm GROUP BY later, earlier, k, height HAVING count(*) = height - k AND k <= height * 0.5), ee AS (SELECT later, earlier, k FROM (SELECT *, count(*) OVER (PARTITION BY least(later, earlier), greatest(later, earlier)) AS n FROM ff) AS x WHERE n = 1 AND k >= 1),
bb AS (SELECT later AS a, earlier AS b, k FROM ee UNION ALL SELECT earlier, later, -k FROM ee), cc AS (SELECT DISTINCT a AS root, a AS node, 0::BIGINT AS off FROM bb UNION SELECT cc.root, bb.b, cc.off + bb.k FROM cc JOIN bb ON cc.node = bb.a),
gg AS (SELECT node, min(root) AS component FROM cc GROUP BY node), at_ AS (SELECT cc.node, component, off FROM cc JOIN gg ON cc.node = gg.node AND cc.root = gg.component), oo AS (SELECT node, component, off - min(off) OVER (PARTITION BY component) AS ping_offset FROM at_)"""


@register("G06_components_with_offsets", f"WITH {SHIFTS} SELECT node, component, ping_offset FROM oo", recursive=True)
def g06(v):
    return v.once("offsets", lambda: stored(C.components_with_offsets(stored(j11(v)))))


_FORMED = """fr AS (SELECT DISTINCT frame_id, CASE WHEN frame_id % 5 = 4 THEN NULL WHEN frame_id % 7 = 1 THEN 'SYNTHETIC_DEMO' ELSE 'MEASURED' END AS provenance FROM p),
    fs AS (SELECT f.frame_id, provenance, CASE WHEN f.frame_id % 8 = 3 THEN 'declared.' || (f.frame_id - 3) WHEN component IS NOT NULL THEN 'verified.' || component ELSE 'singleton.' || f.frame_id END AS survey_ref, CASE WHEN f.frame_id % 8 = 3 THEN 'DECLARED' WHEN component IS NOT NULL THEN 'VERIFIED' ELSE 'SINGLETON' END AS membership FROM fr AS f LEFT JOIN oo ON f.frame_id = oo.node)"""


@register(
    "G08_form_surveys",
    f"WITH {SHIFTS}, {_FORMED} SELECT frame_id, fs.survey_ref, membership, n.navigation_provenance FROM fs JOIN (SELECT survey_ref, CASE WHEN count(provenance) = count(*) AND min(provenance) = max(provenance) THEN min(provenance) END AS navigation_provenance FROM fs GROUP BY survey_ref) AS n ON fs.survey_ref = n.survey_ref",
    recursive=True,
)
def g08(v):
    """Declared groups first, then verified ones, else a survey of its own; with the provenance that all members declare."""
    i = F.col("frame_id")
    frames = ping_rows(v).select("frame_id").distinct().withColumn("provenance", F.when(i % 5 == 4, None).when(i % 7 == 1, "SYNTHETIC_DEMO").otherwise("MEASURED"))
    return form_surveys(frames, frames.filter(i % 8 == 3).select("frame_id", (i - 3).alias("group_ref")), g06(v).select(F.col("node").alias("frame_id"), "component"))


@register("J02_ping_relationships", f"WITH {SHIFTS}, fr AS (SELECT DISTINCT frame_id FROM p) SELECT f.frame_id, ping_offset AS survey_ping_start, ping_offset + 40 - 1 AS survey_ping_end, ping_offset IS NOT NULL AS sequential_supported FROM fr AS f LEFT JOIN oo ON f.frame_id = oo.node AND f.frame_id % 8 <> 3 AND f.frame_id % 12 <> 5 AND f.frame_id % 20 <> 6", recursive=True)
def j02(v):
    """Places on the survey's ping axis: of verified frames that come from the source and whose raster is the only one of its content."""
    source, unique = F.col("frame_id") % 12 != 5, F.col("frame_id") % 20 != 6
    s = g08(v).filter("membership = 'VERIFIED'").filter(source & unique).select("frame_id", F.lit(True).alias("verified"))
    o = g06(v).select(F.col("node").alias("frame_id"), "ping_offset")
    out = g08(v).select("frame_id").join(s.join(o, "frame_id"), "frame_id", "left")
    return out.select("frame_id", F.col("ping_offset").alias("survey_ping_start"), (F.col("ping_offset") + 40 - 1).alias("survey_ping_end"), F.col("verified").isNotNull().alias("sequential_supported"))


@register("P22_candidate_condition_overlap", f"WITH b AS (SELECT *, unnest(range(y1, y2)) AS row_at FROM ({BOXES}) AS z), d AS ({DROPPED}) SELECT box_id, round(count(d.row_idx) * 1e0 / greatest(1, max(y2 - y1)), 9) AS dropout_overlap, CASE WHEN max(b.image_id) % 2 = 0 AND abs(max(x1 + x2) / 2e0 - 32) <= 3.2e0 THEN 1e0 ELSE 0e0 END AS nadir_overlap FROM b LEFT JOIN d ON b.image_id = d.image_id AND d.row_idx = row_at GROUP BY box_id")
def p22(v):
    """Share of each box's rows that dropped out, and whether its centre lies in the dark centre (a tenth of even images)."""
    b = _boxes(v).withColumn("row_idx", F.explode(F.sequence("y1", F.col("y2") - 1)))
    met = b.join(dropped(v).withColumn("lost", F.lit(1)), ["image_id", "row_idx"], "left").groupBy("box_id", "image_id", "x1", "x2", "y1", "y2").agg(F.count("lost").alias("n"))
    central = (F.col("image_id") % 2 == 0) & (F.abs((F.col("x1") + F.col("x2")) / 2 - 32) <= 0.1 * 64 / 2)
    return met.select("box_id", F.round(F.col("n") / F.greatest(F.lit(1), F.expr("y2 - y1")), 9).alias("dropout_overlap"), central.cast("double").alias("nadir_overlap"))


@register("P23_cell_valid_fraction", "WITH f AS (SELECT width, height, count(*) AS frames FROM v_frames GROUP BY ALL) SELECT width, height, frames, cx, cy, round(greatest(0e0, least(cx * 260e0 + 260, width) - cx * 260e0) / 260 * greatest(0e0, least(cy * 30e0 + 30, height) - cy * 30e0) / 30, 9) AS valid FROM f, range(0, 20) AS a(cx), range(0, 20) AS b(cy)")
def p23(v):
    """Share of each cell of a 20 x 20 grid (260 x 30 px cells) that lies inside frames of a size."""
    f = v["v_frames"].groupBy("width", "height").agg(F.count("*").alias("frames"))
    f = f.withColumn("cx", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("cy", F.explode(F.sequence(F.lit(0), F.lit(19))))
    axis = lambda c, size, limit: F.greatest(F.lit(0.0), F.least(F.col(c) * float(size) + size, F.col(limit)) - F.col(c) * float(size)) / size
    return f.select("width", "height", "frames", "cx", "cy", F.round(axis("cx", 260, "width") * axis("cy", 30, "height"), 9).alias("valid"))
