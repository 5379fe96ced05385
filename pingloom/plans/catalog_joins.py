"""Queries of joins and set operations."""

from pyspark.sql import functions as F

from ..functions import boxes
from ..functions.storage import scratch
from ..operators import joins as J
from ..operators import scalar as S
from ..operators.nearest import nearest_distance
from ..sources import files
from .catalog_boxes import IOU_SQL, TILES_SQL
from .registry import register

_IOU = IOU_SQL.format(a="a.", b="b.")


@register("J01_attach_navigation", "SELECT f.frame_id, f.survey_id, n.latitude, n.longitude, n.heading_deg, CASE WHEN n.frame_id IS NULL THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS navigation_status FROM v_frames AS f LEFT JOIN v_nav AS n ON f.frame_id = n.frame_id")
def j01(v):
    n = v["v_nav"].select("frame_id", "latitude", "longitude", "heading_deg", F.lit("AVAILABLE").alias("s"))
    return v["v_frames"].join(n, "frame_id", "left").select("frame_id", "survey_id", "latitude", "longitude", "heading_deg", F.coalesce("s", F.lit("UNAVAILABLE")).alias("navigation_status"))


@register("J01_unknown_navigation", "SELECT n.frame_id FROM v_nav AS n ANTI JOIN v_det AS d ON n.frame_id = d.frame_id")
def j01b(v):
    return v["v_nav"].join(v["v_det"], "frame_id", "left_anti").select("frame_id")


@register("P14_nav_view", "SELECT f.frame_id, latitude, longitude, heading_deg, provenance, CASE WHEN n.frame_id IS NULL THEN 'UNAVAILABLE' WHEN provenance IS NULL THEN 'UNVERIFIED' ELSE provenance END AS nav_status FROM v_frames AS f LEFT JOIN v_nav AS n ON f.frame_id = n.frame_id")
def p14(v):
    n = v["v_nav"].select("frame_id", "latitude", "longitude", "heading_deg", "provenance", F.lit(True).alias("has"))
    return v["v_frames"].select("frame_id").join(n, "frame_id", "left").withColumn("nav_status", F.when(F.col("has").isNull(), "UNAVAILABLE").otherwise(F.coalesce("provenance", F.lit("UNVERIFIED")))).drop("has")


@register(
    "J03_tile_annotation_join",
    TILES_SQL + ", b AS (SELECT gt_id, frame_id, gx1 * 8 AS bx, gy1 * 8 AS by_, gx2 * 8 - gx1 * 8 AS bw, gy2 * 8 - gy1 * 8 AS bh FROM v_gt) SELECT gt_id, b.frame_id, x0, y0 FROM b JOIN t ON b.frame_id = t.frame_id AND bx < x0 + 512 AND bx + bw > x0 AND by_ < y0 + 512 AND by_ + bh > y0",
)
def j03(v):
    return J.annotated_tiles(v["v_frames"], _annotations(v)).select("gt_id", "frame_id", "x0", "y0")


def _annotations(v, *more):
    return v["v_gt"].select("gt_id", "frame_id", *more, (F.col("gx1") * 8).alias("bx"), (F.col("gy1") * 8).alias("by"), (F.col("gx2") * 8 - F.col("gx1") * 8).alias("bw"), (F.col("gy2") * 8 - F.col("gy1") * 8).alias("bh"))


CLIP_SQL = TILES_SQL + """, b AS (SELECT gt_id, frame_id, gx1 * 8 AS bx, gy1 * 8 AS by_, gx2 * 8 - gx1 * 8 AS bw, gy2 * 8 - gy1 * 8 AS bh FROM v_gt),
c AS (SELECT gt_id, b.frame_id, x0, y0, bw, bh, greatest(bx, x0) - x0 AS cx, greatest(by_, y0) - y0 AS cy, least(bx + bw, x0 + 512) - greatest(bx, x0) AS cw, least(by_ + bh, y0 + 512) - greatest(by_, y0) AS ch FROM b JOIN t ON b.frame_id = t.frame_id) """


@register("P09_clip_box", CLIP_SQL + "SELECT gt_id, frame_id, x0, y0, cx, cy, cw, ch FROM c WHERE cw > 0 AND ch > 0 AND cw * ch / (bw * bh) >= 0.25")
def p09(v):
    return clipped(v)


def clipped(v, *more):
    """Boxes cut to the tiles that hold a quarter of them or more, with columns ``more`` of the boxes."""
    return S.clip_box(J.annotated_tiles(v["v_frames"], _annotations(v, *more))).select("gt_id", "frame_id", "x0", "y0", "cx", "cy", "cw", "ch", *more)


#: Folders that label files are dealt to.
_FOLDERS = 1024


@register(
    "S13_write_yolo_labels",
    CLIP_SQL + ", k AS (SELECT c.*, gt_class FROM c JOIN v_gt AS g ON c.gt_id = g.gt_id WHERE cw > 0 AND ch > 0 AND cw * ch / (bw * bh) >= 0.25 AND gt_class <> 'CRAB_POT') "
    "SELECT frame_id || '_x' || lpad(x0::VARCHAR, 5, '0') || '_y' || lpad(y0::VARCHAR, 5, '0') AS tile_key, string_agg(printf('%d %.8f %.8f %.8f %.8f', CASE gt_class WHEN 'PIPELINE' THEN 0 ELSE 1 END, (cx + cw / 2) / 512, (cy + ch / 2) / 512, cw / 512, ch / 512), chr(10) ORDER BY gt_id) AS label_text FROM k GROUP BY ALL",
)
def s13(v):
    """Label lines of each tile, written to a file of its own and read back; a class without an index is skipped."""
    c = clipped(v, "gt_class").withColumn("i", F.when(F.col("gt_class") == "PIPELINE", 0).when(F.col("gt_class") == "SHIPWRECK", 1)).filter("i is not null")
    line = F.format_string("%d %.8f %.8f %.8f %.8f", "i", (F.col("cx") + F.col("cw") / 2) / 512, (F.col("cy") + F.col("ch") / 2) / 512, F.col("cw") / 512, F.col("ch") / 512)
    key = F.format_string("%s_x%05d_y%05d", F.col("frame_id").cast("string"), "x0", "y0")
    rows = c.groupBy(key.alias("tile_key")).agg(F.array_sort(F.collect_list(F.struct("gt_id", line.alias("line")))).alias("lines"))
    labels = rows.select(F.concat("tile_key", F.lit(".txt")).alias("name"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    path = scratch(v.spark)
    files.write_texts(labels, path, _FOLDERS)
    return files.read_texts(v.spark, path, _FOLDERS).select(F.regexp_replace("name", "[.]txt$", "").alias("tile_key"), F.col("text").alias("label_text"))


@register("J04_detection_cluster_join", f"SELECT a.detection_id, count(*) AS cluster_size, count(DISTINCT b.tile_id) AS tiles, round(max(b.raw_confidence), 9) AS best FROM v_det AS a JOIN v_det AS b ON a.frame_id = b.frame_id AND a.raw_class = b.raw_class AND {_IOU} >= 0.30 GROUP BY a.detection_id")
def j04(v):
    d = v["v_det"].select("detection_id", "frame_id", "raw_class", "tile_id", "raw_confidence", "x1", "y1", "x2", "y2")
    return J.overlapping_pairs(d, ["frame_id", "raw_class"]).groupBy(F.col("a.detection_id").alias("detection_id")).agg(F.count("*").alias("cluster_size"), F.countDistinct("b.tile_id").alias("tiles"), F.round(F.max("b.raw_confidence"), 9).alias("best"))


@register("J06_label_by_truth", f"SELECT a.detection_id, EXISTS (SELECT 1 FROM (SELECT frame_id, gt_class, gx1 AS x1, gy1 AS y1, gx2 AS x2, gy2 AS y2 FROM v_gt) AS b WHERE b.frame_id = a.frame_id AND b.gt_class = a.raw_class AND {_IOU} >= 0.5) AS positive FROM v_det AS a")
def j06(v):
    hit = v["v_det"].alias("a").join(v["v_gt"].alias("g"), (F.col("a.frame_id") == F.col("g.frame_id")) & (F.col("raw_class") == F.col("gt_class")) & (boxes.iou(boxes.named("a."), boxes.named("g.", ("gx1", "gy1", "gx2", "gy2"))) >= 0.5), "left_semi").select("detection_id", F.lit(True).alias("p"))
    return v["v_det"].select("detection_id").join(hit, "detection_id", "left").select("detection_id", F.coalesce("p", F.lit(False)).alias("positive"))


@register("J07_novel_patch_antijoin", f"SELECT a.gt_id FROM (SELECT gt_id, frame_id, gx1 AS x1, gy1 AS y1, gx2 AS x2, gy2 AS y2 FROM (SELECT *, (gx1 * 13 + gy1 * 7) % 100 / 100e0 AS score FROM v_gt) AS s WHERE score >= 0.35) AS a WHERE NOT EXISTS (SELECT 1 FROM v_det AS b WHERE b.frame_id = a.frame_id AND concat('g', b.detection_id) <> a.gt_id AND {_IOU} > 0.3)")
def j07(v):
    """Patches whose score reaches the threshold and that no other detection overlaps."""
    d = v["v_det"].alias("b")
    patches = v["v_gt"].withColumn("score", (F.col("gx1") * 13 + F.col("gy1") * 7) % 100 / 100).filter("score >= 0.35").alias("g")
    return patches.join(d, (F.col("g.frame_id") == F.col("b.frame_id")) & (F.concat(F.lit("g"), "b.detection_id") != F.col("gt_id")) & (boxes.iou(boxes.named("g.", ("gx1", "gy1", "gx2", "gy2")), boxes.named("b.")) > 0.3), "left_anti").select("gt_id")


@register(
    "J08_nearest_bank_distance",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT q.vec_id, round(min(list_distance(q.x, b.x)), 6) AS distance FROM e AS q, e AS b WHERE q.vec_id % 2 = 1 AND b.vec_id % 2 = 0 GROUP BY q.vec_id",
)
def j08(v):
    e = v["embeddings"].select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return nearest_distance(e.filter("vec_id % 2 = 1"), e.filter("vec_id % 2 = 0")).select("vec_id", F.round("distance", 6).alias("distance"))


#: Images as vectors of samples: each vector, and derived ones that are nearly or hardly alike in another split.
_SAMPLES = "list_transform(embedding, lambda x: least(255e0, greatest(0e0, floor(128 + 300 * CAST(x AS DOUBLE)))))"
_BITS = "list_sum(list_transform(range(1, 64), lambda i: CASE WHEN x[i] < x[i + 1] THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT"
NEAR = f"""im0 AS (SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, {_SAMPLES} AS x FROM embeddings),
im AS (SELECT * FROM im0 UNION ALL SELECT id + 1000000000, 'val', list_concat([least(255e0, x[1] + CASE WHEN id % 30 = 0 THEN 6 ELSE 0 END)], x[2:]) FROM im0 WHERE id % 10 = 0
  UNION ALL SELECT id + 2000000000, 'val', list_transform(x, lambda y: least(255e0, y + 9)) FROM im0 WHERE id % 10 = 1),
hh AS (SELECT id, split, x, {_BITS} AS h FROM im), pp AS (SELECT a.id AS a_id, b.id AS b_id, bit_count(xor(a.h, b.h))::BIGINT AS distance, list_transform(range(1, 65), lambda i: abs(a.x[i] - b.x[i])) AS d FROM hh AS a JOIN hh AS b ON a.id < b.id AND a.split <> b.split AND bit_count(xor(a.h, b.h)) <= 4),
near AS (SELECT a_id, b_id, distance FROM pp WHERE list_avg(d) <= 2 AND list_aggregate(d, 'quantile_cont', 0.95) <= 8)"""


def _images(v):
    """The rows of NEAR's ``im``: id, split, samples x, and the 63 bits of the differences of neighbours in five bands."""

    def make():
        e = v["embeddings"]
        clip = lambda y: F.least(F.lit(255.0), F.greatest(F.lit(0.0), y))
        im = e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 == 0, "test").otherwise("train").alias("split"), F.transform("embedding", lambda y: clip(F.floor(128 + 300 * y.cast("double")).cast("double"))).alias("x"))
        first = F.least(F.lit(255.0), F.get("x", F.lit(0)) + F.when(F.col("id") % 30 == 0, 6).otherwise(0))
        near = im.filter("id % 10 = 0").select((F.col("id") + 1_000_000_000).alias("id"), F.lit("val").alias("split"), F.concat(F.array(first), F.slice("x", 2, 63)).alias("x"))
        far = im.filter("id % 10 = 1").select((F.col("id") + 2_000_000_000).alias("id"), F.lit("val").alias("split"), F.transform("x", lambda y: clip(y + 9)).alias("x"))
        return J.with_difference_hash(im.unionByName(near).unionByName(far))

    return v.once("images", make)


@register("J09_near_duplicate_join", f"WITH {NEAR} SELECT a_id, b_id, distance FROM near")
def j09(v):
    return J.near_duplicates(_images(v))


@register("J10_exact_and_dhash_conflicts", f"""WITH {NEAR}, r AS (SELECT r.frame_id, raster_sha256, f.split FROM v_rasters AS r JOIN v_frames AS f ON r.frame_id = f.frame_id WHERE raster_sha256 IS NOT NULL)
SELECT 'exact' AS kind, raster_sha256 AS subject, count(*) AS members, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM r GROUP BY raster_sha256 HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'equal_hash', a_id || '-' || b_id, 2, NULL FROM near WHERE distance = 0""")
def j10(v):
    """Groups of equal content across splits, and pairs of equal hash that their samples confirm."""
    r = v["v_rasters"].filter("raster_sha256 is not null").join(v["v_frames"].select("frame_id", "split"), "frame_id")
    exact = r.groupBy(F.col("raster_sha256").alias("subject")).agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n")).filter("n > 1")
    pairs = j09(v).filter("distance = 0").select(F.lit("equal_hash").alias("kind"), F.concat_ws("-", "a_id", "b_id").alias("subject"), F.lit(2).cast("bigint").alias("members"), F.lit(None).cast("string").alias("splits"))
    return exact.select(F.lit("exact").alias("kind"), "subject", "members", "splits").unionByName(pairs)


PING_FRAMES = "SELECT CAST(floor(vec_id / 100) AS BIGINT) * 4 + j AS frame_id, 40 AS height, vec_id % 100 - 20 * j AS row_idx, vec_id FROM embeddings, (VALUES (0), (1), (2), (3)) AS o(j) WHERE vec_id % 100 >= 20 * j AND vec_id % 100 < 20 * j + 40"


@register(
    "J11_row_shift_pairs",
    f"""WITH p AS ({PING_FRAMES}), r AS (SELECT frame_id, height, row_idx, md5(e.embedding::VARCHAR) AS digest FROM p JOIN embeddings AS e ON p.vec_id = e.vec_id),
    m AS (SELECT a.frame_id AS later, b.frame_id AS earlier, a.row_idx - b.row_idx AS k, a.height FROM r AS a JOIN r AS b ON a.digest = b.digest AND a.frame_id <> b.frame_id AND a.row_idx >= b.row_idx),
    f AS (SELECT later, earlier, k FROM m GROUP BY later, earlier, k, height HAVING count(*) = height - k AND k <= height * 0.5),
    g AS (SELECT *, count(*) OVER (PARTITION BY least(later, earlier), greatest(later, earlier)) AS n FROM f) SELECT later, earlier, k FROM g WHERE n = 1 AND k >= 1""",
)
def j11(v):
    return J.row_shift_pairs(ping_rows(v))


def ping_rows(v):
    """The rows of PING_FRAMES with the digests of their samples."""
    e = v["embeddings"].select("vec_id", F.md5(F.to_json("embedding").cast("binary")).alias("digest"))
    p = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("row_idx", F.col("vec_id") % 100 - 20 * F.col("j")).filter("row_idx >= 0 and row_idx < 40")
    return p.select((F.floor(F.col("vec_id") / 100) * 4 + F.col("j")).alias("frame_id"), F.lit(40).alias("height"), "row_idx", "digest")


@register(
    "J12_geometry_partition",
    """WITH g AS (SELECT f.frame_id, width, height, count(*) OVER (PARTITION BY raster_sha256) AS same, c_mktsegment = 'MACHINERY' AS declared FROM v_rasters AS r JOIN v_frames AS f ON f.frame_id = r.frame_id LEFT JOIN customer ON group_key = c_custkey WHERE raster_sha256 IS NOT NULL),
    k AS (SELECT frame_id, width, height FROM g WHERE same = 1 AND NOT coalesce(declared, false)) SELECT frame_id, width, height, candidates FROM k JOIN (SELECT width, height, count(*) AS candidates FROM k GROUP BY width, height) AS n USING (width, height)""",
)
def j12(v):
    """Frames that may verify with each other, by geometry: content of their own, known layout, in no declared group (here: customers of one segment)."""
    r = v["v_rasters"].filter("raster_sha256 is not null").join(v["v_frames"].select("frame_id", "width", "height", "group_key"), "frame_id")
    once = r.groupBy("raster_sha256").agg(F.count("*").alias("same"), F.first(F.struct("frame_id", "width", "height", "group_key")).alias("f")).filter("same = 1").select("f.*")
    declared = v["customer"].filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("group_key"))
    left = once.filter("width is not null and height is not null").join(declared, "group_key", "left_anti")
    return left.join(left.groupBy("width", "height").agg(F.count("*").alias("candidates")), ["width", "height"]).select("frame_id", "width", "height", "candidates")


CHANGE = """b AS (SELECT contact_id AS base_id, CASE WHEN hash_mod = 0 THEN true WHEN hash_mod = 1 THEN false END AS covered FROM (SELECT contact_id, CAST(substr(contact_id, 2) AS BIGINT) % 3 AS hash_mod, latest_verdict FROM v_contacts) AS x WHERE coalesce(latest_verdict, '') <> 'REJECTED'),
nw AS (SELECT concat('n', s_suppkey, '_', s_nationkey) AS new_id, CASE WHEN s_suppkey % 4 <> 0 THEN concat('c', s_suppkey * 3 % 90) END AS matched_id FROM supplier),
o AS (SELECT *, row_number() OVER (PARTITION BY matched_id ORDER BY new_id) AS rn FROM nw WHERE matched_id IS NOT NULL),
k AS (SELECT base_id, new_id, CASE WHEN new_id IS NOT NULL THEN 'UNCHANGED' WHEN covered THEN 'NOT_DETECTED' ELSE 'NOT_SURVEYED' END AS status FROM b LEFT JOIN o ON o.matched_id = b.base_id AND o.rn = 1),
ch AS (SELECT base_id, new_id, status FROM k UNION ALL SELECT NULL, new_id, 'NEW' FROM nw WHERE new_id NOT IN (SELECT new_id FROM k WHERE new_id IS NOT NULL))"""


def _change(v, confirmed_only=False):
    m = F.substring("contact_id", 2, 20).cast("bigint") % 3
    base = v["v_contacts"].filter(F.coalesce("latest_verdict", F.lit("")) != "REJECTED").select(F.col("contact_id").alias("base_id"), F.when(m == 0, True).when(m == 1, False).alias("covered"), F.col("latest_verdict").alias("verdict"))
    new = v["supplier"].select(F.concat(F.lit("n"), "s_suppkey", F.lit("_"), "s_nationkey").alias("new_id"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("c"), F.col("s_suppkey") * 3 % 90)).alias("matched_id"))
    return J.compare_surveys(base, new, "L2", confirmed_only)


@register("J13_compare_surveys", f"WITH {CHANGE} SELECT * FROM ch")
def j13(v):
    return _change(v)


@register("J13_compare_confirmed", f"WITH {CHANGE.replace("coalesce(latest_verdict, '') <> 'REJECTED'", "latest_verdict = 'CONFIRMED'")} SELECT * FROM ch")
def j13_confirmed(v):
    return _change(v, True)


@register("A14_change_summary", f"WITH {CHANGE} SELECT s.status, count(ch.status) AS n FROM (VALUES ('NEW'), ('MOVED'), ('UNCHANGED'), ('NOT_DETECTED'), ('NOT_SURVEYED'), ('REMOVED')) AS s(status) LEFT JOIN ch ON ch.status = s.status GROUP BY s.status")
def a14(v):
    """Counts of all statuses, zeros among them."""
    c = _change(v)
    names = F.array(*map(F.lit, ("NEW", "MOVED", "UNCHANGED", "NOT_DETECTED", "NOT_SURVEYED", "REMOVED")))
    dim = c.sparkSession.range(1).select(F.explode(names).alias("status"))
    return dim.join(c.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


@register("J16_detection_with_latest_review", "WITH l AS (SELECT contact_id, arg_max(verdict, (created_at, event_id)) AS latest, count(*) AS review_count FROM v_reviews WHERE verdict IS NOT NULL GROUP BY contact_id) SELECT c.contact_id, latest, coalesce(review_count, 0) AS review_count FROM v_contacts AS c LEFT JOIN l ON c.contact_id = l.contact_id")
def j16(v):
    last = v["v_reviews"].filter("verdict is not null").groupBy("contact_id").agg(F.max_by("verdict", F.struct("created_at", "event_id")).alias("latest"), F.count("*").alias("review_count"))
    return v["v_contacts"].select("contact_id").join(last, "contact_id", "left").withColumn("review_count", F.coalesce("review_count", F.lit(0)))


@register("J17_memory_queue", "SELECT contact_id, survey_id FROM v_contacts SEMI JOIN (SELECT contact_id FROM v_reviews WHERE verdict = 'REJECTED') AS r USING (contact_id)")
def j17(v):
    return v["v_contacts"].join(v["v_reviews"].filter("verdict = 'REJECTED'"), "contact_id", "left_semi").select("contact_id", "survey_id")


@register("J24_coverage_antijoin", "SELECT frame_id, 'missing' AS side FROM (SELECT frame_id FROM v_frames EXCEPT SELECT frame_id FROM v_det) AS a UNION ALL SELECT frame_id, 'extra' FROM (SELECT frame_id FROM v_det EXCEPT SELECT frame_id FROM v_frames) AS b")
def j24(v):
    return J.key_difference(v["v_frames"], v["v_det"], "frame_id")


@register("J25_split_inheritance_check", "WITH t AS (SELECT detection_id, frame_id, CASE WHEN tile_id = 7 THEN 'test' ELSE 'train' END AS tile_split FROM v_det) SELECT detection_id, tile_split, f.split FROM t JOIN v_frames AS f ON t.frame_id = f.frame_id WHERE tile_split <> f.split")
def j25(v):
    t = v["v_det"].select("detection_id", "frame_id", F.when(F.col("tile_id") == 7, "test").otherwise("train").alias("tile_split"))
    return t.join(v["v_frames"].select("frame_id", "split"), "frame_id").filter("tile_split <> split").select("detection_id", "tile_split", "split")


@register("J23_nearest_component_distance", "SELECT a.detection_id, round(min(sqrt(greatest(0e0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) ** 2 + greatest(0e0, greatest(a.y1, b.y1) - least(a.y2, b.y2)) ** 2)), 9) AS gap FROM v_det AS a JOIN v_det AS b ON a.frame_id = b.frame_id AND a.detection_id <> b.detection_id GROUP BY a.detection_id")
def j23(v):
    a, b = v["v_det"].alias("a"), v["v_det"].alias("b")
    w, h = boxes.overlap(boxes.named("a."), boxes.named("b."))
    return a.join(b, F.expr("a.frame_id = b.frame_id and a.detection_id <> b.detection_id")).groupBy(F.col("a.detection_id").alias("detection_id")).agg(F.round(F.min(F.hypot(F.greatest(F.lit(0.0), -w), F.greatest(F.lit(0.0), -h))), 9).alias("gap"))


@register("U01_union_splits", "SELECT frame_id, split FROM v_frames WHERE split = 'val' UNION ALL SELECT frame_id, split FROM v_frames WHERE split = 'test'")
def u01(v):
    f = v["v_frames"].select("frame_id", "split")
    return f.filter("split = 'val'").unionByName(f.filter("split = 'test'"))


@register("U03_set_difference_keys", "SELECT survey_id, 'frames' AS side FROM (SELECT survey_id FROM v_frames EXCEPT ALL SELECT survey_id FROM v_contacts) AS a UNION ALL SELECT survey_id, 'contacts' FROM (SELECT survey_id FROM v_contacts EXCEPT ALL SELECT survey_id FROM v_frames) AS b")
def u03(v):
    """Keys of either table that the other lacks, as bags."""
    f, c = v["v_frames"].select("survey_id"), v["v_contacts"].select("survey_id")
    return f.exceptAll(c).withColumn("side", F.lit("frames")).unionByName(c.exceptAll(f).withColumn("side", F.lit("contacts")))


@register("U04_dedup_last_wins", "SELECT detection_id, raw_confidence, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY detection_id ORDER BY seen_at DESC, raw_confidence DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) AS rn FROM v_det0) AS d WHERE rn = 1")
def u04(v):
    """The last record of an id wins; a combinable maximum instead of a sort of all records."""
    last = F.max(F.struct("seen_at", "raw_confidence", "x1", "y1", "x2", "y2")).alias("r")
    return v["v_det0"].groupBy("detection_id").agg(last).select("detection_id", "r.raw_confidence", "r.x1", "r.y1", "r.x2", "r.y2")
