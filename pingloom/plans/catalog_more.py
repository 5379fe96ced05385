"""Further queries: splits, consistency, projections, scalar families, report shapes."""

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import scratch, shared_dir
from ..operators import joins as J
from ..operators import rasters as R
from ..operators import scalar as S
from ..operators.rules import make_splits
from ..sources import files
from ..sources import navigation as N
from .catalog_boxes import TILES_SQL
from .catalog_joins import _annotations
from .registry import register


@register("J05_window_coverage_join", TILES_SQL + ", b AS (SELECT gt_id, frame_id, gx1 * 8 AS bx, gy1 * 8 AS by_, gx2 * 8 - gx1 * 8 AS bw, gy2 * 8 - gy1 * 8 AS bh FROM v_gt) SELECT gt_id, count(*) AS windows, min(x0) AS first_x, max(y0) AS last_y FROM b JOIN t ON b.frame_id = t.frame_id AND bx < x0 + 512 AND bx + bw > x0 AND by_ < y0 + 512 AND by_ + bh > y0 GROUP BY gt_id")
def j05(v):
    t = J.annotated_tiles(v["v_frames"], _annotations(v))
    return t.groupBy("gt_id").agg(F.count("*").alias("windows"), F.min("x0").alias("first_x"), F.max("y0").alias("last_y"))


@register("J14_contact_observation_join", "SELECT frame_id, raw_class, count(*) AS observations, round(max(raw_confidence), 6) AS best, max(seen_at) IS NOT NULL AS seen FROM v_det GROUP BY frame_id, raw_class")
def j14(v):
    """Contacts hold lists of detection ids; the bridge is exploded and joined on the id."""
    contacts = v["v_det"].groupBy("frame_id", "raw_class").agg(F.collect_list("detection_id").alias("ids"))
    bridge = contacts.select("frame_id", "raw_class", F.explode("ids").alias("detection_id"))
    d = v["v_det"].select("detection_id", "raw_confidence", "seen_at")
    return bridge.join(d, "detection_id").groupBy("frame_id", "raw_class").agg(F.count("*").alias("observations"), F.round(F.max("raw_confidence"), 6).alias("best"), F.max("seen_at").isNotNull().alias("seen"))


@register(
    "J18_manifest_metadata_consistency",
    """WITH m AS (SELECT frame_id, group_key, split FROM v_frames WHERE frame_id % 50 <> 1), d AS (SELECT frame_id, CASE WHEN frame_id % 90 = 13 THEN NULL WHEN frame_id % 40 = 3 THEN group_key + 1 ELSE group_key END AS group_key, CASE WHEN frame_id % 70 = 11 THEN 'train' ELSE split END AS split FROM v_frames WHERE frame_id % 60 <> 7)
    SELECT coalesce(m.frame_id, d.frame_id) AS frame_id, CASE WHEN d.frame_id IS NULL THEN 'no_metadata' WHEN m.frame_id IS NULL THEN 'not_in_manifest' WHEN d.group_key IS NULL THEN 'parent_missing' WHEN m.group_key <> d.group_key THEN 'parent_differs' WHEN m.split <> d.split THEN 'split_differs' END AS problem FROM m FULL JOIN d ON m.frame_id = d.frame_id
    WHERE d.frame_id IS NULL OR m.frame_id IS NULL OR d.group_key IS NULL OR m.group_key <> d.group_key OR m.split <> d.split""",
)
def j18(v):
    f, i = v["v_frames"].select("frame_id", "group_key", "split"), F.col("frame_id")
    m = f.filter("frame_id % 50 <> 1").select("frame_id", F.struct("group_key", "split").alias("m"))
    parent = F.when(i % 90 == 13, None).when(i % 40 == 3, F.col("group_key") + 1).otherwise(F.col("group_key"))
    d = f.filter("frame_id % 60 <> 7").select("frame_id", F.struct(parent.alias("group_key"), F.when(i % 70 == 11, "train").otherwise(F.col("split")).alias("split")).alias("d"))
    problem = F.when(F.col("d").isNull(), "no_metadata").when(F.col("m").isNull(), "not_in_manifest").when(F.col("d.group_key").isNull(), "parent_missing")
    problem = problem.when(F.col("m.group_key") != F.col("d.group_key"), "parent_differs").when(F.col("m.split") != F.col("d.split"), "split_differs")
    return m.join(d, "frame_id", "full").select("frame_id", problem.alias("problem")).filter("problem is not null")


@register(
    "G14_make_splits",
    """WITH g AS (SELECT group_key, CASE WHEN group_key % 17 = 0 THEN 'val' WHEN group_key % 23 = 0 THEN 'test' END AS fixed FROM (SELECT DISTINCT group_key FROM v_frames) AS x), r AS (SELECT *, row_number() OVER (ORDER BY sha256('20260830:' || group_key), group_key) - 1 AS i, count(*) OVER () AS n FROM g WHERE fixed IS NULL)
    SELECT group_key, fixed AS split FROM g WHERE fixed IS NOT NULL UNION ALL SELECT group_key, CASE WHEN i < CASE WHEN n > 2 THEN greatest(1, round_even(n * 0.2e0, 0)) ELSE 0 END THEN 'val' ELSE 'train' END FROM r""",
)
def g14(v):
    """Whole groups only: hints first, then official test groups, then the rest in seeded hash order."""
    k = F.col("group_key")
    return make_splits(v["v_frames"].select("group_key", F.when(k % 17 == 0, "val").alias("hint"), F.when(k % 23 == 0, "test").alias("official")))


@register(
    "A27_nadir_report",
    """WITH s AS (SELECT image_id, col_idx, sum(sample) AS total FROM v_imgs WHERE col_idx BETWEEN 29 AND 35 GROUP BY ALL), t AS (SELECT *, max(total) OVER (PARTITION BY image_id) AS top FROM s), n AS (SELECT image_id, image_id % 2 AS channel, image_id % 3 AS split, (min(col_idx) + max(col_idx)) / 2e0 - 32 AS off, count(*) AS tied FROM t WHERE total = top GROUP BY image_id)
    SELECT channel, split, count(*) AS images, min(off) AS least, round(median(off), 6) AS median, max(off) AS most, count(*) FILTER (WHERE off IN (-3, 3)) AS edge_hits, count(*) FILTER (WHERE tied > 1) AS ties FROM n GROUP BY GROUPING SETS ((channel), (channel, split), ())""",
)
def a27(v):
    n = R.nadir_by_column_sum(v["v_imgs"]).select((F.col("image_id") % 2).alias("channel"), (F.col("image_id") % 3).alias("split"), (F.col("nadir_col") - 32).alias("off"), F.col("tied_columns").alias("tied"))
    return n.groupingSets([["channel"], ["channel", "split"], []], "channel", "split").agg(F.count("*").alias("images"), F.min("off").alias("least"), F.round(F.median("off"), 6).alias("median"), F.max("off").alias("most"), F.count_if(F.col("off").isin(-3, 3)).alias("edge_hits"), F.count_if(F.col("tied") > 1).alias("ties"))


#: Boxes of all detections on rasters, dealt over all images, and what is known of the images: rows that dropped out, and
#: how wide their dark centre is.
PLACED = "SELECT d.detection_id AS box_id, d.frame_id % m.n AS image_id, CAST(floor(d.x1 / 8) AS INT) AS x1, CAST(floor(d.y1 / 2) AS INT) AS y1, CAST(floor(d.x1 / 8) AS INT) + 6 AS x2, CAST(floor(d.y1 / 2) AS INT) + 4 AS y2, d.tile_id FROM v_det AS d CROSS JOIN (SELECT max(image_id) + 1 AS n FROM v_imgs) AS m"
DROPPED = "SELECT image_id, row_idx FROM v_imgs GROUP BY image_id, row_idx HAVING avg(sample) < 127"


def placed(v):
    return v["v_det"].sparkSession.sql(PLACED.replace("FROM v_det", "FROM {d}").replace("FROM v_imgs", "FROM {i}"), d=v["v_det"], i=v["v_imgs"])


def dropped(v):
    return v["v_imgs"].groupBy("image_id", "row_idx").agg(F.avg("sample").alias("m")).filter("m < 127").select("image_id", "row_idx")


@register(
    "A30_orientation_evidence",
    f"""WITH w AS (SELECT image_id, median(sample::DOUBLE) AS base, greatest(1e0, stddev_pop(sample) * 2) AS spread FROM v_imgs GROUP BY image_id), b AS (SELECT *, CASE WHEN tile_id <> 5 THEN 32e0 END AS nadir FROM ({PLACED}) AS p),
    d AS (SELECT *, CASE WHEN (x1 + x2) / 2e0 > nadir THEN x2 ELSE greatest(0, x1 - 6) END AS s1, CASE WHEN (x1 + x2) / 2e0 > nadir THEN least(64, x2 + 6) ELSE x1 END AS s2 FROM b WHERE nadir IS NOT NULL),
    e AS (SELECT *, unnest(range(y1, y2)) AS row_idx FROM d),
    m AS (SELECT box_id, e.image_id, s2 - s1 AS cols, avg(sample) FILTER (WHERE col_idx >= x1 AND col_idx < x2) AS inside, avg(sample) FILTER (WHERE col_idx >= s1 AND col_idx < s2) AS shade FROM e JOIN v_imgs AS i ON e.image_id = i.image_id AND e.row_idx = i.row_idx AND col_idx >= least(x1, s1) AND col_idx < greatest(x2, s2) GROUP BY box_id, e.image_id, s1, s2),
    s AS (SELECT box_id, greatest(0e0, least(1e0, (inside - base) / spread)) AS hi, CASE WHEN shade IS NOT NULL THEN greatest(0e0, least(1e0, (base - shade) / spread)) END AS sh, CASE WHEN shade IS NOT NULL AND cols > 0 THEN 1e0 END AS dir, CASE WHEN shade IS NOT NULL THEN least(1e0, cols / 6e0) END AS geo FROM m JOIN w ON m.image_id = w.image_id WHERE inside IS NOT NULL),
    o AS (SELECT box_id, count(r.row_idx) > 0 AS dropout FROM e LEFT JOIN ({DROPPED}) AS r ON e.image_id = r.image_id AND e.row_idx = r.row_idx GROUP BY box_id)
    SELECT b.box_id, round(hi, 6) AS highlight_score, round(sh, 6) AS shadow_score, dir AS direction_score, round(geo, 6) AS geometry_score, round(list_avg([hi, sh, dir, geo]), 6) AS physics_consistency,
    CASE WHEN nadir IS NULL THEN 'UNKNOWN_ORIENTATION' WHEN hi IS NULL THEN 'INVALID_BBOX' ELSE concat_ws(',', CASE WHEN image_id % 2 = 0 AND abs((x1 + x2) / 2e0 - 32) <= 3.2e0 THEN 'NADIR_OVERLAP' END, CASE WHEN dropout THEN 'DROPOUT_OVERLAP' END, 'SHADOW_IS_NOT_ARTIFICIALITY') END AS flags
    FROM b LEFT JOIN s ON b.box_id = s.box_id LEFT JOIN o ON b.box_id = o.box_id""",
)
def a30(v):
    b = placed(v).withColumn("nadir", F.when(F.col("tile_id") != 5, 32.0)).withColumn("nadir_share", F.when(F.col("image_id") % 2 == 0, 0.1).otherwise(0.0))
    scores = ("highlight_score", "shadow_score", "geometry_score", "physics_consistency")
    return R.orientation(v["v_imgs"], b, dropped(v), 64).select("box_id", "direction_score", *[F.round(c, 6).alias(c) for c in scores], "flags")


@register(
    "A29_shadow_evidence",
    f"""WITH b AS (SELECT box_id, image_id, x1, 8 + CAST(floor(y1 * 2 / 3) AS INT) AS y1, x2, 8 + CAST(floor(y1 * 2 / 3) AS INT) + 4 AS y2, CASE WHEN tile_id = 2 THEN NULL ELSE 25e0 END AS nadir FROM ({PLACED}) AS p),
    d AS (SELECT *, (y1 + y2) / 2e0 AS mid, CAST(least(3 * greatest(1, y2 - y1), greatest(1, 50 / 4e0)) AS INT) AS len FROM b), e AS (SELECT *, CASE WHEN mid > nadir THEN y2 ELSE y1 - len END AS a, CASE WHEN mid > nadir THEN y2 + len ELSE y1 END AS z, CASE WHEN mid > nadir THEN y1 - (y2 - y1) ELSE y2 END AS u, CASE WHEN mid > nadir THEN y1 ELSE y2 + (y2 - y1) END AS w FROM d),
    r AS (SELECT *, CASE WHEN nadir IS NULL THEN 'NADIR_NOT_RECOVERABLE' WHEN x1 >= 64 OR y1 >= 50 THEN 'INVALID_CANDIDATE_GEOMETRY' WHEN abs(mid - nadir) < greatest(2e0, (y2 - y1) / 2e0) THEN 'CANDIDATE_IN_NADIR_BAND' WHEN a < 0 OR z > 50 THEN 'SHADOW_TRUNCATED_AT_RANGE_EDGE' END AS reason FROM e),
    x AS (SELECT box_id, image_id, x1, x2, a, z, u, w, unnest(range(least(a, u), greatest(z, w))) AS row_idx FROM r WHERE reason IS NULL),
    p AS (SELECT x.*, col_idx, sample, x.row_idx >= a AND x.row_idx < z AS band, x.row_idx >= u AND x.row_idx < w AS high, col_idx >= x1 AND col_idx < x2 AS inside FROM x JOIN v_imgs AS i ON x.image_id = i.image_id AND x.row_idx = i.row_idx AND col_idx >= x1 - 6 AND col_idx < x2 + 6),
    g AS (SELECT box_id, avg(sample) FILTER (WHERE band AND NOT inside) AS mean, stddev_pop(sample) FILTER (WHERE band AND NOT inside) AS std, avg(sample) FILTER (WHERE band AND inside) AS dark, avg(sample) FILTER (WHERE high AND inside) AS light FROM p GROUP BY box_id),
    l AS (SELECT q.box_id, avg(CASE WHEN m < mean - 1.5e0 * std THEN 1e0 ELSE 0e0 END) AS cont FROM (SELECT box_id, row_idx, avg(sample) AS m FROM p WHERE band AND inside GROUP BY ALL) AS q JOIN g ON q.box_id = g.box_id GROUP BY q.box_id),
    k AS (SELECT r.box_id, coalesce(reason, CASE WHEN mean IS NULL THEN 'RANGE_MATCHED_BACKGROUND_UNAVAILABLE' WHEN std < 1e-6 THEN 'RANGE_MATCHED_BACKGROUND_LOW_VARIANCE' END) AS reason, (mean - dark) / nullif(std, 0) AS z, cont, coalesce(light > mean, false) AS ok FROM r LEFT JOIN g ON r.box_id = g.box_id LEFT JOIN l ON r.box_id = l.box_id)
    SELECT box_id, reason, CASE WHEN reason IS NULL THEN round(z, 6) END AS contrast_z, CASE WHEN reason IS NULL THEN round(cont, 6) END AS continuity, CASE WHEN reason IS NULL THEN ok END AS ordering_ok,
    CASE WHEN reason IS NULL THEN round(greatest(0e0, least(1e0, 0.5e0 * tanh(greatest(0e0, z) / 2) + 0.35e0 * cont + CASE WHEN ok THEN 0.15e0 ELSE 0e0 END)), 6) END AS score FROM k""",
)
def a29(v):
    y = 8 + F.floor(F.col("y1") * 2 / 3).cast("int")
    b = placed(v).select("box_id", "image_id", "x1", y.alias("y1"), "x2", (y + 4).alias("y2"), F.when(F.col("tile_id") != 2, 25.0).alias("nadir"))
    return R.shadow(v["v_imgs"], b, 50, 64).select("box_id", "reason", *[F.round(c, 6).alias(c) for c in ("contrast_z", "continuity", "score")], "ordering_ok")


@register("P12_frame_pics", "SELECT detection_id, (x1 + x2) / 2 AS along_centre_px, (y1 + y2) / 2 AS across_centre_px, CASE WHEN frame_id % 4 = 0 THEN 'UNKNOWN' WHEN (y1 + y2) / 2 >= 50 THEN 'STARBOARD' ELSE 'PORT' END AS side, CASE WHEN frame_id % 3 = 0 THEN 'PING_INDEX_NOT_RECOVERABLE' END AS reason FROM v_det")
def p12(v):
    across = (F.col("y1") + F.col("y2")) / 2
    return v["v_det"].select("detection_id", ((F.col("x1") + F.col("x2")) / 2).alias("along_centre_px"), across.alias("across_centre_px"), F.when(F.col("frame_id") % 4 == 0, "UNKNOWN").when(across >= 50, "STARBOARD").otherwise("PORT").alias("side"), F.when(F.col("frame_id") % 3 == 0, "PING_INDEX_NOT_RECOVERABLE").alias("reason"))


@register("P18_ground_truth_free", "SELECT d.frame_id, raw_class, detection_id, gx1 FROM v_det AS d JOIN v_gt AS g ON g.gt_id = concat('g', d.detection_id)")
def p18(v):
    """Every column of the truth (``gt_...``) is dropped before a reference is built; reading one then fails when the plan is made."""
    g = v["v_gt"].select("gt_id", "gt_class", "gx1").withColumn("detection_id", F.substring("gt_id", 2, 1000))
    return S.ground_truth_free(v["v_det"].select("frame_id", "raw_class", "detection_id").join(g, "detection_id"))


@register("P19_raw_detection_fields", "SELECT detection_id, raw_class, raw_confidence, x1, y1, x2, y2 FROM v_det")
def p19(v):
    return v["v_det"].select("detection_id", "raw_class", "raw_confidence", "x1", "y1", "x2", "y2")


@register(
    "P27_validate_segments",
    """WITH s AS (SELECT frame_id, tile_id, CAST(y1 AS INT) AS a, CAST(y1 AS INT) + tile_id AS b, lag(CAST(y1 AS INT) + tile_id) OVER (PARTITION BY frame_id ORDER BY y1, x1, detection_id) AS before FROM v_det), k AS (SELECT frame_id, count(*) FILTER (WHERE before IS NOT NULL AND a > before + 1) AS gaps, count(*) FILTER (WHERE a <= before) AS overlapping, min(a) AS lo, max(b) AS hi FROM s GROUP BY frame_id)
    SELECT frame_id, gaps, overlapping, lo <> 0 AS starts_late, hi < 59 AS ends_early FROM k WHERE gaps > 0 OR overlapping > 0 OR lo <> 0 OR hi < 59""",
)
def p27(v):
    """Row segments of a frame must follow on one another and cover it once."""
    a = F.col("y1").cast("int")
    w = W.partitionBy("frame_id").orderBy("y1", "x1", "detection_id")
    s = v["v_det"].select("frame_id", a.alias("a"), (a + F.col("tile_id")).alias("b"), F.lag(a + F.col("tile_id")).over(w).alias("before"))
    k = s.groupBy("frame_id").agg(F.count_if(F.col("a") > F.col("before") + 1).alias("gaps"), F.count_if(F.col("a") <= F.col("before")).alias("overlapping"), F.min("a").alias("first"), F.max("b").alias("last"))
    k = k.select("frame_id", "gaps", "overlapping", (F.col("first") != 0).alias("starts_late"), (F.col("last") < 59).alias("ends_early"))
    return k.filter("gaps > 0 or overlapping > 0 or starts_late or ends_early")


@register("S07_scan_jsonl", "SELECT split, count(*) AS frames, sum(width)::BIGINT AS columns FROM v_frames GROUP BY split")
def s07(v):
    """Frames written as JSON lines once and read back with their schema."""
    import uuid

    f = v["v_frames"].select("frame_id", "split", "width")
    path = f"{shared_dir(f.sparkSession)}/jsonl-{uuid.uuid4().hex}"
    f.write.mode("errorifexists").json(path)
    back = f.sparkSession.read.schema(f.schema).json(path, mode="FAILFAST")
    return back.groupBy("split").agg(F.count("*").alias("frames"), F.sum("width").alias("columns"))


@register("S15_report_json", "SELECT survey_id, contact_id, category, evidence, 'pingloom' AS made_by FROM v_contacts")
def s15(v):
    """The full record of each contact with its provenance as a JSON line, in a folder for each survey, read back as a consumer would."""
    record = F.to_json(F.struct("contact_id", "category", "evidence", F.struct(F.lit("pingloom").alias("made_by")).alias("provenance")))
    path = scratch(v.spark)
    v["v_contacts"].select("survey_id", record.alias("value")).write.partitionBy("survey_id").text(path)
    back = v.spark.read.schema("contact_id string, category string, evidence double, provenance struct<made_by:string>, survey_id string").json(path, mode="FAILFAST")
    return back.select("survey_id", "contact_id", "category", "evidence", "provenance.made_by")


@register("S19_checksum_manifest")
def s19(v):
    """Checksums of the table's own files."""
    return files.checksums(v.spark, f"{v.sf_dir}/orders.parquet")


@register("C01_strings", "SELECT p_partkey, upper(substr(p_name, 1, 3)) AS head, split_part(p_name, ' ', 2) AS second, lpad(p_size::VARCHAR, 4, '0') AS padded, contains(p_brand, '1') AS has_one, regexp_extract(p_brand, '([0-9]+)', 1) AS number, trim('  ' || p_type || ' ') AS kind FROM part")
def c01(v):
    return v["part"].select("p_partkey", F.upper(F.substring("p_name", 1, 3)).alias("head"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.format_string("%04d", "p_size").alias("padded"), F.col("p_brand").contains("1").alias("has_one"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("kind"))


@register("C02_hashes", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS prefix, bit_count(p_partkey # 1023) AS bits FROM part".replace("p_partkey # 1023", "xor(p_partkey, 1023)"))
def c02(v):
    return v["part"].select("p_partkey", F.substring(F.sha2("p_name", 256), 1, 16).alias("prefix"), F.bit_count(F.col("p_partkey").bitwiseXOR(F.lit(1023).cast("bigint"))).alias("bits"))


@register("C03_times", "SELECT frame_id, CAST(floor(epoch_us(ts) / 300000000e0) AS BIGINT) AS block, year(ts) AS y, dayofyear(ts) AS d, hour(ts) AS h FROM v_nav")
def c03(v):
    return v["v_nav"].select("frame_id", F.floor(F.unix_micros("ts") / 300e6).alias("block"), F.year("ts").alias("y"), F.dayofyear("ts").alias("d"), F.hour("ts").alias("h"))


@register("C04_math", "SELECT contact_id, round(exp(evidence), 9) AS e, round(ln(1 + evidence), 9) AS l, round(sqrt(evidence), 9) AS s, round((exp(2 * evidence) - 1) / (exp(2 * evidence) + 1), 9) AS t, greatest(0.2e0, least(0.8e0, evidence)) AS c, CAST(ceil(evidence * 10) AS BIGINT) AS u FROM v_contacts")
def c04(v):
    x = F.col("evidence")
    return v["v_contacts"].select("contact_id", *[F.round(f, 9).alias(n) for f, n in ((F.exp(x), "e"), (F.log1p(x), "l"), (F.sqrt(x), "s"), (F.tanh(x), "t"))], F.when(x.isNotNull(), F.greatest(F.lit(0.2), F.least(F.lit(0.8), x))).otherwise(F.greatest(F.lit(0.2), F.lit(0.8))).alias("c"), F.ceil(x * 10).alias("u"))


@register("C05_arrays", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x * 100) AS BIGINT)) AS a FROM embeddings) SELECT vec_id, list_max(a) AS most, list_sum(a)::BIGINT AS total, len(list_distinct(a)) AS kinds, list_position(a, list_max(a)) - 1 AS argmax, array_to_string(list_sort(a), ',') AS ordered FROM e")
def c05(v):
    a = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")))
    e = v["embeddings"].select("vec_id", a.alias("a"))
    return e.select("vec_id", F.array_max("a").alias("most"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.size(F.array_distinct("a")).cast("bigint").alias("kinds"), (F.array_position("a", F.array_max("a")) - 1).alias("argmax"), F.array_join(F.transform(F.array_sort("a"), lambda x: x.cast("string")), ",").alias("ordered"))


@register("C06_maps_and_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 END, 0) AS code FROM events")
def c06(v):
    table = F.map_concat(F.create_map(F.lit("click"), F.lit(1)), F.create_map(F.lit("error"), F.lit(2)))
    return v["events"].select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.coalesce(F.element_at(table, F.col("event_type")), F.lit(0)).alias("code"))


@register("P02_class_index", "SELECT detection_id, CASE raw_class WHEN 'PIPELINE' THEN 0 WHEN 'SHIPWRECK' THEN 1 WHEN 'CRAB_POT' THEN 2 END AS class_index FROM (SELECT detection_id, CASE WHEN tile_id = 4 THEN 'UNKNOWN' ELSE raw_class END AS raw_class FROM v_det) AS d")
def p02(v):
    """The training index of each class; unknown classes get none."""
    named = F.when(F.col("tile_id") == 4, "UNKNOWN").when(F.col("raw_class") == "SHIPWRECK", "WRECK_OR_STRUCTURAL_DEBRIS").when(F.col("raw_class") == "CRAB_POT", "DERELICT_FISHING_GEAR").otherwise(F.col("raw_class"))
    return S.class_index(v["v_det"].select("detection_id", named.alias("canonical_class"))).select("detection_id", "class_index")


@register("S08_scan_coco", "SELECT concat(survey_id, '.json') AS file, d.frame_id || '.png' AS file_name, raw_class AS category, detection_id AS name, x1, y1, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h FROM v_det AS d JOIN v_frames AS f ON d.frame_id = f.frame_id WHERE tile_id <> 6")
def s08(v):
    """Boxes written as a COCO file for each survey and scanned back; boxes without four numbers are left out."""
    d = v["v_det"].join(v["v_frames"].select(F.col("frame_id"), "survey_id"), "frame_id").withColumn("category_id", F.when(F.col("raw_class") == "PIPELINE", 1).when(F.col("raw_class") == "SHIPWRECK", 2).otherwise(3).cast("bigint"))
    box = F.when(F.col("tile_id") != 6, F.array("x1", "y1", F.expr("x2 - x1"), F.expr("y2 - y1"))).otherwise(F.array("x1", "y1", F.expr("x2 - x1")))
    image = F.struct(F.col("frame_id").alias("id"), F.concat(F.col("frame_id").cast("string"), F.lit(".png")).alias("file_name"))
    note = F.struct(F.xxhash64("detection_id").alias("id"), F.col("frame_id").alias("image_id"), "category_id", box.alias("bbox"), F.col("detection_id").alias("name"))
    kinds = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(n).alias("name")) for i, n in ((1, "PIPELINE"), (2, "SHIPWRECK"), (3, "CRAB_POT"))])
    docs = d.groupBy("survey_id").agg(F.collect_set(image).alias("images"), F.collect_list(note).alias("annotations")).withColumn("categories", kinds)
    path = scratch(docs.sparkSession)
    docs.write.partitionBy("survey_id").json(path)
    out = files.scan_coco(docs.sparkSession, path)
    return out.select(F.concat(F.regexp_extract("path", "survey_id=([^/]*)/", 1), F.lit(".json")).alias("file"), "file_name", "category", "name", F.col("bbox")[0].alias("x1"), F.col("bbox")[1].alias("y1"), F.round(F.col("bbox")[2], 6).alias("w"), F.round(F.col("bbox")[3], 6).alias("h"))


@register("S12_write_immutable", "SELECT contact_id, survey_id, true AS refused FROM v_contacts")
def s12(v):
    """Contacts written once and read back; a second write to the same place is refused."""
    c = v["v_contacts"].select("contact_id", "survey_id")
    path = scratch(c.sparkSession)
    N.write_immutable(c, path)
    try:
        N.write_immutable(c, path)
        refused = False
    except AnalysisException:
        refused = True
    return c.sparkSession.read.schema("contact_id string, survey_id string").json(path).withColumn("refused", F.lit(refused))
