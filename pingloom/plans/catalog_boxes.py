"""Queries of projections, filters and box arithmetic."""

from pyspark.sql import functions as F

from ..functions import boxes, scores
from ..operators import scalar as S
from .registry import register

IOU_SQL = "CASE WHEN least({a}x2, {b}x2) - greatest({a}x1, {b}x1) <= 0 OR least({a}y2, {b}y2) - greatest({a}y1, {b}y1) <= 0 THEN 0e0 ELSE (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1)) / (({a}x2 - {a}x1) * ({a}y2 - {a}y1) + ({b}x2 - {b}x1) * ({b}y2 - {b}y1) - (least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * (least({a}y2, {b}y2) - greatest({a}y1, {b}y1))) END"


@register(
    "P01_map_classes",
    """WITH m(dataset, source_class, canonical_class, certainty) AS (VALUES ('subpipe','pipeline','PIPELINE','CERTAIN'),('ai4shipwrecks','wreck','WRECK_OR_STRUCTURAL_DEBRIS','CERTAIN'),
    ('pingeco_ghostpot','Crab-Pot','DERELICT_FISHING_GEAR','CERTAIN'),('pingeco_ghostpot','Maybe-Crab-Pot','DERELICT_FISHING_GEAR','UNCERTAIN'),('marine_pulse','seabed_surface',NULL,NULL)),
    s AS (SELECT detection_id, CASE raw_class WHEN 'PIPELINE' THEN 'subpipe' WHEN 'SHIPWRECK' THEN 'ai4shipwrecks' ELSE CASE WHEN tile_id = 7 THEN 'marine_pulse' ELSE 'pingeco_ghostpot' END END AS dataset,
      CASE raw_class WHEN 'PIPELINE' THEN 'pipeline' WHEN 'SHIPWRECK' THEN 'wreck' ELSE CASE WHEN tile_id = 7 THEN 'seabed_surface' WHEN tile_id % 2 = 0 THEN 'Crab-Pot' ELSE 'Maybe-Crab-Pot' END END AS source_class FROM v_det)
    SELECT detection_id, s.dataset, s.source_class, canonical_class, certainty, CASE canonical_class WHEN 'PIPELINE' THEN 0 WHEN 'WRECK_OR_STRUCTURAL_DEBRIS' THEN 1 WHEN 'DERELICT_FISHING_GEAR' THEN 2 END AS class_index
    FROM s JOIN m ON s.dataset = m.dataset AND s.source_class = m.source_class""",
)
def p01(v):
    c, t = F.col("raw_class"), F.col("tile_id")
    dataset = F.when(c == "PIPELINE", "subpipe").when(c == "SHIPWRECK", "ai4shipwrecks").when(t == 7, "marine_pulse").otherwise("pingeco_ghostpot")
    source = F.when(c == "PIPELINE", "pipeline").when(c == "SHIPWRECK", "wreck").when(t == 7, "seabed_surface").when(t % 2 == 0, "Crab-Pot").otherwise("Maybe-Crab-Pot")
    return S.class_index(S.map_classes(v["v_det"].select("detection_id", dataset.alias("dataset"), source.alias("source_class"))))


@register("P03_stable_id", "SELECT detection_id, substr(sha256(detection_id || chr(0) || CAST(frame_id AS VARCHAR) || chr(0) || raw_class), 1, 16) AS stable_id FROM v_det")
def p03(v):
    return v["v_det"].select("detection_id", S.stable_id(F.col("detection_id"), F.col("frame_id").cast("string"), F.col("raw_class")).alias("stable_id"))


@register("P04_box_convert", "SELECT detection_id, x1, y1, x2 - x1 AS w, y2 - y1 AS h, round((x1 + (x2 - x1) / 2) / 640, 9) AS cx, round((y1 + (y2 - y1) / 2) / 120, 9) AS cy FROM v_det")
def p04(v):
    x, y, w, h = boxes.to_xywh(boxes.named())
    return v["v_det"].select("detection_id", "x1", "y1", w.alias("w"), h.alias("h"), F.round((x + w / 2) / 640, 9).alias("cx"), F.round((y + h / 2) / 120, 9).alias("cy"))


@register("P05_box_iou", f"SELECT a.detection_id AS a_id, b.detection_id AS b_id, round({IOU_SQL.format(a='a.', b='b.')}, 9) AS iou FROM v_det AS a JOIN v_det AS b ON a.frame_id = b.frame_id AND a.raw_class = b.raw_class AND a.detection_id < b.detection_id")
def p05(v):
    a, b = v["v_det"].alias("a"), v["v_det"].alias("b")
    both = a.join(b, F.expr("a.frame_id = b.frame_id and a.raw_class = b.raw_class and a.detection_id < b.detection_id"))
    return both.select(F.col("a.detection_id").alias("a_id"), F.col("b.detection_id").alias("b_id"), F.round(boxes.iou(boxes.named("a."), boxes.named("b.")), 9).alias("iou"))


TILES_SQL = """WITH a AS (SELECT frame_id, width, height, unnest(CASE WHEN height <= 512 THEN [0::BIGINT] ELSE range(0, height, 256) END) AS y0 FROM v_frames),
t AS (SELECT frame_id, width, height, unnest(CASE WHEN width <= 512 THEN [0::BIGINT] ELSE range(0, width, 256) END) AS x0, y0 FROM a) """


@register("P06_tile_grid", TILES_SQL + "SELECT frame_id, x0, y0, greatest(0, x0 + 512 - width) AS padded_right, greatest(0, y0 + 512 - height) AS padded_bottom, frame_id || '_x' || lpad(x0::VARCHAR, 5, '0') || '_y' || lpad(y0::VARCHAR, 5, '0') AS tile_key FROM t")
def p06(v):
    return S.tile_grid(v["v_frames"])


@register("P07_needs_tiling", "SELECT frame_id, width > 1024 OR height > 1024 OR greatest(width, height) * 1e0 / greatest(1, least(width, height)) > 1.6 AS tiled FROM v_frames")
def p07(v):
    return v["v_frames"].select("frame_id", S.needs_tiling(F.col("width"), F.col("height")).alias("tiled"))


@register(
    "P08_tile_box_to_frame",
    """WITH b AS (SELECT detection_id, greatest(0e0, least(640e0, x1 + tile_id * 96)) AS fx1, greatest(0e0, least(120e0, y1 + tile_id * 15)) AS fy1, greatest(0e0, least(640e0, x2 + tile_id * 96)) AS fx2, greatest(0e0, least(120e0, y2 + tile_id * 15)) AS fy2 FROM v_det)
    SELECT * FROM b WHERE fx2 > fx1 AND fy2 > fy1""",
)
def p08(v):
    d = v["v_det"].withColumns({"x0": F.col("tile_id") * 96, "y0": F.col("tile_id") * 15, "width": F.lit(640), "height": F.lit(120)})
    return S.tile_box_to_frame(d).select("detection_id", "fx1", "fy1", "fx2", "fy2")


@register(
    "P10_clip_export_boxes",
    "SELECT raw_class, count(*) AS boxes, count(*) FILTER (WHERE x1 + (x2 - x1) > 400) AS clipped, round(sum(least(x2 - x1, 400 - x1)), 6) AS kept_width FROM v_det WHERE x1 < 400 GROUP BY raw_class",
)
def p10(v):
    """Widths cut at the image's edge, counted; a box that starts outside fails."""
    d = v["v_det"].withColumn("w", F.col("x2") - F.col("x1"))
    d = d.withColumn("w", F.when(F.col("x1") < 400, F.col("w")).otherwise(F.raise_error(F.lit("box starts outside the image")).cast("double")))
    return d.groupBy("raw_class").agg(F.count("*").alias("boxes"), F.count_if(F.col("x1") + F.col("w") > 400).alias("clipped"), F.round(F.sum(F.least(F.col("w"), 400 - F.col("x1"))), 6).alias("kept_width"))


PICS_IN = "SELECT detection_id, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, CASE WHEN frame_id % 4 = 0 THEN NULL ELSE 50e0 END AS nadir, CASE WHEN frame_id % 2 = 0 THEN 'COLS' ELSE 'ROWS' END AS axis, CASE WHEN frame_id % 3 = 0 THEN NULL ELSE frame_id * 10e0 END AS ping_start, CASE WHEN frame_id % 5 = 0 THEN -1e0 ELSE 1e0 END AS along_sign, CASE WHEN frame_id % 7 = 0 THEN NULL ELSE 2e0 END AS stride, CASE WHEN frame_id % 2 = 0 THEN 0.05e0 END AS scale FROM v_det"


@register(
    "P11_pixel_to_pics",
    f"""WITH i AS ({PICS_IN}) SELECT detection_id, CASE WHEN nadir IS NOT NULL THEN ping_start + along_sign * (CASE WHEN axis = 'COLS' THEN px ELSE py END) * coalesce(stride, 1e0) END AS ping,
    round(CASE WHEN nadir IS NOT NULL THEN abs((CASE WHEN axis = 'COLS' THEN py ELSE px END) - nadir) * coalesce(scale, 1e0) END, 9) AS range_value,
    CASE WHEN nadir IS NOT NULL AND scale IS NOT NULL THEN 'METRIC_RANGE' ELSE 'PIXEL_RANGE' END AS range_unit,
    CASE WHEN nadir IS NULL THEN 'UNKNOWN' WHEN (CASE WHEN axis = 'COLS' THEN py ELSE px END) < nadir THEN 'PORT' ELSE 'STARBOARD' END AS side FROM i""",
)
def p11(v):
    i = v["v_det"].sparkSession.sql(PICS_IN.replace("FROM v_det", "FROM {d}"), d=v["v_det"])
    return S.pixel_to_pics(i).select("detection_id", "ping", F.round("range_value", 9).alias("range_value"), "range_unit", "side")


NAMES_IN = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('Rec00', doc_id, '_a.png.rf.', source, '.jpg') WHEN 1 THEN concat('contact_0', doc_id % 40, '_b.rf.x.jpg') WHEN 2 THEN concat('TI', doc_id % 9, '_z.jpg') WHEN 3 THEN concat('BayCove', doc_id, '.jpg') ELSE concat(source, 'X.rf.q') END AS name FROM documents"


@register(
    "P13_extract_groups",
    f"""WITH n AS ({NAMES_IN}), p AS (SELECT *, split_part(name, '.rf.', 1) AS parent FROM n),
    r AS (SELECT *, regexp_extract(parent, '(?i)^Rec0*([0-9]+)_', 1) AS rec, regexp_extract(parent, '(?i)^Contact_([0-9]+)_', 1) AS con, regexp_extract(parent, '(?i)^(BC_POST|TI[0-9]+|MC[0-9]+|baycove)', 1) AS site FROM p)
    SELECT doc_id, name, CASE WHEN rec <> '' THEN 'ping_recording_rec' || CAST(rec AS BIGINT) WHEN con <> '' THEN 'ping_contact_' || CAST(con AS BIGINT) ELSE 'ping_' || lower(CASE WHEN site <> '' THEN site ELSE parent END) END AS group_key FROM r""",
)
def p13(v):
    d = v["documents"]
    return S.extract_groups(d.sparkSession.sql(NAMES_IN.replace("FROM documents", "FROM {d}"), d=d))


_PATHS = "SELECT event_id, concat(CASE WHEN event_id % 2 = 0 THEN 'SSS_HF_images' ELSE 'a/SSS_LF_images' END, '/Image/', 1693569378 + event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('.', 100 + event_id % 900) END, '.pbm') AS name FROM events"


@register("P13_channel_time", f"WITH n AS ({_PATHS}) SELECT event_id, regexp_extract('/' || name, '/SSS_(HF|LF)_images/', 1) AS channel, CAST(regexp_extract(name, '/([0-9]+([.][0-9]+)?)[.][a-z]+$', 1) AS DECIMAL(20, 6)) AS stamp FROM n")
def p13_channel(v):
    """Channel and exact time of frames from their source paths."""
    return S.channel_time(v["events"].sparkSession.sql(_PATHS.replace("FROM events", "FROM {e}"), e=v["events"])).select("event_id", "channel", "stamp")


@register("P15_display_confidence", "SELECT detection_id, round(0.70e0 + (0.90e0 - 0.70e0) / (1 + exp(-28e0 * (raw_confidence - 0.3139777305538386e0))), 9) AS shown FROM v_det")
def p15(v):
    return v["v_det"].select("detection_id", F.round(scores.display_confidence(F.col("raw_confidence")), 9).alias("shown"))


@register(
    "P16_demo_presentation",
    """WITH i AS (SELECT detection_id, raw_class, CASE WHEN tile_id = 3 THEN NULL ELSE raw_confidence END AS rc, CASE WHEN tile_id % 2 = 0 THEN raw_confidence / 2 END AS an FROM v_det),
    s AS (SELECT *, CASE WHEN raw_class = 'SHIPWRECK' AND rc IS NOT NULL THEN rc ELSE an END AS sig FROM i), t AS (SELECT *, sig IS NOT NULL AND (raw_class = 'SHIPWRECK' OR an IS NOT NULL) AS shown FROM s)
    SELECT detection_id, CASE WHEN shown THEN 'SHIPWRECK' ELSE raw_class END AS display_class, round(CASE WHEN shown THEN least(0.94e0, greatest(0.72e0, sig * 0.85e0 + 0.15e0)) ELSE rc END, 9) AS display_confidence,
    CASE WHEN shown THEN 'DEMO_HEURISTIC' ELSE 'MODEL' END AS classification_source, NOT shown AND (sig IS NOT NULL OR raw_class <> 'SHIPWRECK') AS production_qualified FROM t""",
)
def p16(v):
    d = v["v_det"].withColumn("anomaly_score", F.when(F.col("tile_id") % 2 == 0, F.col("raw_confidence") / 2)).withColumn("raw_confidence", F.when(F.col("tile_id") != 3, F.col("raw_confidence")))
    return S.demo_presentation(d).select("detection_id", "display_class", F.round("display_confidence", 9).alias("display_confidence"), "classification_source", "production_qualified")


_LISTED = "SELECT detection_id, CASE WHEN raw_confidence < 0.25 THEN 'ANOMALY' ELSE 'DETECTION' END AS kind, raw_class, CASE WHEN tile_id <> 3 THEN raw_confidence END AS raw_confidence, CASE tile_id WHEN 1 THEN 'NEW' WHEN 2 THEN 'UNCHANGED' END AS change_status, CASE WHEN frame_id % 4 = 0 THEN 'CONFIRMED' END AS latest_verdict FROM v_det"


@register("P20_detections_query", f"WITH f AS (SELECT *, count(*) OVER () AS total FROM ({_LISTED}) AS l WHERE raw_class = 'PIPELINE' AND coalesce(raw_confidence, 0) >= 0.25) SELECT * FROM f ORDER BY raw_confidence DESC NULLS LAST, detection_id LIMIT 50 OFFSET 100")
def p20(v):
    d = v["v_det"].sparkSession.sql(_LISTED.replace("FROM v_det", "FROM {d}"), d=v["v_det"])
    return S.detections_page(d, category="PIPELINE", min_confidence=0.25, offset=100)


@register("P20_detections_all_filters", f"WITH f AS (SELECT *, count(*) OVER () AS total FROM ({_LISTED}) AS l WHERE kind = 'DETECTION' AND raw_class = 'CRAB_POT' AND change_status = 'NEW' AND latest_verdict IS NOT NULL) SELECT * FROM f ORDER BY raw_confidence NULLS LAST, detection_id LIMIT 20")
def p20_all(v):
    d = v["v_det"].sparkSession.sql(_LISTED.replace("FROM v_det", "FROM {d}"), d=v["v_det"])
    return S.detections_page(d, kind="DETECTION", category="CRAB_POT", change_status="NEW", reviewed=True, best_first=False, limit=20)


_ROLL = "SELECT contact_id, survey_id, category, CASE WHEN latest_verdict = 'CONFIRMED' THEN category END AS analyst_class, latest_verdict, strength AS priority, CAST(substr(contact_id, 2) AS BIGINT) * 37 % 1009 AS created FROM v_contacts"


@register("P21_contacts_query", f"WITH f AS (SELECT *, count(*) OVER () AS total FROM ({_ROLL}) AS l WHERE list_contains(['s3','s5','s7'], survey_id) AND contains(contact_id, '1')) SELECT * FROM f ORDER BY contact_id DESC LIMIT 50")
def p21(v):
    c = v["v_contacts"].sparkSession.sql(_ROLL.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"])
    return S.contacts_page(c, surveys=["s3", "s5", "s7"], text="1")


@register("P21_contacts_all_filters", f"WITH f AS (SELECT *, count(*) OVER () AS total FROM ({_ROLL}) AS l WHERE category = 'PIPELINE' AND latest_verdict IS NULL AND priority >= 0.2) SELECT * FROM f ORDER BY priority DESC NULLS LAST, contact_id LIMIT 10 OFFSET 2")
def p21_all(v):
    c = v["v_contacts"].sparkSession.sql(_ROLL.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"])
    return S.contacts_page(c, machine_class="PIPELINE", reviewed=False, least_priority=0.2, sort="priority", offset=2, limit=10)


@register("P21_contacts_newest", f"WITH f AS (SELECT *, count(*) OVER () AS total FROM ({_ROLL}) AS l WHERE analyst_class = 'PIPELINE' AND latest_verdict = 'CONFIRMED') SELECT * FROM f ORDER BY created DESC NULLS LAST, contact_id LIMIT 50")
def p21_newest(v):
    c = v["v_contacts"].sparkSession.sql(_ROLL.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"])
    return S.contacts_page(c, analyst_class="PIPELINE", status="CONFIRMED", sort="newest")


@register(
    "P26_opaque_order",
    "WITH h AS (SELECT frame_id, sha256('salt-1|' || CAST(frame_id AS VARCHAR)) AS h FROM v_frames) SELECT frame_id, substr(h, 1, 16) AS opaque_id, row_number() OVER (ORDER BY h, frame_id) - 1 AS presentation_rank FROM h",
)
def p26(v):
    return S.opaque_order(v["v_frames"].select("frame_id"), "frame_id", "salt-1")


@register(
    "P31_feedback_eligibility",
    """WITH l AS (SELECT contact_id, arg_max(verdict, (created_at, event_id)) AS verdict FROM v_reviews WHERE verdict IS NOT NULL GROUP BY contact_id),
    i AS (SELECT c.contact_id, l.verdict, c.survey_id <> 's4' AS licence_ok, CASE c.segment WHEN 'BUILDING' THEN 'val' WHEN 'MACHINERY' THEN 'test' ELSE 'train' END AS split FROM v_contacts AS c LEFT JOIN l ON c.contact_id = l.contact_id),
    r AS (SELECT contact_id, CASE WHEN verdict IS NULL THEN 'NO_REVIEW' WHEN NOT licence_ok THEN 'LICENCE_DOES_NOT_PERMIT_TRAINING' WHEN split IN ('val', 'test') THEN 'EVALUATION_SPLIT' END AS reason FROM i)
    SELECT contact_id, reason IS NULL AS eligible, reason FROM r""",
)
def p31(v):
    last = v["v_reviews"].filter("verdict is not null").groupBy("contact_id").agg(F.max_by("verdict", F.struct("created_at", "event_id")).alias("verdict"))
    c = v["v_contacts"].select("contact_id", (F.col("survey_id") != "s4").alias("licence_ok"), F.when(F.col("segment") == "BUILDING", "val").when(F.col("segment") == "MACHINERY", "test").otherwise("train").alias("split"))
    return S.feedback_eligibility(c.join(last, "contact_id", "left")).select("contact_id", "eligible", "reason")


@register(
    "P32_temporal_split_plan",
    """WITH b AS (SELECT frame_id, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM v_nav)) / 300000000e0) AS BIGINT) AS block FROM v_nav),
    s AS (SELECT *, CASE WHEN block BETWEEN 0 AND 9 THEN 'train' WHEN block BETWEEN 13 AND 23 THEN 'val' WHEN block >= 27 THEN 'test' END AS split_hint FROM b)
    SELECT frame_id, block, split_hint, CASE WHEN split_hint IS NULL THEN 'TEMPORAL_OVERLAP_EMBARGO' END AS excluded_reason FROM s""",
)
def p32(v):
    return S.temporal_split_plan(v["v_nav"].select("frame_id", "ts")).drop("ts")


@register(
    "A06_contact_priority",
    """WITH s AS (SELECT *, CASE WHEN coalesce(evidence, persistence, quality) IS NOT NULL THEN (coalesce(evidence, 0e0) + coalesce(persistence, 0e0) + coalesce(quality, 0e0)) / ((evidence IS NOT NULL)::INT + (persistence IS NOT NULL)::INT + (quality IS NOT NULL)::INT) END AS p FROM v_contacts)
    SELECT contact_id, round(p, 9) AS priority_score, CASE WHEN p >= 0.75 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'LOW' ELSE 'UNAVAILABLE' END AS priority_band,
    CASE WHEN p IS NULL THEN 'REVIEW' WHEN coalesce(quality, 0e0) < 0.45 THEN CASE WHEN has_navigation THEN 'REACQUIRE' ELSE 'REVIEW' END WHEN latest_verdict = 'CONFIRMED' AND p >= 0.75 THEN 'RECOVERY_CANDIDATE' WHEN p >= 0.6 THEN 'INSPECT' ELSE 'REVIEW' END AS recommended_action,
    concat_ws(',', CASE WHEN evidence IS NULL THEN 'evidence' END, CASE WHEN persistence IS NULL THEN 'persistence' END, CASE WHEN quality IS NULL THEN 'quality' END) AS missing FROM s""",
)
def a06(v):
    return S.contact_priority(v["v_contacts"]).select("contact_id", F.round("priority_score", 9).alias("priority_score"), "priority_band", "recommended_action", F.array_join("missing_components", ",").alias("missing"))


@register(
    "A04_evidence_score",
    """WITH i AS (SELECT contact_id, evidence AS d, persistence AS p, CASE WHEN coalesce(verification, '') <> 'INSUFFICIENT_EVIDENCE' THEN physics END AS f, quality AS q, anomaly AS a, artificiality AS r FROM v_contacts),
    w AS (SELECT *, CASE WHEN d IS NULL THEN 0e0 ELSE 0.30e0 END + CASE WHEN p IS NULL THEN 0e0 ELSE 0.25e0 END + CASE WHEN f IS NULL THEN 0e0 ELSE 0.18e0 END + CASE WHEN q IS NULL THEN 0e0 ELSE 0.15e0 END + CASE WHEN a IS NULL THEN 0e0 ELSE 0.07e0 END + CASE WHEN r IS NULL THEN 0e0 ELSE 0.05e0 END AS t FROM i)
    SELECT contact_id, round(CASE WHEN t > 0 THEN (coalesce(d * 0.30e0, 0e0) + coalesce(p * 0.25e0, 0e0) + coalesce(f * 0.18e0, 0e0) + coalesce(q * 0.15e0, 0e0) + coalesce(a * 0.07e0, 0e0) + coalesce(r * 0.05e0, 0e0)) / t END, 9) AS evidence_score,
    concat_ws(',', CASE WHEN a IS NULL THEN 'anomaly' END, CASE WHEN r IS NULL THEN 'artificiality' END, CASE WHEN d IS NULL THEN 'detector' END, CASE WHEN p IS NULL THEN 'persistence' END, CASE WHEN f IS NULL THEN 'physics' END, CASE WHEN q IS NULL THEN 'quality' END) AS missing FROM w""",
)
def a04(v):
    return S.evidence_score(v["v_contacts"].withColumnRenamed("evidence", "confidence")).select("contact_id", F.round("evidence_score", 9).alias("evidence_score"), F.array_join("missing_channels", ",").alias("missing"))


@register(
    "A05_confidence_fusion",
    """WITH i AS (SELECT contact_id, unnest([{'w': 0.65e0, 's': evidence}, {'w': 0.70e0, 's': greatest(0e0, (persistence - 0.15e0) / 0.85e0)}, {'w': 0.60e0, 's': CASE WHEN verification IN ('SUPPORTED', 'WEAK_SUPPORT') THEN strength END},
      {'w': 0.35e0, 's': CASE WHEN coalesce(verification, '') <> 'INSUFFICIENT_EVIDENCE' THEN physics END}, {'w': 0.20e0, 's': quality}, {'w': 0.30e0, 's': CASE WHEN anomaly IS NOT NULL THEN greatest(0e0, (anomaly - 0.4617e0) / (1 - 0.4617e0)) END}, {'w': 0.15e0, 's': artificiality}, {'w': 0.15e0, 's': navigation}]) AS c FROM
      (SELECT contact_id, evidence, CASE WHEN persistence IS NOT NULL THEN persistence END AS persistence, verification, strength, physics, quality, anomaly, artificiality, navigation FROM v_contacts)),
    a AS (SELECT contact_id, product(1 - c.w * c.s) FILTER (WHERE c.s > 0) AS miss, count(*) FILTER (WHERE c.s > 0) AS n, sum(c.s) FILTER (WHERE c.s > 0) AS t, sum(c.s * c.s) FILTER (WHERE c.s > 0) AS q FROM i GROUP BY contact_id),
    f AS (SELECT contact_id, 1 - coalesce(miss, 1e0) AS base, CASE WHEN n > 1 THEN (t * t - q) / (n * (n - 1)) ELSE 0e0 END AS sig FROM a),
    r AS (SELECT contact_id, greatest(0e0, least(1e0, base + (1 - base) * 0.18e0 * sig)) AS raw FROM f)
    SELECT contact_id, round(raw, 9) AS raw_fused_confidence, round(0.70e0 + (0.90e0 - 0.70e0) / (1 + exp(-28e0 * (raw - 0.3139777305538386e0))), 9) AS fused_confidence FROM r""",
)
def a05(v):
    return S.confidence_fusion(v["v_contacts"].withColumnRenamed("evidence", "confidence")).select("contact_id", F.round("raw_fused_confidence", 9).alias("raw_fused_confidence"), F.round("fused_confidence", 9).alias("fused_confidence"))


@register(
    "A07_recovery_priority",
    """SELECT contact_id, round(CASE WHEN evidence IS NOT NULL AND area_m2 IS NOT NULL THEN evidence * 0.30e0 + coalesce(persistence, 0.5e0) * 0.20e0 + coalesce(greatest(physics, anomaly), 0e0) * 0.15e0
    + least(1e0, ln(1 + greatest(0e0, area_m2)) / ln(201e0)) * 0.15e0 + CASE category WHEN 'DERELICT_FISHING_GEAR' THEN 1.00e0 WHEN 'WRECK_OR_STRUCTURAL_DEBRIS' THEN 0.70e0 WHEN 'PIPELINE' THEN 0.60e0 WHEN 'ENGINEERING_STRUCTURE' THEN 0.50e0 ELSE 0.75e0 END * 0.12e0
    + CASE change_status WHEN 'NEW' THEN 1.00e0 WHEN 'MOVED' THEN 0.80e0 WHEN 'UNCHANGED' THEN 0.40e0 WHEN 'NOT_REOBSERVED' THEN 0.30e0 WHEN 'OUT_OF_COVERAGE' THEN 0.50e0 ELSE 0.60e0 END * 0.08e0 END, 9) AS recovery_score FROM v_contacts""",
)
def a07(v):
    c = v["v_contacts"].withColumnsRenamed({"evidence": "confidence", "physics": "shadow_score", "anomaly": "anomaly_score"})
    return S.recovery_priority(c).select("contact_id", F.round("recovery_score", 9).alias("recovery_score"))


@register(
    "P24_evidence_feature_vector",
    """SELECT contact_id, round(ln(p / (1 - p)), 9) AS logit, coalesce(persistence, 0e0) AS wilson, round(ln(1 + coalesce(strength * 10, 0e0)), 9) AS log_opportunities, coalesce(physics, 0e0) AS shadow,
    CASE WHEN physics IS NOT NULL THEN 1e0 ELSE 0e0 END AS shadow_applicable, coalesce(anomaly, 0e0) AS anomaly, coalesce(quality, 0e0) AS context_z, coalesce(artificiality, 0e0) AS clutter FROM (SELECT *, least(1e0 - 1e-6, greatest(1e-6, evidence)) AS p FROM v_contacts WHERE evidence IS NOT NULL) AS c""",
)
def p24(v):
    c = v["v_contacts"].filter("evidence is not null").withColumn("opportunities", F.col("strength") * 10).withColumnsRenamed({"evidence": "confidence", "physics": "shadow_score", "anomaly": "anomaly_score"})
    return S.evidence_features(c).select("contact_id", F.round("logit", 9).alias("logit"), "wilson", F.round("log_opportunities", 9).alias("log_opportunities"), "shadow", "shadow_applicable", "anomaly", F.coalesce("quality", F.lit(0.0)).alias("context_z"), F.coalesce("artificiality", F.lit(0.0)).alias("clutter"))
