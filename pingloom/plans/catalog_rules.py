"""Queries of contracts, populations, splits, gates, orders, and rasters as files."""

from pyspark.sql import functions as F

from ..functions.storage import scratch
from ..operators import ordered
from ..operators import rules as R
from ..operators import scalar as P
from ..operators import sequential as S
from ..sources import files
from .catalog_graphs import MATCH
from .catalog_boxes import IOU_SQL
from .catalog_joins import CLIP_SQL, PING_FRAMES, p09, ping_rows
from .registry import register

#: Contacts as records of the contract; some break a rule.
_RECORDS = """SELECT contact_id, CAST(substr(contact_id, 2) AS BIGINT) % 9 = 0 AS is_demo, CASE WHEN CAST(substr(contact_id, 2) AS BIGINT) % 2 = 0 THEN 'demo' END AS demo_banner,
    physics IS NOT NULL AS applicable, CASE WHEN verification = 'WEAK_SUPPORT' THEN 'no evidence' END AS reason, CASE WHEN verification = 'SUPPORTED' THEN strength ELSE physics END AS channel_score,
    CASE WHEN area_m2 > 250 THEN sqrt(area_m2) END AS length_m, CASE WHEN segment <> 'BUILDING' THEN 'no scale' END AS length_reason, CASE WHEN has_navigation THEN evidence END AS lat,
    CASE WHEN segment = 'MACHINERY' THEN 'NONE' WHEN segment = 'HOUSEHOLD' THEN 'DEMO_METADATA' ELSE 'MEASURED' END AS geo_provenance, CASE WHEN segment = 'FURNITURE' THEN 'detector,physics' ELSE '' END AS features,
    CASE WHEN anomaly > 0.5e0 THEN 'detector,anomaly' ELSE 'detector' END AS contributions, CASE WHEN category = 'SOMETHING_ELSE' THEN 'UNKNOWN' ELSE 'KNOWN' END AS kind,
    CASE WHEN category = 'SOMETHING_ELSE' OR change_status = 'MOVED' THEN 'UNKNOWN_ANOMALY_CANDIDATE' ELSE category END AS category, CASE WHEN artificiality > 0.3e0 THEN evidence END AS class_confidence,
    CASE WHEN change_status = 'NOT_DETECTED' THEN 'REMOVED' ELSE change_status END AS status, latest_verdict IS NOT NULL AS inside_new_coverage,
    coalesce(evidence, 0e0) * 0.5e0 + coalesce(persistence, 0e0) * 0.5e0 AS component_sum, (coalesce(evidence, 0e0) + coalesce(persistence, 0e0)) / 2 + CASE WHEN latest_verdict = 'REJECTED' THEN 0.1e0 ELSE 0e0 END AS score FROM v_contacts"""
_BROKEN = {**R.CONTRACT, "registered_features_only": "features <> '' AND len(list_filter(string_split(contributions, ','), lambda x: NOT list_contains(string_split(features, ','), x))) > 0"}


@register("P17_contract_rules", f"WITH r AS ({_RECORDS}) " + " UNION ALL ".join(f"SELECT '{name}' AS rule, contact_id FROM r WHERE {broken}" for name, broken in _BROKEN.items()))
def p17(v):
    """Each rule of the contract is a predicate of its violations; a row for each rule that a contact breaks."""
    return R.contract_violations(v["v_contacts"].sparkSession.sql(_RECORDS.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"]), "contact_id")


_QA_TILES = "SELECT tile_key, frame_id, CASE WHEN x0 = 0 THEN 512 - CAST(padded_right AS INT) % 256 ELSE 512 END AS tile_w, 512 AS tile_h, CASE WHEN y0 = 512 THEN 'val' ELSE split END AS split, x0 <> 4864 AS has_label FROM tiled"


@register(
    "A43_tile_errors",
    CLIP_SQL + f""", tiled AS (SELECT t.frame_id, x0, y0, greatest(0, x0 + 512 - t.width) AS padded_right, t.frame_id || '_x' || lpad(x0::VARCHAR, 5, '0') || '_y' || lpad(y0::VARCHAR, 5, '0') AS tile_key, split FROM t JOIN v_frames AS f ON t.frame_id = f.frame_id), q AS ({_QA_TILES}),
    bx AS (SELECT c.frame_id || '_x' || lpad(x0::VARCHAR, 5, '0') || '_y' || lpad(y0::VARCHAR, 5, '0') AS tile_key, gt_id AS box_id, cx AS x, cy AS y, cw + CASE WHEN cw > 200 THEN 300 ELSE 0 END AS w, ch AS h FROM c WHERE cw > 0 AND ch > 0 AND cw * ch / (bw * bh) >= 0.25)
    SELECT tile_key AS subject, 'TILE_DIMENSIONS_INVALID' AS error FROM q WHERE tile_w <> 512 UNION ALL SELECT tile_key, 'MISSING_LABEL_FILE' FROM q WHERE NOT has_label UNION ALL SELECT tile_key, 'SPLIT_INHERITANCE_VIOLATION' FROM q JOIN v_frames AS f ON q.frame_id = f.frame_id WHERE q.split <> f.split
    UNION ALL SELECT tile_key || ':' || box_id, 'INVALID_CLIPPED_BOX' FROM bx WHERE x + w > 512 OR y + h > 512""",
)
def a43_tiles(v):
    """Errors of tiles and of the boxes clipped to them; some tiles are cut short, unlabelled or of another split, some boxes too wide."""
    f = v["v_frames"]
    t = P.tile_grid(f.repartition("frame_id"), carry=("split",))  # frames are dealt out before they become tiles: tiles meet them where they are
    t = t.sparkSession.sql(_QA_TILES.replace("FROM tiled", "FROM {t}"), t=t)
    key = F.format_string("%s_x%05d_y%05d", F.col("frame_id").cast("string"), "x0", "y0")
    b = p09(v).select(key.alias("tile_key"), F.col("gt_id").alias("box_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("cw") + F.when(F.col("cw") > 200, 300).otherwise(0)).alias("w"), F.col("ch").alias("h"))
    return R.snapshot_errors(t, b, f)


#: Test frames as images of three datasets: tracks with channels, fragments, and augmented variants of parents.
_TESTED = """SELECT frame_id AS image_id, CASE WHEN dataset LIKE '1%' OR dataset LIKE '2%' THEN 'TRACKS' WHEN dataset LIKE '3%' THEN 'FRAGMENTS' ELSE 'VARIANTS' END AS dataset,
    CASE width WHEN 5000 THEN 'HF' WHEN 2500 THEN 'LF' END AS channel, split, group_key FROM v_frames WHERE split = 'test'"""
_POPULATIONS = f"""s AS ({_TESTED}), w AS (SELECT min(image_id) AS image_id FROM s WHERE dataset = 'VARIANTS' GROUP BY group_key),
    pop AS (SELECT image_id, 'TRACKS|ALL_TEST' AS population, 'PRIMARY' AS role FROM s WHERE dataset = 'TRACKS' UNION ALL SELECT image_id, 'TRACKS|' || channel, 'CHANNEL_BREAKDOWN' FROM s WHERE dataset = 'TRACKS' AND channel IS NOT NULL
    UNION ALL SELECT image_id, 'FRAGMENTS|FRAGMENT_LEVEL', 'PRIMARY' FROM s WHERE dataset = 'FRAGMENTS' UNION ALL SELECT image_id, 'VARIANTS|ONE_PER_PARENT', 'PRIMARY' FROM w UNION ALL SELECT image_id, 'VARIANTS|ALL_VARIANTS', 'SENSITIVITY' FROM s WHERE dataset = 'VARIANTS')"""


def _populations(v):
    t = v["v_frames"].sparkSession.sql(_TESTED.replace("FROM v_frames", "FROM {f}"), f=v["v_frames"])
    return R.evaluation_populations(t, t.filter("dataset = 'VARIANTS'").groupBy("group_key").agg(F.min("image_id").alias("image_id")))


@register("J20_evaluation_populations", f"WITH {_POPULATIONS} SELECT image_id, population, role FROM pop")
def j20(v):
    """The populations of each test image."""
    return _populations(v)


def _matched(tau: float, name: str) -> str:
    """The tables of MATCH for a threshold, under names of their own, up to ``name`` (frame_id, raw_class, tp)."""
    text = MATCH.format(iou=IOU_SQL.format(a="k.", b="d."), tau=tau)
    return text, f"{name} AS (SELECT {tau}::DOUBLE AS tau, frame_id, raw_class, count(*) AS tp FROM r WHERE gt_id IS NOT NULL GROUP BY frame_id, raw_class)"


_TEXT, _TP5 = _matched(0.5, "tp5")
_TEXT3 = _matched(0.3, "tp3")[0]
_R3 = _TEXT3[_TEXT3.index("r AS (") :].replace("r AS (", "r3 AS (", 1).replace("FROM r JOIN e ON e.frame_id = r.frame_id AND e.raw_class = r.raw_class AND e.rn = r.rn + 1", "FROM r3 AS r JOIN e ON e.frame_id = r.frame_id AND e.raw_class = r.raw_class AND e.rn = r.rn + 1")
_TP3 = "tp3 AS (SELECT 0.3::DOUBLE AS tau, frame_id, raw_class, count(*) AS tp FROM r3 WHERE gt_id IS NOT NULL GROUP BY frame_id, raw_class)"


@register(
    "A16_metrics_by_population",
    f"""WITH {_TEXT}, {_R3}, {_TP5}, {_TP3}, tps AS (SELECT * FROM tp5 UNION ALL SELECT * FROM tp3), dd AS (SELECT frame_id, raw_class, count(*) AS n FROM v_det GROUP BY ALL), gg AS (SELECT frame_id, gt_class AS raw_class, count(*) AS n FROM v_gt GROUP BY ALL),
    b AS (SELECT frame_id, raw_class, coalesce(dd.n, 0) AS detections, coalesce(gg.n, 0) AS gt FROM dd FULL JOIN gg USING (frame_id, raw_class)), c AS (SELECT b.frame_id AS image_id, x.tau, b.raw_class, coalesce(t.tp, 0) AS tp, detections, gt FROM b CROSS JOIN (VALUES (0.5::DOUBLE), (0.3::DOUBLE)) AS x(tau) LEFT JOIN tps AS t ON t.tau = x.tau AND t.frame_id = b.frame_id AND t.raw_class = b.raw_class),
    {_POPULATIONS}, a AS (SELECT population, tau, raw_class, sum(tp)::BIGINT AS tp, sum(detections)::BIGINT AS detections, sum(gt)::BIGINT AS gt FROM pop JOIN c USING (image_id) GROUP BY population, tau, raw_class)
    SELECT *, detections - tp AS fp, gt - tp AS fn, round(tp * 1e0 / nullif(detections, 0), 9) AS precision, round(tp * 1e0 / nullif(gt, 0), 9) AS recall, detections >= 30 AS precision_for_claims, gt >= 30 AS recall_for_claims FROM a""",
    recursive=True,
)
def a16_populations(v):
    """Precision and recall by population, overlap threshold and class."""
    d = v["v_det"].groupBy("frame_id", "raw_class").agg(F.count("*").alias("detections"))
    g = v["v_gt"].groupBy("frame_id", F.col("gt_class").alias("raw_class")).agg(F.count("*").alias("gt"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = d.join(g, ["frame_id", "raw_class"], "full").select("frame_id", "raw_class", z("detections"), z("gt"))
    hits = [S.match_detections(v["v_det"], v["v_gt"], tau).groupBy("frame_id", "raw_class").agg(F.count("*").alias("tp")).withColumn("tau", F.lit(tau)) for tau in (0.5, 0.3)]
    counts = both.withColumn("tau", F.explode(F.array(F.lit(0.5), F.lit(0.3)))).join(hits[0].unionByName(hits[1]), ["frame_id", "raw_class", "tau"], "left")
    return R.population_metrics(_populations(v), counts.select(F.col("frame_id").alias("image_id"), "tau", "raw_class", z("tp"), "detections", "gt"))


@register(
    "G14_splits_without_official",
    """WITH g AS (SELECT DISTINCT group_key FROM v_frames), r AS (SELECT *, row_number() OVER (ORDER BY sha256('20260830:' || group_key), group_key) AS i, count(*) OVER () AS n FROM g)
    SELECT group_key, CASE WHEN i <= round_even(n * 0.70e0, 0) THEN 'train' WHEN i <= round_even(n * 0.70e0, 0) + round_even(n * 0.15e0, 0) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def g14_unofficial(v):
    """No hints and no official test groups: about 70, 15 and 15 of a hundred groups."""
    none = F.lit(None).cast("string")
    return R.make_splits(v["v_frames"].select("group_key", none.alias("hint"), none.alias("official")))


_LEVELS = "SELECT survey_id, CAST(substr(survey_id, 2) AS BIGINT) AS number, CASE WHEN count(*) FILTER (WHERE has_navigation) * 2 > count(*) THEN 'L2_TRACK_RELATIVE' WHEN count(*) FILTER (WHERE has_navigation) > 0 THEN 'L1_FRAME_RELATIVE' ELSE 'L0_PIXEL_ONLY' END AS level, count(area_m2) * 12 >= count(*) * 11 AS coverage FROM v_contacts GROUP BY survey_id"


@register(
    "P30_comparison_gates",
    f"""WITH s AS ({_LEVELS}), p AS (SELECT n.survey_id AS new_id, 's' || (n.number - 1) AS baseline_id, n.level AS nl, n.coverage AS nc, b.survey_id IS NOT NULL AS known, b.level AS bl, b.coverage AS bc FROM s AS n LEFT JOIN s AS b ON b.survey_id = 's' || (n.number - 1)),
    x AS (SELECT new_id, baseline_id, 'BASELINE_SURVEY' AS gate, 'baseline' AS label FROM p WHERE NOT known UNION ALL SELECT new_id, baseline_id, 'SPATIAL_REFERENCE_LEVEL', 'new' FROM p WHERE nl NOT LIKE 'L2%' UNION ALL SELECT new_id, baseline_id, 'COVERAGE_POLYGON', 'new' FROM p WHERE NOT nc
      UNION ALL SELECT new_id, baseline_id, 'SPATIAL_REFERENCE_LEVEL', 'baseline' FROM p WHERE known AND bl NOT LIKE 'L2%' UNION ALL SELECT new_id, baseline_id, 'COVERAGE_POLYGON', 'baseline' FROM p WHERE known AND NOT bc)
    SELECT p.new_id, p.baseline_id, x.gate, x.label, x.gate IS NULL AS supported FROM p LEFT JOIN x ON p.new_id = x.new_id""",
)
def p30(v):
    """What blocks the comparison of each survey with the one before."""
    c = v["v_contacts"]
    s = c.sparkSession.sql(_LEVELS.replace("FROM v_contacts", "FROM {c}"), c=c)
    return R.comparison_gates(s, s.select(F.col("survey_id").alias("new_id"), F.concat(F.lit("s"), (F.col("number") - 1).cast("string")).alias("baseline_id")))


@register(
    "W08_role_orders",
    """WITH f AS (SELECT frame_id, row_number() OVER (ORDER BY ts, survey_ref, frame_id) AS track FROM v_nav WHERE latitude IS NOT NULL),
    c AS (SELECT contact_id, CASE WHEN evidence >= 0.75 THEN 0 WHEN evidence >= 0.5 THEN 1 WHEN evidence IS NOT NULL THEN 2 ELSE 3 END AS p, CASE WHEN latest_verdict IS NOT NULL THEN 1 ELSE 0 END AS r, coalesce(track, 1::BIGINT << 53) AS t FROM v_contacts LEFT JOIN f ON frame_id = CAST(substr(contact_id, 2) AS BIGINT) * 7)
    SELECT 'analyst' AS role, contact_id, row_number() OVER (ORDER BY r, p, contact_id) AS place FROM c UNION ALL SELECT 'supervisor', contact_id, row_number() OVER (ORDER BY p, -r, contact_id) FROM c UNION ALL SELECT 'field_officer', contact_id, row_number() OVER (ORDER BY t, contact_id) FROM c""",
)
def w08_roles(v):
    """All contacts in the order of each role."""
    fixes = ordered.numbered(v["v_nav"].filter("latitude is not null").select("frame_id", "ts", "survey_ref"), ["ts", "survey_ref", "frame_id"], "track").select("frame_id", "track")
    rank = F.when(F.col("evidence") >= 0.75, 0).when(F.col("evidence") >= 0.5, 1).when(F.col("evidence").isNotNull(), 2).otherwise(3)
    c = v["v_contacts"].select("contact_id", rank.alias("priority_rank"), F.col("latest_verdict").isNotNull().alias("reviewed"), (F.substring("contact_id", 2, 20).cast("bigint") * 7).alias("frame_id"))
    return R.role_orders(c.join(fixes, "frame_id", "left"))


@register(
    "W11_smallest_components",
    "WITH s AS (SELECT frame_id, (x2 - x1) * (y2 - y1) AS area, detection_id FROM v_det ORDER BY area, frame_id, detection_id LIMIT 30), d AS (SELECT frame_id, min((area, frame_id, detection_id)) AS first FROM s GROUP BY frame_id) SELECT frame_id, row_number() OVER (ORDER BY first) AS place, round(first[1], 6) AS area FROM d",
)
def w11_smallest(v):
    """The images of the 30 smallest components, each once, in their order. The limit is the feature."""
    area = F.expr("(x2 - x1) * (y2 - y1)")
    s = v["v_det"].select("frame_id", area.alias("area"), "detection_id").orderBy("area", "frame_id", "detection_id").limit(30)
    d = s.groupBy("frame_id").agg(F.min(F.struct("area", "frame_id", "detection_id")).alias("first"))
    return ordered.numbered(d, ["first"], "place").select("frame_id", "place", F.round("first.area", 6).alias("area"))


@register("A12_verdict_histogram", "SELECT survey_id, coalesce(latest_verdict, 'NONE') AS verdict, count(*) AS contacts FROM v_contacts GROUP BY ALL")
def a12_histogram(v):
    return v["v_contacts"].groupBy("survey_id", F.coalesce("latest_verdict", F.lit("NONE")).alias("verdict")).agg(F.count("*").alias("contacts"))


@register(
    "U02_shared_ping_rows",
    f"""WITH p AS ({PING_FRAMES}), r AS (SELECT DISTINCT frame_id, md5(e.embedding::VARCHAR) AS digest FROM p JOIN embeddings AS e ON p.vec_id = e.vec_id),
    n AS (SELECT lag(frame_id) OVER (PARTITION BY frame_id // 4 % 2 ORDER BY frame_id) AS a_id, frame_id AS b_id FROM (SELECT DISTINCT frame_id FROM p) AS x),
    m AS (SELECT a.frame_id AS a_id, b.frame_id AS b_id, count(*) AS shared FROM r AS a JOIN r AS b ON a.digest = b.digest AND a.frame_id < b.frame_id GROUP BY a.frame_id, b.frame_id)
    SELECT coalesce(n.a_id, m.a_id) AS a_id, coalesce(n.b_id, m.b_id) AS b_id, coalesce(shared, 0) AS shared FROM (SELECT * FROM n WHERE a_id IS NOT NULL) AS n FULL JOIN m ON n.a_id = m.a_id AND n.b_id = m.b_id""",
)
def u02(v):
    """Rows that two frames share: all pairs that share any, and neighbouring frames of a channel that share none."""
    rows = ping_rows(v)
    f = rows.select("frame_id").distinct().withColumn("channel", F.expr("frame_id div 4 % 2"))
    pairs = ordered.with_previous(ordered.laid_out(f, ["channel"], ["frame_id"]), ["channel"], ["frame_id"]).filter("prev_frame_id is not null")
    near = pairs.select(F.col("prev_frame_id").alias("a_id"), F.col("frame_id").alias("b_id"))
    return near.join(R.sharing_frames(rows), ["a_id", "b_id"], "full").select("a_id", "b_id", F.coalesce("shared", F.lit(0)).alias("shared"))


def _written(v):
    """The images of v_imgs as PNG files: grey, colour, and cut off in the middle."""
    i = v["v_imgs"]
    g = i.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "sample"))).alias("px"), (F.max("col_idx") + 1).alias("width"), (F.max("row_idx") + 1).cast("int").alias("height"))
    grey = F.transform("px", lambda p: p["sample"])
    colour = F.flatten(F.transform("px", lambda p: F.array(p["sample"], 255 - p["sample"], F.floor(p["sample"] / 2).cast("int"))))
    kind = F.col("image_id") % 3
    rows = g.select(F.format_string("img_%05d.png", "image_id").alias("name"), "width", "height", F.when(kind == 1, 3).otherwise(1).alias("channels"), F.when(kind == 1, colour).otherwise(grey).alias("samples"), (kind == 2).alias("damaged"))
    path = scratch(i.sparkSession)
    files.write_rasters(rows, path)
    return path


@register("S01_scan_rasters", "SELECT 'img_' || lpad(image_id::VARCHAR, 5, '0') || '.png' AS name, CASE WHEN image_id % 3 <> 2 THEN 64 END AS width, CASE WHEN image_id % 3 <> 2 THEN max(row_idx) + 1 END AS height, CASE image_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 END AS channels, image_id % 3 <> 2 AS identified FROM v_imgs GROUP BY image_id")
def s01(v):
    """Raster files written and scanned; those that cannot be read stay, without an identity."""
    r = files.scan_rasters(v.spark, _written(v))
    return r.select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", "channels", F.col("identity").isNotNull().alias("identified"))


@register("S02_explode_ping_rows", "SELECT 'img_' || lpad(image_id::VARCHAR, 5, '0') || '.png' AS frame, row_idx, string_agg(CASE WHEN image_id % 3 = 1 THEN sample // 2 ELSE sample END, ',' ORDER BY col_idx) AS samples FROM v_imgs WHERE image_id % 3 <> 2 GROUP BY image_id, row_idx")
def s02(v):
    """The rows of the files that can be read, by their first channel."""
    return files.explode_ping_rows(v.spark, _written(v)).select("frame", "row_idx", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))
