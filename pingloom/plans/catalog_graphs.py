"""Queries of order-dependent operators."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import scalar as P
from ..operators import sequential as S
from ..operators.contacts import look_persistence
from .catalog_boxes import IOU_SQL
from .catalog_joins import PING_FRAMES, j11, ping_rows
from .registry import register

_IOU_K = IOU_SQL.format(a="k.", b="b.")
NMS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, raw_class ORDER BY raw_confidence DESC, detection_id) AS rn FROM v_det),
n AS (SELECT frame_id, raw_class, 1::BIGINT AS rn, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept, true AS stays, detection_id FROM r WHERE rn = 1
  UNION ALL SELECT b.frame_id, b.raw_class, b.rn, CASE WHEN len(list_filter(n.kept, lambda k: {_IOU_K} > 0.45)) > 0 THEN n.kept ELSE list_append(n.kept, {{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) END,
  len(list_filter(n.kept, lambda k: {_IOU_K} > 0.45)) = 0, b.detection_id FROM n JOIN r AS b ON b.frame_id = n.frame_id AND b.raw_class = n.raw_class AND b.rn = n.rn + 1)"""


@register("G01_class_aware_nms", f"WITH {NMS} SELECT n.frame_id, n.raw_class, n.detection_id, r.raw_confidence, r.x1, r.y1, r.x2, r.y2 FROM n JOIN r ON n.detection_id = r.detection_id WHERE stays", recursive=True)
def g01(v):
    return S.class_aware_nms(v["v_det"])


@register("W01_number_detections", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY raw_confidence DESC, x1, y1, detection_id) AS number FROM v_det) SELECT detection_id, number, frame_id || '_' || lpad(number::VARCHAR, 4, '0') AS numbered_id FROM n")
def w01(v):
    return S.number_detections(v["v_det"]).select("detection_id", "number", "numbered_id")


def relation_sql(a: str, b: str) -> str:
    iou = "(CASE WHEN least({a}nx2, {b}nx2) - greatest({a}nx1, {b}nx1) <= 0 OR least({a}ny2, {b}ny2) - greatest({a}ny1, {b}ny1) <= 0 THEN 0e0 ELSE (least({a}nx2, {b}nx2) - greatest({a}nx1, {b}nx1)) * (least({a}ny2, {b}ny2) - greatest({a}ny1, {b}ny1)) / (({a}nx2 - {a}nx1) * ({a}ny2 - {a}ny1) + ({b}nx2 - {b}nx1) * ({b}ny2 - {b}ny1) - (least({a}nx2, {b}nx2) - greatest({a}nx1, {b}nx1)) * (least({a}ny2, {b}ny2) - greatest({a}ny1, {b}ny1))) END)"
    centre = "(({b}nx1 + {b}nx2) / 2 BETWEEN {a}nx1 AND {a}nx2 AND ({b}ny1 + {b}ny2) / 2 BETWEEN {a}ny1 AND {a}ny2)"
    return (
        "CASE WHEN {a}raw_class = {b}raw_class THEN CASE WHEN {a}frame_id = {b}frame_id THEN CASE WHEN {a}inference_mode = 'TILED' AND {b}inference_mode = 'TILED' AND {a}tile_id <> {b}tile_id AND (" + iou + " >= 0.30 OR " + centre + " OR " + centre.replace("{a}", "{x}").replace("{b}", "{a}").replace("{x}", "{b}") + ") THEN 'TILE_OVERLAP_DUPLICATE' END "
        "WHEN {a}ping_start IS NOT NULL AND {b}ping_start IS NOT NULL AND {a}survey_ref = {b}survey_ref THEN CASE WHEN greatest({a}ping_start, {b}ping_start) - least({a}ping_end, {b}ping_end) <= 0 THEN "
        "CASE WHEN least({a}x2, {b}x2) - greatest({a}x1, {b}x1) > 0 AND least({a}ping_start + {a}y2, {b}ping_start + {b}y2) - greatest({a}ping_start + {a}y1, {b}ping_start + {b}y1) > 0 THEN 'SAME_LOOK_OVERLAPPING_WINDOWS' END "
        "WHEN greatest({a}ping_start, {b}ping_start) - least({a}ping_end, {b}ping_end) = 1 AND {a}raw_class = 'PIPELINE' AND abs(({a}x1 + {a}x2) / 2 - ({b}x1 + {b}x2) / 2) <= greatest(0.25e0 * least({a}x2 - {a}x1, {b}x2 - {b}x1), 20e0) THEN 'INDEPENDENT_LOOKS_ALONG_TRACK' END END END"
    ).format(a=a, b=b)


@register("G03_association_relation", f"SELECT * FROM (SELECT a.detection_id AS a_id, b.detection_id AS b_id, {relation_sql('a.', 'b.')} AS relation FROM v_obs AS a JOIN v_obs AS b ON a.survey_ref = b.survey_ref AND a.raw_class = b.raw_class AND abs(a.frame_id - b.frame_id) <= 2 AND a.detection_id < b.detection_id) AS p WHERE relation IS NOT NULL")
def g03(v):
    return S.related_pairs(v["v_blocks"], 2, "block")  # related windows lie at most two frames apart here


FUSE = f"""k AS (SELECT *, concat_ws('|', raw_class, CASE WHEN ping_start IS NOT NULL THEN survey_ref ELSE 'f' || frame_id END) AS key FROM v_obs),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN ping_start IS NOT NULL THEN 0 ELSE 1 END, coalesce(ping_start, 0), frame_id, detection_id) AS rn FROM k),
f AS (SELECT key, rn, [o] AS last, 1::BIGINT AS contact_no, detection_id FROM o WHERE rn = 1
  UNION ALL SELECT key, rn, CASE WHEN hit > 0 THEN list_concat(list_append(last[1:hit - 1], cur), last[hit + 1:]) ELSE list_append(last, cur) END, CASE WHEN hit > 0 THEN hit ELSE len(last) + 1 END, detection_id
  FROM (SELECT b.key, b.rn, f.last, b AS cur, b.detection_id, coalesce(list_position(list_transform(f.last, lambda a: ({relation_sql('a.', 'b.')}) IS NOT NULL), true), 0) AS hit FROM f JOIN o AS b ON b.key = f.key AND b.rn = f.rn + 1) AS s)"""


@register("G04_fuse_contacts", f"WITH {FUSE} SELECT detection_id, key, contact_no, rn - 1 AS member_no FROM f", recursive=True)
def g04(v):
    return S.fuse_contacts(v["v_blocks"], "block").select("detection_id", "key", "contact_no", "member_no")


@register(
    "A01_contact_rollup",
    f"""WITH {FUSE}, m AS (SELECT f.key, f.contact_no, f.rn, o.* EXCLUDE (key, rn) FROM f JOIN o ON f.detection_id = o.detection_id)
    SELECT key, contact_no, count(*) AS observation_count, count(DISTINCT frame_id) AS frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame, min(ping_start) AS first_ping, max(ping_end) AS last_ping,
    arg_min(detection_id, (-raw_confidence, rn)) AS best_observation_id, max(raw_confidence) AS max_confidence, round(avg(raw_confidence), 9) AS mean_confidence,
    CASE WHEN count(*) > 1 THEN round(greatest(0e0, 1 - (stddev_pop((nx1 + nx2) / 2) + stddev_pop((ny1 + ny2) / 2)) / 2 / 0.12e0), 9) END AS position_stability, max(frame_id) - min(frame_id) + 1 AS span,
    substr(sha256(string_agg(detection_id, '|' ORDER BY rn)), 1, 12) AS contact_hash FROM m GROUP BY key, contact_no""",
    recursive=True,
)
def a01(v):
    m = S.fuse_contacts(v["v_blocks"], "block")
    spread = (F.stddev_pop((F.col("nx1") + F.col("nx2")) / 2) + F.stddev_pop((F.col("ny1") + F.col("ny2")) / 2)) / 2
    return m.groupBy("block", "key", "contact_no").agg(
        F.count("*").alias("observation_count"), F.countDistinct("frame_id").alias("frames"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.min("ping_start").alias("first_ping"), F.max("ping_end").alias("last_ping"),
        F.min_by("detection_id", F.struct((-F.col("raw_confidence")).alias("c"), "member_no")).alias("best_observation_id"), F.max("raw_confidence").alias("max_confidence"), F.round(F.avg("raw_confidence"), 9).alias("mean_confidence"),
        F.when(F.count("*") > 1, F.round(F.greatest(F.lit(0.0), 1 - spread / 0.12), 9)).alias("position_stability"), (F.max("frame_id") - F.min("frame_id") + 1).alias("span"),
        F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_no", "detection_id"))), lambda x: x["detection_id"]), "|"), 256), 1, 12).alias("contact_hash"),
    ).drop("block")


LOOKS = f"""{FUSE}, m AS (SELECT f.key, f.contact_no, f.rn, o.* EXCLUDE (key, rn) FROM f JOIN o ON f.detection_id = o.detection_id),
l AS (SELECT b.key, b.contact_no, b.rn, b.ping_start, b.ping_end, {relation_sql('a.', 'b.')} AS rel FROM m AS b LEFT JOIN m AS a ON a.detection_id = b.prev)"""
LOOKS = LOOKS.replace("m AS (SELECT f.key", "m AS (SELECT lag(f.detection_id) OVER (PARTITION BY f.key, f.contact_no ORDER BY f.rn) AS prev, f.key")


@register(
    "A02_look_persistence",
    f"""WITH {LOOKS}, w AS (SELECT *, CASE WHEN lag(ping_end) OVER q + 1 = ping_start THEN 0 ELSE 1 END AS cut FROM (SELECT l.*, m.detection_id FROM l JOIN m USING (key, contact_no, rn)) AS y WINDOW q AS (PARTITION BY key, contact_no ORDER BY ping_start, detection_id)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY key, contact_no ORDER BY ping_start, detection_id ROWS UNBOUNDED PRECEDING) AS island FROM w), j AS (SELECT *, max(island) OVER (PARTITION BY key, contact_no) AS last_island FROM i),
    c AS (SELECT key, contact_no, count(*) AS n, 1 + count(*) FILTER (WHERE rel = 'INDEPENDENT_LOOKS_ALONG_TRACK') AS looks, count(*) FILTER (WHERE rel IS NOT NULL AND rel <> 'TILE_OVERLAP_DUPLICATE') AS other, bool_and(ping_start IS NOT NULL) AS placed, CASE WHEN bool_and(ping_start IS NOT NULL) THEN count(*) FILTER (WHERE island = last_island) ELSE 1 END AS consecutive FROM j GROUP BY key, contact_no)
    SELECT key, contact_no, looks, n - looks AS window_duplicates, CASE WHEN n = 1 THEN 'SINGLE' WHEN looks > 1 THEN 'INDEPENDENT_LOOKS_ALONG_TRACK' WHEN other = 0 THEN 'TILE_OVERLAP_DUPLICATE' ELSE 'SAME_LOOK_OVERLAPPING_WINDOWS' END AS basis,
    CASE WHEN looks > 1 AND placed THEN 'SEQUENTIAL_PING' WHEN n > looks THEN 'WINDOW_OVERLAP_ONLY' WHEN looks > 1 THEN 'UNKNOWN' ELSE 'SINGLE_OBSERVATION' END AS evidence_type, consecutive,
    round(CASE WHEN looks > 1 AND placed THEN least(1e0, 0.35e0 + 0.13e0 * looks + 0.25e0 * consecutive / looks) ELSE 0.15e0 END, 9) AS score FROM c""",
    recursive=True,
)
def a02(v):
    return look_persistence(_with_relations(v)).withColumn("score", F.round("score", 9))


def _with_relations(v):
    """Members of contacts with their relation to the member before."""
    m = S.fuse_contacts(v["v_blocks"], "block")
    w = W.partitionBy("block", "key", "contact_no").orderBy("member_no")
    m = m.select("block", "key", "contact_no", "member_no", *[F.lag(c).over(w).alias(f"p_{c}") for c in S.OBSERVATION], *[F.col(c).alias(f"q_{c}") for c in S.OBSERVATION])
    return m.withColumn("rel", S.relation("p_", "q_"))


@register(
    "G10_look_groups",
    f"WITH {LOOKS} SELECT key, contact_no, rn - 1 AS member_no, 1 + count(*) FILTER (WHERE rel = 'INDEPENDENT_LOOKS_ALONG_TRACK') OVER (PARTITION BY key, contact_no ORDER BY rn) AS look_no FROM l",
    recursive=True,
)
def g10(v):
    w = W.partitionBy("block", "key", "contact_no").orderBy("member_no").rowsBetween(W.unboundedPreceding, 0)
    return _with_relations(v).select("key", "contact_no", "member_no", (1 + F.sum((F.coalesce("rel", F.lit("")) == "INDEPENDENT_LOOKS_ALONG_TRACK").cast("int")).over(w)).alias("look_no"))


MATCH = """d AS (SELECT frame_id, raw_class, detection_id, x1, y1, x2, y2, row_number() OVER (PARTITION BY frame_id, raw_class ORDER BY raw_confidence DESC, x1, y1, x2, y2, detection_id) AS rn FROM v_det),
g AS (SELECT frame_id, gt_class AS raw_class, list({{'x1': gx1, 'y1': gy1, 'x2': gx2, 'y2': gy2, 'id': gt_id}} ORDER BY gx1, gy1, gx2, gy2, gt_id) AS gs FROM v_gt GROUP BY frame_id, gt_class),
e AS (SELECT d.*, list_transform(gs, lambda k: {{'v': {iou}, 'id': k.id}}) AS cand FROM d JOIN g ON d.frame_id = g.frame_id AND d.raw_class = g.raw_class),
r AS (SELECT frame_id, raw_class, 0::BIGINT AS rn, []::VARCHAR[] AS used, NULL::VARCHAR AS detection_id, NULL::VARCHAR AS gt_id FROM g
  UNION ALL SELECT frame_id, raw_class, rn, CASE WHEN len(ok) > 0 THEN list_append(used, best) ELSE used END, detection_id, CASE WHEN len(ok) > 0 THEN best END FROM (
    SELECT *, list_filter(ok, lambda t: t.v = list_max(list_transform(ok, lambda z: z.v)))[1].id AS best FROM (
      SELECT e.frame_id, e.raw_class, e.rn, r.used, e.detection_id, list_filter(e.cand, lambda t: t.v >= {tau} AND NOT list_contains(r.used, t.id)) AS ok FROM r JOIN e ON e.frame_id = r.frame_id AND e.raw_class = r.raw_class AND e.rn = r.rn + 1) AS s1) AS s2)"""


def _match(tau: float) -> str:
    return MATCH.format(iou=_IOU_K.replace("b.", "d."), tau=tau)


@register("G05_match_detections", f"WITH {_match(0.5)} SELECT frame_id, raw_class, detection_id, gt_id FROM r WHERE gt_id IS NOT NULL", recursive=True)
def g05(v):
    return S.match_detections(v["v_det"], v["v_gt"], 0.5)


def _population(v, tau):
    tp = S.match_detections(v["v_det"], v["v_gt"], tau).groupBy("raw_class").agg(F.count("*").alias("tp"))
    d = v["v_det"].groupBy("raw_class").agg(F.count("*").alias("detections"))
    g = v["v_gt"].groupBy(F.col("gt_class").alias("raw_class")).agg(F.count("*").alias("gt"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = d.join(g, "raw_class", "full").join(tp, "raw_class", "left").select("raw_class", z("tp").alias("tp"), z("detections").alias("detections"), z("gt").alias("gt"))
    return out.withColumns({"fp": F.expr("detections - tp"), "fn": F.expr("gt - tp"), "precision": F.round(F.expr("try_divide(tp, detections)"), 9), "recall": F.round(F.expr("try_divide(tp, gt)"), 9), "for_claims": F.expr("gt >= 30")})


@register(
    "A16_population_metrics",
    f"""WITH {_match(0.3)}, t AS (SELECT raw_class, count(*) AS tp FROM r WHERE gt_id IS NOT NULL GROUP BY raw_class), dd AS (SELECT raw_class, count(*) AS detections FROM v_det GROUP BY raw_class), gg AS (SELECT gt_class AS raw_class, count(*) AS gt FROM v_gt GROUP BY gt_class)
    SELECT coalesce(dd.raw_class, gg.raw_class) AS raw_class, coalesce(tp, 0) AS tp, coalesce(detections, 0) AS detections, coalesce(gt, 0) AS gt, coalesce(detections, 0) - coalesce(tp, 0) AS fp, coalesce(gt, 0) - coalesce(tp, 0) AS fn,
    round(coalesce(tp, 0) * 1e0 / nullif(detections, 0), 9) AS precision, round(coalesce(tp, 0) * 1e0 / nullif(gt, 0), 9) AS recall, coalesce(gt, 0) >= 30 AS for_claims FROM dd FULL JOIN gg ON dd.raw_class = gg.raw_class LEFT JOIN t ON t.raw_class = coalesce(dd.raw_class, gg.raw_class)""",
    recursive=True,
)
def a16(v):
    return _population(v, 0.3)


@register(
    "G07_ping_disjoint_lattice",
    """WITH o AS (SELECT survey_ref, frame_id, epoch_us(ts) AS t FROM v_nav),
    l AS (SELECT survey_ref, min((t, frame_id)) AS x FROM o GROUP BY survey_ref UNION ALL SELECT survey_ref, x FROM (SELECT l.survey_ref, (SELECT min((o.t, o.frame_id)) FROM o WHERE o.survey_ref = l.survey_ref AND o.t - l.x[1] >= 100000000000) AS x FROM l) AS s WHERE x IS NOT NULL)
    SELECT survey_ref, x[2] AS frame_id FROM l""",
    recursive=True,
)
def g07(v):
    return S.disjoint_lattice(v["v_nav"], "survey_ref", 100_000.0)


#: Frames of the ping blocks as frames of two channels; some have another width, and a split goes through blocks whole.
_CHANNELS = f"""WITH p AS ({PING_FRAMES}), r AS (SELECT frame_id, height, row_idx, md5(e.embedding::VARCHAR) AS digest FROM p JOIN embeddings AS e ON p.vec_id = e.vec_id),
    m AS (SELECT a.frame_id AS later, b.frame_id AS earlier, a.row_idx - b.row_idx AS k, a.height FROM r AS a JOIN r AS b ON a.digest = b.digest AND a.frame_id <> b.frame_id AND a.row_idx >= b.row_idx),
    f AS (SELECT later, earlier, k FROM m GROUP BY later, earlier, k, height HAVING count(*) = height - k AND k <= height * 0.5),
    g AS (SELECT *, count(*) OVER (PARTITION BY least(later, earlier), greatest(later, earlier)) AS n FROM f), v AS (SELECT later, earlier FROM g WHERE n = 1 AND k >= 1),
    c AS (SELECT DISTINCT frame_id, 'ch' || (frame_id // 4 % 2) AS channel, frame_id % 4 * 20 + frame_id // 8 * 1000 AS ts, CASE WHEN frame_id % 16 = 2 THEN 63 ELSE 64 END AS width FROM p)"""


@register(
    "G09_time_adjacent_chains",
    _CHANNELS + """, o AS (SELECT *, lag(frame_id) OVER w AS before, lag(width) OVER w AS width_before FROM c WINDOW w AS (PARTITION BY channel ORDER BY ts, frame_id)),
    l AS (SELECT *, before IS NOT NULL AND width = width_before AND EXISTS (SELECT 1 FROM v WHERE least(later, earlier) = least(frame_id, before) AND greatest(later, earlier) = greatest(frame_id, before)) AS linked FROM o),
    h AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY channel ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS chain FROM l)
    SELECT frame_id, channel, chain, min(ts) OVER (PARTITION BY channel, chain) AS start FROM h""",
)
def g09(v):
    """Chains of frames whose shift of rows is verified, by channel in the order of time."""
    rows = ping_rows(v)
    f = rows.select("frame_id").distinct()
    f = f.select("frame_id", F.concat(F.lit("ch"), F.expr("cast(frame_id div 4 % 2 as string)")).alias("channel"), F.expr("frame_id % 4 * 20 + frame_id div 8 * 1000").alias("ts"), F.expr("CASE WHEN frame_id % 16 = 2 THEN 63 ELSE 64 END").alias("width"), F.lit(40).alias("height"), F.expr("element_at(array('train', 'val', 'test'), cast(frame_id div 4 % 3 + 1 as int))").alias("split"))
    return S.verified_chains(f, j11(v))


@register(
    "G13_assign_groups",
    """WITH g AS (SELECT group_key, count(*) AS n FROM v_frames GROUP BY group_key), t AS (SELECT sum(n)::DOUBLE AS total FROM g),
    o AS (SELECT *, row_number() OVER (ORDER BY sha256('20260831:' || group_key), group_key) AS rn FROM g),
    r AS (SELECT 0::BIGINT AS rn, 0e0 AS a, 0e0 AS b, 0e0 AS c, NULL::BIGINT AS group_key, NULL::DOUBLE AS n, NULL::VARCHAR AS split
      UNION ALL SELECT rn, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'val' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END, group_key, n, s FROM
      (SELECT o.rn, a, b, c, o.group_key, o.n::DOUBLE AS n, (list_sort([(a / greatest(total * 0.70e0, 1), a, 'train'), (b / greatest(total * 0.15e0, 1), b, 'val'), (c / greatest(total * 0.15e0, 1), c, 'test')])[1])[3] AS s FROM r JOIN o ON o.rn = r.rn + 1, t) AS q)
    SELECT group_key, n, split FROM r WHERE rn > 0""",
    recursive=True,
)
def g13(v):
    return S.assign_groups(v["v_frames"].groupBy("group_key").agg(F.count("*").alias("n")))


@register(
    "flagship_contact_triage",
    f"""WITH {NMS}, kept AS (SELECT r.* FROM n JOIN r ON n.detection_id = r.detection_id WHERE stays),
    c AS (SELECT frame_id, raw_class, count(*) AS observations, max(raw_confidence) AS detector, CASE WHEN count(*) > 1 THEN least(1e0, 0.35e0 + 0.13e0 * count(DISTINCT tile_id)) ELSE 0.15e0 END AS persistence FROM kept GROUP BY frame_id, raw_class),
    e AS (SELECT *, (detector * 0.30e0 + persistence * 0.25e0) / 0.55e0 AS evidence FROM c), p AS (SELECT *, (evidence + persistence) / 2 AS priority FROM e)
    SELECT frame_id, raw_class, observations, round(evidence, 9) AS evidence_score, round(priority, 9) AS priority_score, CASE WHEN priority >= 0.75 THEN 'HIGH' WHEN priority >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority_band FROM p""",
    recursive=True,
)
def flagship(v):
    """Which contacts need action first? Suppression, rollup, evidence, priority."""
    kept = S.class_aware_nms(v["v_det"].select("detection_id", "frame_id", "raw_class", "raw_confidence", "x1", "y1", "x2", "y2", "tile_id"), carry=("tile_id",))
    c = kept.groupBy("frame_id", "raw_class").agg(F.count("*").alias("observations"), F.max("raw_confidence").alias("confidence"), F.when(F.count("*") > 1, F.least(F.lit(1.0), 0.35 + 0.13 * F.countDistinct("tile_id"))).otherwise(0.15).alias("persistence"))
    none = F.lit(None).cast("double")
    c = P.evidence_score(c.withColumns({k: none for k in ("physics", "quality", "anomaly", "artificiality")} | {"verification": F.lit(None).cast("string")}))
    p = P.contact_priority(c.withColumn("evidence", F.col("evidence_score")).withColumns({"has_navigation": F.lit(False), "latest_verdict": F.lit(None).cast("string")}))
    return p.select("frame_id", "raw_class", "observations", F.round("evidence_score", 9).alias("evidence_score"), F.round("priority_score", 9).alias("priority_score"), "priority_band").orderBy(F.col("priority_score").desc(), "frame_id", "raw_class")
