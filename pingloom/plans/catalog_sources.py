"""Queries of sources, sinks, contract rules and report shapes."""

from pyspark.sql import functions as F

from ..functions.storage import scratch, stored
from ..operators import ordered
from ..sources import navigation as N
from .fixtures import digest_sql
from .registry import register

NAV_TEXT = """SELECT event_id + 2 AS row, CASE WHEN event_id % 101 = 0 THEN ' ' WHEN event_id % 103 = 5 THEN concat('f', event_id - 1) ELSE concat('f', event_id) END AS frame,
CASE WHEN event_id % 97 = 0 THEN 'not a time' WHEN event_id % 13 = 0 THEN '' ELSE '2024-01-02T03:04:05Z' END AS timestamp_utc,
CASE WHEN event_id % 89 = 0 THEN '91.5' WHEN event_id % 83 = 0 THEN 'x' WHEN event_id % 79 = 0 THEN NULL ELSE CAST(event_id % 90 AS VARCHAR(9)) END AS latitude, CASE WHEN event_id % 73 = 0 THEN '-180.5' ELSE CAST(event_id % 180 AS VARCHAR(9)) END AS longitude,
CASE WHEN event_id % 71 = 0 THEN 'north' WHEN event_id % 3 = 0 THEN NULL ELSE '12.5' END AS heading_deg, CASE WHEN event_id % 67 = 0 THEN '' ELSE '1.5' END AS speed_mps, CASE WHEN event_id % 53 = 0 THEN 'deep' ELSE '7' END AS altitude_m,
CASE WHEN event_id % 61 = 0 THEN '1.5' WHEN event_id % 2 = 0 THEN NULL ELSE '40' END AS ping_start, CASE WHEN event_id % 59 = 0 THEN '6e1' WHEN event_id % 2 = 0 THEN '' ELSE ' 59' END AS ping_end FROM events"""

_NUMBER = "WHEN trim(coalesce({c}, '')) <> '' AND TRY_CAST({c} AS DOUBLE) IS NULL THEN '{c}:invalid'"
_WHOLE = "WHEN trim(coalesce({c}, '')) <> '' AND NOT regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN '{c}:invalid'"


@register(
    "S03_scan_navigation_csv",
    f"""WITH t AS ({NAV_TEXT}), u AS (SELECT *, row_number() OVER (PARTITION BY trim(frame) ORDER BY row) AS nth FROM t),
    p AS (SELECT row, CASE WHEN trim(coalesce(frame, '')) = '' THEN 'frame:missing' WHEN nth > 1 THEN 'frame:duplicate'
    WHEN trim(coalesce(latitude, '')) = '' THEN 'latitude:missing' WHEN TRY_CAST(latitude AS DOUBLE) IS NULL OR TRY_CAST(latitude AS DOUBLE) NOT BETWEEN -90 AND 90 THEN 'latitude:invalid'
    WHEN trim(coalesce(longitude, '')) = '' THEN 'longitude:missing' WHEN TRY_CAST(longitude AS DOUBLE) IS NULL OR TRY_CAST(longitude AS DOUBLE) NOT BETWEEN -180 AND 180 THEN 'longitude:invalid'
    WHEN timestamp_utc <> '' AND TRY_CAST(timestamp_utc AS TIMESTAMPTZ) IS NULL THEN 'timestamp_utc:invalid'
    {" ".join(_NUMBER.format(c=c) for c in ("heading_deg", "speed_mps", "altitude_m"))} {" ".join(_WHOLE.format(c=c) for c in ("ping_start", "ping_end"))} END AS p FROM u)
    SELECT row, split_part(p, ':', 1) AS field, split_part(p, ':', 2) AS problem FROM p WHERE p IS NOT NULL""",
)
def s03(v):
    """Rows of the events table as navigation text, bad cases among them, judged by the rules of the CSV source."""
    e = v["events"]
    return N.first_problems(e.sparkSession.sql(NAV_TEXT.replace("FROM events", "FROM {e}"), e=e))


MISSIONS = """SELECT concat('{"mission_id": "m', user_id, '", "survey_name": "', event_type, '", "sequential": ', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ', "mode": "', CASE WHEN event_id % 3 = 0 THEN 'SEQUENTIAL_PING' ELSE 'GRAB' END, '", "evidence": ', CASE WHEN event_id % 5 = 0 THEN 'true' ELSE 'false' END,
', "provenance": "', CASE event_id % 4 WHEN 0 THEN 'measured' WHEN 1 THEN 'SYNTHETIC_DEMO' WHEN 2 THEN 'DERIVED_FROM_SOURCE' ELSE 'guess' END, '"}') AS value FROM events"""


@register(
    "S04_scan_mission_json",
    """WITH m AS (SELECT concat('m', user_id) AS mission_id, event_type AS survey_name, event_id % 2 = 0 OR (event_id % 3 = 0 AND event_id % 5 = 0) AS seq, CASE event_id % 4 WHEN 0 THEN 'MEASURED' WHEN 1 THEN 'SYNTHETIC_DEMO' END AS provenance, CASE event_id % 4 WHEN 2 THEN 'SYSTEM_ONLY_PROVENANCE' WHEN 3 THEN 'UNKNOWN_PROVENANCE' END AS problem FROM events)
    SELECT mission_id, survey_name, seq AS sequential_supported, provenance, problem, count(*) AS n FROM m GROUP BY ALL""",
)
def s04(v):
    e = v["events"]
    m = N.parse_missions(e.sparkSession.sql(MISSIONS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {e}"), e=e))
    return m.groupBy(*m.columns).agg(F.count("*").alias("n"))


@register(
    "S05_resolve_provenance",
    """WITH m AS (SELECT concat('s', c_nationkey) AS survey_id, max(CASE c_custkey % 4 WHEN 0 THEN 'SYNTHETIC' WHEN 1 THEN 'MEASURED' END) AS mission FROM customer GROUP BY c_nationkey), b AS (SELECT concat('s', s_nationkey) AS survey_id, min(CASE s_suppkey % 3 WHEN 0 THEN 'DEMO' WHEN 1 THEN 'MEASURED' END) AS bundle FROM supplier GROUP BY s_nationkey),
    n AS (SELECT coalesce(m.survey_id, b.survey_id) AS survey_id, CASE WHEN mission IN ('SYNTHETIC', 'DEMO') THEN 'SYNTHETIC_DEMO' ELSE mission END AS mission, CASE WHEN bundle IN ('SYNTHETIC', 'DEMO') THEN 'SYNTHETIC_DEMO' ELSE bundle END AS bundle FROM m FULL JOIN b ON m.survey_id = b.survey_id)
    SELECT survey_id, CASE WHEN mission <> bundle THEN NULL ELSE coalesce(mission, bundle) END AS provenance, coalesce(mission <> bundle, false) AS contradiction FROM n""",
)
def s05(v):
    m = v["customer"].groupBy(F.concat(F.lit("s"), "c_nationkey").alias("survey_id")).agg(F.max(F.when(F.col("c_custkey") % 4 == 0, "SYNTHETIC").when(F.col("c_custkey") % 4 == 1, "MEASURED")).alias("mission"))
    b = v["supplier"].groupBy(F.concat(F.lit("s"), "s_nationkey").alias("survey_id")).agg(F.min(F.when(F.col("s_suppkey") % 3 == 0, "DEMO").when(F.col("s_suppkey") % 3 == 1, "MEASURED")).alias("bundle"))
    same = lambda c: F.when(F.col(c).isin("SYNTHETIC", "DEMO"), "SYNTHETIC_DEMO").otherwise(F.col(c))
    n = m.join(b, "survey_id", "full").withColumns({"mission": same("mission"), "bundle": same("bundle")})
    clash = F.coalesce(F.col("mission") != F.col("bundle"), F.lit(False))
    return n.select("survey_id", F.when(~clash, F.coalesce("mission", "bundle")).alias("provenance"), clash.alias("contradiction"))


@register(
    "S06_validate_declared_surveys",
    """WITH d AS (SELECT concat('g', o_custkey) AS grp, CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS frame_id FROM orders), j AS (SELECT d.grp, d.frame_id, f.width, f.height FROM d LEFT JOIN v_frames AS f ON d.frame_id = f.frame_id)
    SELECT 'frame_in_two_groups' AS rule, frame_id::VARCHAR AS subject FROM d GROUP BY frame_id HAVING count(DISTINCT grp) > 1 UNION ALL SELECT 'unknown_frame', frame_id::VARCHAR FROM j WHERE width IS NULL UNION ALL SELECT 'mixed_geometry', grp FROM j GROUP BY grp HAVING count(DISTINCT width || 'x' || height) > 1""",
)
def s06(v):
    d = v["orders"].select(F.concat(F.lit("g"), "o_custkey").alias("grp"), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey")).alias("frame_id"))
    j = d.join(v["v_frames"].select("frame_id", "width", "height"), "frame_id", "left")
    row = lambda rule, c: (F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    two = d.groupBy("frame_id").agg(F.countDistinct("grp").alias("n")).filter("n > 1").select(*row("frame_in_two_groups", "frame_id"))
    unknown = j.filter("width is null").select(*row("unknown_frame", "frame_id"))
    mixed = j.groupBy("grp").agg(F.countDistinct(F.concat_ws("x", "width", "height")).alias("n")).filter("n > 1").select(*row("mixed_geometry", "grp"))
    return two.unionByName(unknown).unionByName(mixed)


@register("S09_scan_yolo_labels", "SELECT detection_id AS name, tile_id - 1 AS cls, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, CASE WHEN tile_id = 6 THEN round(raw_confidence, 6) END AS confidence FROM v_det WHERE tile_id <> 7")
def s09(v):
    """Boxes written as label lines and read back; lines cut short are skipped."""
    n = lambda e: F.format_string("%.10f", e)
    line = F.concat_ws(" ", (F.col("tile_id") - 1).cast("string"), n((F.col("x1") + F.col("x2")) / 2 / 640), n((F.col("y1") + F.col("y2")) / 2 / 120), n((F.col("x2") - F.col("x1")) / 640), n((F.col("y2") - F.col("y1")) / 120))
    lines = v["v_det"].select(F.col("detection_id").alias("name"), F.when(F.col("tile_id") == 7, "6 0.5 0.5").when(F.col("tile_id") == 6, F.concat_ws(" ", line, n(F.col("raw_confidence")))).otherwise(line).alias("line"))
    return N.yolo_boxes(lines, 640, 120).select("name", "cls", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("confidence", 6).alias("confidence"))


@register("S09_scan_predictions", "SELECT detection_id AS name, 0 AS cls, round(x1, 4) AS x1, round(y1, 4) AS y1, round(x2, 4) AS x2, round(y2, 4) AS y2, round(raw_confidence, 6) AS confidence FROM v_det")
def s09_predictions(v):
    """Lines of a detector's output: six tokens each, or the scan fails."""
    n = lambda e: F.format_string("%.10f", e)
    line = F.concat_ws(" ", F.lit("0"), n((F.col("x1") + F.col("x2")) / 2 / 640), n((F.col("y1") + F.col("y2")) / 2 / 120), n((F.col("x2") - F.col("x1")) / 640), n((F.col("y2") - F.col("y1")) / 120), n(F.col("raw_confidence")))
    lines = v["v_det"].select(F.col("detection_id").alias("name"), line.alias("line"))
    return N.yolo_boxes(lines, 640, 120, predictions=True).select("name", "cls", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")], F.round("confidence", 6).alias("confidence"))


@register("S10_scan_parallel_array_objects", "SELECT frame_id, raw_class AS category, x1, x2 FROM v_det")
def s10(v):
    """Boxes and classes kept as two arrays of a frame, zipped back; arrays of different length and unknown categories fail."""
    d = v["v_det"].groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("detection_id", "raw_class", "x1", "x2"))).alias("a"))
    d = d.select("frame_id", F.transform("a", lambda x: F.struct(x["x1"].alias("x1"), x["x2"].alias("x2"))).alias("bbox"), F.transform("a", lambda x: x["raw_class"]).alias("category"))
    ok = F.when(F.size("bbox") == F.size("category"), F.arrays_zip("bbox", "category")).otherwise(F.raise_error(F.lit("arrays of different length")).cast("array<struct<bbox:struct<x1:double,x2:double>,category:string>>"))
    return d.select("frame_id", F.explode(ok).alias("o")).select("frame_id", N.known_category(F.col("o.category"), ("PIPELINE", "SHIPWRECK", "CRAB_POT")).alias("category"), "o.bbox.x1", "o.bbox.x2")


@register(
    "S11_normalise_estimated_state",
    """SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id * 10 END AS t, CASE WHEN event_id % 2 = 0 THEN event_id % 90 + 0.25e0 END AS lat, CASE WHEN event_id % 2 = 0 THEN event_id % 180 + 0.5e0 END AS lon,
    CASE WHEN event_id % 5 <> 0 THEN event_id % 360 * 1e0 END AS heading, CASE WHEN event_id % 3 <> 0 THEN 1.5e0 END AS speed FROM events""",
)
def s11(v):
    """Two logs with headers of their own brought to one set of names; an empty text is null, an absent column too."""
    i = F.col("event_id")
    some = lambda keep, x: F.when(keep, x.cast("string")).otherwise("")
    t, lat, lon = some(i % 7 != 0, i * 10), some(i % 2 == 0, i % 90 + 0.25), some(i % 2 == 0, i % 180 + 0.5)
    heading, speed = some(i % 5 != 0, i % 360), some(i % 3 != 0, F.lit(1.5))
    one = v["events"].filter("event_id % 4 < 2").select("event_id", t.alias("Time"), lat.alias("LAT"), lon.alias("Lon"), heading.alias("Heading_Deg"), speed.alias("SPEED_MPS"))
    two = v["events"].filter("event_id % 4 >= 2").select("event_id", t.alias("timestamp"), lat.alias("Latitude"), lon.alias("Longitude"), heading.alias("heading"), speed.alias("speed"))
    return N.estimated_state(one, ["event_id"]).unionByName(N.estimated_state(two, ["event_id"]))


@register("J15_survey_columns_join", "SELECT detection_id, CASE WHEN count(DISTINCT n.survey_ref) > 0 THEN string_agg(DISTINCT n.survey_ref, '|' ORDER BY n.survey_ref) END AS surveys FROM v_det AS d LEFT JOIN v_nav AS n ON n.frame_id IN (d.frame_id, d.frame_id + 1) GROUP BY detection_id")
def j15(v):
    d = v["v_det"].select("detection_id", F.explode(F.array("frame_id", F.col("frame_id") + 1)).alias("frame_id"))
    out = d.join(v["v_nav"].select("frame_id", "survey_ref"), "frame_id", "left").groupBy("detection_id").agg(F.array_sort(F.collect_set("survey_ref")).alias("s"))
    return out.select("detection_id", F.when(F.size("s") > 0, F.array_join("s", "|")).alias("surveys"))


@register(
    "S16_legacy_report_rows",
    """WITH l AS (SELECT contact_id, arg_max(verdict, (created_at, event_id)) AS verdict FROM v_reviews WHERE verdict IS NOT NULL GROUP BY contact_id)
    SELECT d.detection_id, d.raw_class AS classification, CASE WHEN d.raw_confidence < 0.25 THEN 'ANOMALY' ELSE 'DETECTION' END AS kind, CASE WHEN d.raw_confidence >= 0.25 THEN round(d.raw_confidence, 6) END AS class_confidence,
    CASE WHEN d.raw_confidence < 0.25 THEN round(d.raw_confidence, 6) END AS anomaly_score, l.verdict AS review_state, round(n.latitude, 6) AS latitude, n.longitude, CASE WHEN n.latitude IS NOT NULL THEN round((d.x2 - d.x1) * 0.05e0, 6) END AS length_m,
    CASE WHEN n.latitude IS NOT NULL THEN round((d.y2 - d.y1) * 0.05e0, 6) END AS width_m, d.frame_id AS source_frame, d.tile_id AS source_tile, concat('run_', f.survey_id) AS run_id, 'detector-v1' AS model_version_id
    FROM v_det AS d LEFT JOIN v_frames AS f ON d.frame_id = f.frame_id LEFT JOIN v_nav AS n ON d.frame_id = n.frame_id LEFT JOIN l ON l.contact_id = concat('c', d.frame_id % 500)""",
)
def s16(v):
    """The fourteen columns of the older report: lengths only where the place is known, a confidence or an anomaly score."""
    n = v["v_nav"].select("frame_id", "latitude", "longitude")
    last = v["v_reviews"].filter("verdict is not null").groupBy(F.col("contact_id").alias("c")).agg(F.max_by("verdict", F.struct("created_at", "event_id")).alias("verdict"))
    d = v["v_det"].join(v["v_frames"].select("frame_id", "survey_id"), "frame_id", "left").join(n, "frame_id", "left").withColumn("c", F.concat(F.lit("c"), F.col("frame_id") % 500)).join(last, "c", "left")
    weak, score, here = F.col("raw_confidence") < 0.25, F.round("raw_confidence", 6), F.col("latitude").isNotNull()
    metres = lambda a, b: F.when(here, F.round((F.col(b) - F.col(a)) * 0.05, 6))
    return d.select(
        "detection_id", F.col("raw_class").alias("classification"), F.when(weak, "ANOMALY").otherwise("DETECTION").alias("kind"), F.when(~weak, score).alias("class_confidence"), F.when(weak, score).alias("anomaly_score"),
        F.col("verdict").alias("review_state"), F.round("latitude", 6).alias("latitude"), "longitude", metres("x1", "x2").alias("length_m"), metres("y1", "y2").alias("width_m"), F.col("frame_id").alias("source_frame"), F.col("tile_id").alias("source_tile"),
        F.concat(F.lit("run_"), "survey_id").alias("run_id"), F.lit("detector-v1").alias("model_version_id"),
    )


@register("S18_export_training_manifests", "WITH l AS (SELECT contact_id, arg_max(verdict, (created_at, event_id)) AS verdict FROM v_reviews WHERE verdict IS NOT NULL GROUP BY contact_id) SELECT CASE verdict WHEN 'REJECTED' THEN 'hard_negative' WHEN 'CONFIRMED' THEN 'positive' ELSE 'uncertain' END AS bucket, l.contact_id, c.category FROM l LEFT JOIN v_contacts AS c ON l.contact_id = c.contact_id")
def s18(v):
    """Reviewed contacts in three buckets, written as a folder of JSON lines for each and read back."""
    last = v["v_reviews"].filter("verdict is not null").groupBy("contact_id").agg(F.max_by("verdict", F.struct("created_at", "event_id")).alias("verdict"))
    bucket = F.when(F.col("verdict") == "REJECTED", "hard_negative").when(F.col("verdict") == "CONFIRMED", "positive").otherwise("uncertain")
    out = last.join(v["v_contacts"].select("contact_id", "category"), "contact_id", "left").select(bucket.alias("bucket"), "contact_id", "category")
    path = scratch(out.sparkSession)
    out.write.partitionBy("bucket").json(path)
    return out.sparkSession.read.schema("contact_id string, category string, bucket string").json(path)


@register("S20_scan_embedding_bank", """SELECT label, count(*) AS vectors, min(len(embedding)) AS least_dim, max(len(embedding)) AS most_dim, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong, count(*) FILTER (WHERE embedding IS NULL OR len(embedding) = 0) AS empty,
sum(('0x' || substr(md5(array_to_string(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)), ',')), 1, 8))::BIGINT)::BIGINT AS content FROM embeddings GROUP BY label""")
def s20(v):
    """Dimensions of a bank, empty vectors, and a sum of digests that any change of a vector changes."""
    n = F.size("embedding").cast("bigint")
    whole = F.array_join(F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("string")), ",")
    return v["embeddings"].groupBy("label").agg(F.count("*").alias("vectors"), F.min(n).alias("least_dim"), F.max(n).alias("most_dim"), F.count_if(n != 64).alias("wrong"), F.count_if(F.col("embedding").isNull() | (n == 0)).alias("empty"), F.sum(F.conv(F.substring(F.md5(whole.cast("binary")), 1, 8), 16, 10).cast("bigint")).alias("content"))


_MISSION = "SELECT *, CASE WHEN CAST(substr(contact_id, 2) AS BIGINT) % 211 = 0 THEN 'PROCESSING' ELSE 'READY' END AS upload, CAST(substr(survey_id, 2) AS BIGINT) % 2 = 0 AS demo, (CAST(substr(survey_id, 2) AS BIGINT) % 2 = 0) <> (CAST(substr(contact_id, 2) AS BIGINT) % 97 = 0) AS contact_demo FROM v_contacts"


_STRONG = f"(SELECT survey_id, contact_id, contact_id AS item FROM ({_MISSION}) AS y WHERE evidence >= 0.9)"


@register(
    "S21_mission_report_snapshot",
    f"""WITH {digest_sql(_STRONG, 'survey_id', 'contact_id')}, m AS ({_MISSION}), s AS (SELECT survey_id, CASE WHEN bool_or(upload <> 'READY') THEN 'REPORT_NOT_READY' WHEN bool_or(contact_demo <> demo) THEN 'DEMO_ISOLATION' END AS refused, count(*) AS contacts FROM m GROUP BY survey_id)
    SELECT s.survey_id, refused, contacts, coalesce(d.n, 0) AS strong, d.digest AS strong_digest, d0.n + 1 AS place, d0.item AS contact_id FROM s LEFT JOIN digests AS d ON s.survey_id IS NOT DISTINCT FROM d.survey_id LEFT JOIN d0 ON s.survey_id IS NOT DISTINCT FROM d0.survey_id""",
)
def s21(v):
    """One consistent report of each survey: refused while an upload is not ready or demo flags mix; its strong contacts by number and ordered digest, and each by its place in a row of its own (a survey without any: one row)."""
    c = v["v_contacts"].sparkSession.sql(_MISSION.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"])
    refused = F.when(F.bool_or(F.col("upload") != "READY"), "REPORT_NOT_READY").when(F.bool_or(F.col("contact_demo") != F.col("demo")), "DEMO_ISOLATION")
    strong = c.filter("evidence >= 0.9").select("survey_id", "contact_id")
    digests = ordered.digest_tree(strong, ["survey_id"], ["contact_id"], F.col("contact_id")).select(F.col("survey_id").alias("of"), F.col("n").alias("strong"), F.col("digest").alias("strong_digest"))
    s = c.groupBy("survey_id").agg(refused.alias("refused"), F.count("*").alias("contacts")).join(digests, F.expr("survey_id <=> of"), "left").drop("of").withColumn("strong", F.coalesce("strong", F.lit(0)))
    s = stored(s)  # a row for each survey, read twice
    # surveys without strong contacts come in apart: an inner join lets the rows of a large survey be split
    none = s.filter("strong = 0").withColumns({"place": F.lit(None).cast("long"), "contact_id": F.lit(None).cast("string")})
    places = ordered.ranked(strong.withColumnRenamed("survey_id", "of"), ["of"], ["contact_id"], "place")
    return s.join(places, F.expr("survey_id <=> of")).drop("of").unionByName(none)


@register(
    "P33_ablation_rows",
    """WITH g AS (SELECT segment, CASE WHEN count(*) FILTER (WHERE latest_verdict IN ('CONFIRMED', 'REJECTED')) > 0 THEN round(count(*) FILTER (WHERE latest_verdict = 'CONFIRMED') * 1e0 / count(*) FILTER (WHERE latest_verdict IN ('CONFIRMED', 'REJECTED')), 9) END AS "precision",
    count(*) FILTER (WHERE latest_verdict = 'REJECTED') AS false_positive_count, round(count(latest_verdict) * 1e0 / count(*), 9) AS review_burden_proxy FROM v_contacts GROUP BY segment)
    SELECT s AS stack, segment, "precision", NULL::DOUBLE AS recall, false_positive_count, NULL::DOUBLE AS event_recall, review_burden_proxy, CASE WHEN "precision" IS NULL THEN 'precision,recall,event_recall' ELSE 'recall,event_recall' END AS missing_metrics
    FROM g, (VALUES ('detector'), ('persistence'), ('physics'), ('fusion')) AS x(s)""",
)
def p33(v):
    """Each stack with the metrics that the reviews allow; those that need full truth stay null and are listed."""
    sure = F.count_if(F.col("latest_verdict").isin("CONFIRMED", "REJECTED"))
    none = F.lit(None).cast("double")
    g = v["v_contacts"].groupBy("segment").agg(
        F.round(F.expr("try_divide(count_if(latest_verdict = 'CONFIRMED'), count_if(latest_verdict IN ('CONFIRMED', 'REJECTED')))"), 9).alias("precision"), F.count_if(F.col("latest_verdict") == "REJECTED").alias("false_positive_count"), F.round(F.count("latest_verdict") / F.count("*"), 9).alias("review_burden_proxy"), sure.alias("sure"),
    )
    g = g.withColumns({"recall": none, "event_recall": none})
    metrics = ("precision", "recall", "false_positive_count", "event_recall", "review_burden_proxy")
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics])), ",")
    stack = F.explode(F.array(*map(F.lit, ("detector", "persistence", "physics", "fusion"))))
    return g.select(stack.alias("stack"), "segment", *metrics, missing.alias("missing_metrics"))


@register("A38_ui_counters", "SELECT survey_id, count(*) FILTER (WHERE has_navigation) AS positioned, count(*) FILTER (WHERE evidence >= 0.75) AS high, count(*) FILTER (WHERE latest_verdict = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE latest_verdict IS NULL OR latest_verdict = 'UNCERTAIN') AS awaiting, count(latest_verdict) AS reviewed, count(*) FILTER (WHERE category = 'SOMETHING_ELSE') AS open_set, count(*) FILTER (WHERE latest_verdict = 'CONFIRMED' AND category NOT IN ('PIPELINE', 'ENGINEERING_STRUCTURE', 'SOMETHING_ELSE')) AS important FROM v_contacts GROUP BY survey_id")
def a38(v):
    c = F.col
    return v["v_contacts"].groupBy("survey_id").agg(F.count_if("has_navigation").alias("positioned"), F.count_if(c("evidence") >= 0.75).alias("high"), F.count_if(c("latest_verdict") == "CONFIRMED").alias("confirmed"), F.count_if(c("latest_verdict").isNull() | (c("latest_verdict") == "UNCERTAIN")).alias("awaiting"), F.count("latest_verdict").alias("reviewed"), F.count_if(c("category") == "SOMETHING_ELSE").alias("open_set"), F.count_if(ui_priority() == "High").alias("important"))


_PURPOSE = "SELECT frame_id, group_key, split, CASE WHEN frame_id % 101 = 0 THEN 'evaluate' WHEN split = 'train' THEN 'fit' WHEN split = 'val' THEN 'calibrate' ELSE 'evaluate' END AS purpose FROM v_frames"


@register(
    "A42_leakage_guards",
    f"""WITH p AS ({_PURPOSE}) SELECT 'siblings_across_splits' AS rule, group_key::VARCHAR AS subject FROM p GROUP BY group_key HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'duplicate_id', frame_id::VARCHAR FROM p GROUP BY frame_id HAVING count(*) > 1
    UNION ALL SELECT 'purpose_not_allowed', frame_id::VARCHAR FROM p WHERE (purpose, split) NOT IN (('fit', 'train'), ('calibrate', 'val'), ('evaluate', 'test')) UNION ALL SELECT 'evaluation_row_not_test', frame_id::VARCHAR FROM p WHERE purpose = 'evaluate' AND split <> 'test'""",
)
def a42(v):
    """Violations of the four guards: siblings in one split, unique ids, the split a purpose may read, evaluation on test rows only."""
    f = v["v_frames"]
    p = f.sparkSession.sql(_PURPOSE.replace("FROM v_frames", "FROM {f}"), f=f)
    row = lambda rule, c: (F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    one = p.groupBy("group_key").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(*row("siblings_across_splits", "group_key"))
    two = p.groupBy("frame_id").agg(F.count("*").alias("n")).filter("n > 1").select(*row("duplicate_id", "frame_id"))
    allowed = F.expr("(purpose = 'fit' and split = 'train') or (purpose = 'calibrate' and split = 'val') or (purpose = 'evaluate' and split = 'test')")
    broken = F.array_compact(F.array(F.when(~allowed, "purpose_not_allowed"), F.when(F.expr("purpose = 'evaluate' and split <> 'test'"), "evaluation_row_not_test")))
    each = p.select(F.explode(broken).alias("rule"), F.col("frame_id").cast("string").alias("subject"))
    return one.unionByName(two).unionByName(each)


@register(
    "A43_snapshot_qa",
    """WITH d AS (SELECT f.dataset, f.split, f.frame_id, count(v.detection_id) AS n, count(*) FILTER (WHERE v.x2 > 400 OR v.y2 > 140) AS o FROM v_frames AS f LEFT JOIN v_det AS v ON f.frame_id = v.frame_id GROUP BY f.dataset, f.split, f.frame_id)
    SELECT dataset, split, 'frames' AS measure, count(*)::DOUBLE AS value FROM d GROUP BY ALL UNION ALL SELECT dataset, split, 'empty_share', round(avg(CASE WHEN n = 0 THEN 1e0 ELSE 0e0 END), 9) FROM d GROUP BY dataset, split
    UNION ALL SELECT dataset, split, 'out_of_bounds', sum(o)::DOUBLE FROM d GROUP BY dataset, split UNION ALL SELECT f.dataset, f.split, 'boxes_' || v.raw_class, count(*)::DOUBLE FROM v_frames AS f JOIN v_det AS v ON f.frame_id = v.frame_id GROUP BY f.dataset, f.split, v.raw_class
    UNION ALL SELECT dataset, split, 'error_frame_' || frame_id, o::DOUBLE FROM d WHERE o >= 8""",
)
def a43(v):
    """Frames, share of empty ones, boxes out of bounds and of each class by dataset and split, and the frames with many errors."""
    d = v["v_det"].groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(F.expr("x2 > 400 or y2 > 140")).alias("o"))
    f = v["v_frames"].select("frame_id", "dataset", "split")
    j = f.join(d, "frame_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "o": F.coalesce("o", F.lit(0))})
    g = j.groupBy("dataset", "split").agg(F.count("*").cast("double").alias("frames"), F.round(F.avg((F.col("n") == 0).cast("double")), 9).alias("empty_share"), F.sum("o").cast("double").alias("out_of_bounds"))
    g = g.unpivot(["dataset", "split"], ["frames", "empty_share", "out_of_bounds"], "measure", "value")
    c = f.join(v["v_det"].select("frame_id", "raw_class"), "frame_id").groupBy("dataset", "split", F.concat(F.lit("boxes_"), "raw_class").alias("measure")).agg(F.count("*").cast("double").alias("value"))
    return g.unionByName(c).unionByName(j.filter("o >= 8").select("dataset", "split", F.concat(F.lit("error_frame_"), F.col("frame_id").cast("string")).alias("measure"), F.col("o").cast("double").alias("value")))


@register("J19_sweep_vs_runtime", "WITH a AS (SELECT frame_id, raw_class, round(raw_confidence, 6) AS c FROM v_det WHERE raw_confidence >= 0.25), b AS (SELECT frame_id, raw_class, round(raw_confidence, 6) AS c FROM v_det WHERE raw_confidence >= 0.25 AND tile_id <> 5) SELECT frame_id, count(*) AS differing FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS x GROUP BY frame_id")
def j19(v):
    """Bags of both paths compared; frames whose bags differ."""
    a = v["v_det"].filter("raw_confidence >= 0.25").select("frame_id", "raw_class", F.round("raw_confidence", 6).alias("c"), "tile_id")
    b = a.filter("tile_id <> 5").drop("tile_id")
    a = a.drop("tile_id")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).groupBy("frame_id").agg(F.count("*").alias("differing"))


@register("A33_coreset_linspace", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings WHERE label < 8) SELECT vec_id FROM r WHERE i IN (SELECT CAST(floor(k * (n - 1) / 63e0) AS BIGINT) FROM range(0, 64) AS a(k), (SELECT count(*) AS n FROM embeddings WHERE label < 8) AS b)")
def a33(v):
    """64 evenly spaced vectors of the ordered background: a rank by ranges of ids, then an equi-join with the places."""
    from pyspark.sql import Window as W

    e = v["embeddings"].filter("label < 8").select("vec_id", F.floor(F.col("vec_id") / 4096).alias("r"))
    per = e.groupBy("r").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = e.join(per, "r").select("vec_id", (F.row_number().over(W.partitionBy("r").orderBy("vec_id")) - 1 + F.col("before")).alias("i"))  # a row for 4096 ids
    n = e.agg(F.count("*").alias("n"))
    places = n.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"), "n").select(F.floor(F.col("k") * (F.col("n") - 1) / 63.0).alias("i")).distinct()
    return ranked.join(F.broadcast(places), "i").select("vec_id")


@register("A31_image_features", """SELECT image_id, round(avg(sample), 6) AS mean, round(stddev_pop(sample), 6) AS std, round(quantile_cont(sample::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(sample::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(sample::DOUBLE, 0.95), 6) AS p95, round(avg(CASE WHEN sample >= 165 THEN 1e0 ELSE 0e0 END), 6) AS mask_share, round(quantile_cont(sample::DOUBLE, 0.95) - quantile_cont(sample::DOUBLE, 0.05), 6) AS contrast, max(e.entropy) AS entropy, count(DISTINCT row_idx) AS image_height, count(DISTINCT col_idx) AS image_width FROM v_imgs JOIN
(SELECT image_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT image_id, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY image_id) AS p FROM v_imgs GROUP BY image_id, sample) AS h GROUP BY image_id) AS e USING (image_id) GROUP BY image_id""")
def a31(v):
    """Intensity, contrast, entropy of the 256-bin histogram and mask share of each raster (edges are not part of it)."""
    from pyspark.sql import Window as W

    x = F.col("sample").cast("double")
    q = lambda p: F.percentile(x, F.lit(p))
    bins = v["v_imgs"].groupBy("image_id", "sample").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("image_id")))
    entropy = bins.groupBy("image_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))
    m = v["v_imgs"].groupBy("image_id").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), *[F.round(q(p), 6).alias(n) for p, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))], F.round(F.avg((x >= 165).cast("double")), 6).alias("mask_share"), F.round(q(0.95) - q(0.05), 6).alias("contrast"), F.countDistinct("row_idx").alias("image_height"), F.countDistinct("col_idx").alias("image_width"))
    return m.join(entropy, "image_id")


@register(
    "A31_box_medians",
    "SELECT frame_id, count(*) AS objects, round(median((x2 - x1) * (y2 - y1) / (640e0 * 120e0)), 9) AS area_median, round(median((x2 - x1) / (y2 - y1)), 9) AS aspect_median FROM v_det GROUP BY frame_id",
)
def a31_boxes(v):
    """Medians of the boxes of each image: share of the image, and width by height."""
    w, h = F.expr("x2 - x1"), F.expr("y2 - y1")
    return v["v_det"].groupBy("frame_id").agg(F.count("*").alias("objects"), F.round(F.median(w * h / (640.0 * 120.0)), 9).alias("area_median"), F.round(F.median(w / h), 9).alias("aspect_median"))


@register("J22_contact_audit_diff", "WITH b AS (SELECT frame_id, raw_class, string_agg(detection_id, ',' ORDER BY detection_id) AS m FROM v_det GROUP BY ALL), a AS (SELECT frame_id, raw_class, string_agg(detection_id, ',' ORDER BY detection_id) AS m FROM v_det WHERE tile_id <> 6 GROUP BY ALL) SELECT 'removed' AS change, m FROM b WHERE m NOT IN (SELECT m FROM a) UNION ALL SELECT 'added', m FROM a WHERE m NOT IN (SELECT m FROM b) UNION ALL SELECT 'full_frame_merge', string_agg(detection_id, ',' ORDER BY detection_id) FROM v_det WHERE tile_id <> 6 GROUP BY frame_id, raw_class HAVING count(*) FILTER (WHERE inference_mode = 'FULL_FRAME') > 1")
def j22(v):
    sets = lambda d: d.groupBy("frame_id", "raw_class").agg(F.array_join(F.array_sort(F.collect_list("detection_id")), ",").alias("m")).select("m")
    b, a = sets(v["v_det"]), sets(v["v_det"].filter("tile_id <> 6"))
    diff = b.join(a, "m", "left_anti").select(F.lit("removed").alias("change"), "m").unionByName(a.join(b, "m", "left_anti").select(F.lit("added").alias("change"), "m"))
    whole = F.count_if(F.col("inference_mode") == "FULL_FRAME")  # full frames of one frame that became one contact
    merged = v["v_det"].filter("tile_id <> 6").groupBy("frame_id", "raw_class").agg(F.array_join(F.array_sort(F.collect_list("detection_id")), ",").alias("m"), whole.alias("n")).filter("n > 1")
    return diff.unionByName(merged.select(F.lit("full_frame_merge").alias("change"), "m"))


def ui_priority():
    """Priority of a contact by its review and class; categories without a class are anomaly candidates."""
    awaiting = F.coalesce("latest_verdict", F.lit("UNCERTAIN")) == "UNCERTAIN"
    return F.when(F.col("latest_verdict") == "REJECTED", "Low").when(awaiting, "Review").when(F.col("category") == "PIPELINE", "Low").when(F.col("category").isin("ENGINEERING_STRUCTURE", "SOMETHING_ELSE"), "Medium").otherwise("High")


@register("P28_ui_class_and_priority", "SELECT contact_id, CASE category WHEN 'PIPELINE' THEN 'Pipeline' WHEN 'WRECK_OR_STRUCTURAL_DEBRIS' THEN 'Wreck' WHEN 'DERELICT_FISHING_GEAR' THEN 'Fishing gear' ELSE 'Unknown' END AS label, latest_verdict IS NULL OR latest_verdict = 'UNCERTAIN' AS awaiting, CASE WHEN latest_verdict = 'REJECTED' THEN 'Low' WHEN latest_verdict IS NULL OR latest_verdict = 'UNCERTAIN' THEN 'Review' WHEN category = 'PIPELINE' THEN 'Low' WHEN category IN ('ENGINEERING_STRUCTURE', 'SOMETHING_ELSE') THEN 'Medium' ELSE 'High' END AS priority FROM v_contacts")
def p28(v):
    awaiting = F.coalesce("latest_verdict", F.lit("UNCERTAIN")) == "UNCERTAIN"
    names = F.create_map(*[F.lit(x) for x in ("PIPELINE", "Pipeline", "WRECK_OR_STRUCTURAL_DEBRIS", "Wreck", "DERELICT_FISHING_GEAR", "Fishing gear")])
    return v["v_contacts"].select("contact_id", F.coalesce(F.element_at(names, F.col("category")), F.lit("Unknown")).alias("label"), awaiting.alias("awaiting"), ui_priority().alias("priority"))
