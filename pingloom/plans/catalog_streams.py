"""Batch twins of the streaming jobs, and the pluggable scorer."""

from pyspark.sql import functions as F

from ..streaming import jobs as T
from .registry import register


_REVIEWED = "l AS (SELECT contact_id, arg_max(verdict, (created_at, event_id)) AS latest_verdict, count(*) AS review_count FROM v_reviews WHERE verdict IS NOT NULL GROUP BY contact_id)"


@register(
    "T01_review_event_stream",
    f"WITH {_REVIEWED} SELECT contact_id, latest_verdict, review_count, CASE WHEN latest_verdict IN ('CONFIRMED', 'REJECTED') THEN latest_verdict ELSE 'UNRESOLVED' END AS disposition FROM l",
)
def t01(v):
    """Two batches of events merged as the stream merges them."""
    return _merged(v).drop("last")


def _merged(v):
    r = v["v_reviews"]
    return T.merged_state(T.review_state(r.filter("event_id % 2 = 0")), r.filter("event_id % 2 = 1"))


@register(
    "T01_review_priority",
    f"""WITH {_REVIEWED}, s AS (SELECT c.* EXCLUDE (latest_verdict), l.latest_verdict, coalesce(review_count, 0) AS review_count, CASE WHEN coalesce(evidence, persistence, quality) IS NOT NULL THEN (coalesce(evidence, 0e0) + coalesce(persistence, 0e0) + coalesce(quality, 0e0)) / ((evidence IS NOT NULL)::INT + (persistence IS NOT NULL)::INT + (quality IS NOT NULL)::INT) END AS p FROM v_contacts AS c LEFT JOIN l ON c.contact_id = l.contact_id)
    SELECT contact_id, review_count, CASE WHEN review_count = 0 THEN 'UNREVIEWED' WHEN latest_verdict IN ('CONFIRMED', 'REJECTED') THEN latest_verdict ELSE 'UNRESOLVED' END AS disposition, round(p, 9) AS priority_score, CASE WHEN p >= 0.75 THEN 'HIGH' WHEN p >= 0.5 THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'LOW' ELSE 'UNAVAILABLE' END AS priority_band,
    CASE WHEN p IS NULL THEN 'REVIEW' WHEN coalesce(quality, 0e0) < 0.45 THEN CASE WHEN has_navigation THEN 'REACQUIRE' ELSE 'REVIEW' END WHEN latest_verdict = 'CONFIRMED' AND p >= 0.75 THEN 'RECOVERY_CANDIDATE' WHEN p >= 0.6 THEN 'INSPECT' ELSE 'REVIEW' END AS recommended_action FROM s""",
)
def t01_priority(v):
    """The priority of all contacts after two batches of verdicts."""
    return T.with_priority(v["v_contacts"], _merged(v)).select("contact_id", "review_count", "disposition", F.round("priority_score", 9).alias("priority_score"), "priority_band", "recommended_action")


@register(
    "T02_mutation_history",
    """WITH e AS (SELECT event_id, contact_id, created_at, CASE WHEN verdict IN ('CONFIRMED', 'REJECTED') THEN verdict END AS status, CASE WHEN verdict = 'RELABELLED' THEN reviewer END AS label FROM v_reviews)
    SELECT event_id, last_value(status IGNORE NULLS) OVER a AS after_status, last_value(status IGNORE NULLS) OVER b AS before_status, last_value(label IGNORE NULLS) OVER a AS after_label, last_value(label IGNORE NULLS) OVER b AS before_label FROM e
    WINDOW a AS (PARTITION BY contact_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY contact_id ORDER BY created_at, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def t02(v):
    h = v["v_reviews"].select("event_id", "contact_id", "created_at", F.when(F.col("verdict").isin("CONFIRMED", "REJECTED"), F.col("verdict")).alias("status"), F.when(F.col("verdict") == "RELABELLED", F.col("reviewer")).alias("label"))
    return T.last_known(h, "contact_id", ["created_at", "event_id"], ["status", "label"]).select("event_id", "after_status", "before_status", "after_label", "before_label")


@register(
    "T03_first_write_wins",
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY contact_id ORDER BY created_at, event_id) AS k FROM v_reviews WHERE event_id >= 300) SELECT contact_id, event_id FROM r WHERE k = 1 AND contact_id NOT IN (SELECT contact_id FROM v_reviews WHERE event_id < 300)",
)
def t03(v):
    r = v["v_reviews"].select("contact_id", "event_id", "created_at")
    return T.first_writes(r.filter("event_id < 300").dropDuplicates(["contact_id"]), r.filter("event_id >= 300"), ["contact_id"], ["created_at", "event_id"]).select("contact_id", "event_id")


@register("T04_duplicate_upload_filter", "WITH u AS (SELECT frame_id AS upload_id, source AS mission, raster_sha256 AS sha FROM v_rasters JOIN documents ON frame_id = doc_id), r AS (SELECT *, CASE WHEN sha IS NULL THEN upload_id ELSE min(upload_id) OVER (PARTITION BY mission, sha) END AS earlier FROM u) SELECT upload_id, mission, earlier, upload_id <> earlier AS rejected FROM r")
def t04(v):
    """Uploads of all missions, in two batches as the stream takes them: those below the middle id come first."""
    u = v["v_rasters"].join(v["documents"].select(F.col("doc_id").alias("frame_id"), F.col("source").alias("mission")), "frame_id").select(F.col("frame_id").alias("upload_id"), "mission", F.col("raster_sha256").alias("sha"))
    u = u.crossJoin(F.broadcast(u.agg(F.avg("upload_id").alias("middle"))))
    none = u.select("mission", "sha", F.col("upload_id").alias("earlier")).limit(0)
    one = T.split_uploads(none, u.filter("upload_id < middle").drop("middle"))
    two = T.split_uploads(one.filter("not rejected and sha is not null").select("mission", "sha", "earlier"), u.filter("upload_id >= middle").drop("middle"))
    return one.unionByName(two).select("upload_id", "mission", "earlier", "rejected")


#: Phases of a job in order (fixed values).
PHASES = ("upload_decoded", "metadata_read", "detector_ready", "inference", "condition", "open_set", "contact_fusion", "evidence", "report")
_PHASE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHASES[:7]))


@register(
    "T05_phase_progress",
    f"""WITH e AS (SELECT event_id, reviewer AS job, CASE event_id % 7 {_PHASE} END AS phase, coalesce(verdict, 'NOTE') AS state, created_at FROM v_reviews),
    l AS (SELECT job, phase, arg_max(state, (created_at, event_id)) AS state FROM e GROUP BY job, phase) SELECT j.job, p.phase, coalesce(state, 'QUEUED') AS state FROM (SELECT DISTINCT job FROM e) AS j CROSS JOIN (VALUES {", ".join(f"('{p}')" for p in PHASES)}) AS p(phase) LEFT JOIN l ON l.job = j.job AND l.phase = p.phase""",
)
def t05(v):
    phase = F.element_at(F.array(*map(F.lit, PHASES[:7])), (F.col("event_id") % 7 + 1).cast("int"))
    e = v["v_reviews"].select("event_id", F.col("reviewer").alias("job"), phase.alias("phase"), F.coalesce("verdict", F.lit("NOTE")).alias("state"), F.col("created_at").alias("ts"))
    return T.phase_progress(e, list(PHASES))


@register("T06_versioned_backfill", "SELECT contact_id, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN round(coalesce(evidence, 0e0) * 0.5e0 + 0.25e0, 9) ELSE evidence END AS evidence, 2 AS version FROM v_contacts")
def t06(v):
    """Rows of an older method version are computed anew, once; a second run changes nothing."""
    c = v["v_contacts"].withColumn("version", F.when(F.col("segment").isin("BUILDING", "MACHINERY"), 1).otherwise(2))
    old = F.col("version") < 2
    return c.select("contact_id", F.when(old, F.round(F.coalesce("evidence", F.lit(0.0)) * 0.5 + 0.25, 9)).otherwise(F.col("evidence")).alias("evidence"), F.lit(2).alias("version"))


@register(
    "T07_survey_sessions",
    """WITH s AS (SELECT survey_ref, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY survey_ref ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS o FROM v_nav), q AS (SELECT *, sum(o) OVER (PARTITION BY survey_ref ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT survey_ref, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM q GROUP BY survey_ref, k""",
)
def t07(v):
    return T.sessions(v["v_nav"].select("survey_ref", "ts"), "survey_ref", "2 hours").select("survey_ref", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


#: Fixes arrive out of order: some come many events later than they were taken.
_ARRIVAL = "frame_id + frame_id % 11 * 1500"


@register(
    "T07_late_sessions",
    f"""WITH a AS (SELECT survey_ref, ts, max(ts) OVER (PARTITION BY survey_ref ORDER BY {_ARRIVAL}, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM v_nav),
    l AS (SELECT *, coalesce(epoch_us(ts) < epoch_us(high) - 43200000000, false) AS late FROM a),
    s AS (SELECT survey_ref, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY survey_ref ORDER BY ts) <= 7200000000 THEN 0 ELSE 1 END AS o FROM l WHERE NOT late), q AS (SELECT *, sum(o) OVER (PARTITION BY survey_ref ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
    SELECT survey_ref, 'SESSION' AS kind, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 7200000000 AS end_us, count(*) AS n FROM q GROUP BY survey_ref, k
    UNION ALL SELECT survey_ref, 'LATE', NULL, NULL, count(*) FROM l WHERE late GROUP BY survey_ref""",
)
def t07_late(v):
    """Sessions of the fixes that arrive in time, and the number of late ones."""
    e = v["v_nav"].select("survey_ref", "ts", "frame_id", F.expr(_ARRIVAL).alias("arrival"))
    out = T.sessions_with_late(e, "survey_ref", ["arrival", "frame_id"], 7200, 43_200)
    return out.select("survey_ref", "kind", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@register("F01_pluggable_scorer", "SELECT contact_id, evidence, NULL::DOUBLE AS score, 'SCORER_NOT_AVAILABLE' AS score_reason FROM v_contacts")
def f01(v):
    """The scorer hook without a scorer: a null score and the reason, never an invented value."""
    from ..functions.scorers import score

    return score(v["v_contacts"].select("contact_id", "evidence"), None)


@register("F01_scorer_given", "SELECT contact_id, evidence, round(coalesce(evidence, 0e0) * 0.5e0 + 0.25e0, 9) AS score, NULL AS score_reason FROM v_contacts")
def f01_given(v):
    """The hook with a scorer, which gets batches of rows."""
    from ..functions.scorers import score

    return score(v["v_contacts"].select("contact_id", "evidence"), lambda b: b["evidence"].fillna(0.0) * 0.5 + 0.25).withColumn("score", F.round("score", 9))


@register("F02_sql_functions", "SELECT contact_id, round(0.70e0 + (0.90e0 - 0.70e0) / (1 + exp(-28e0 * (evidence - 0.3139777305538386e0))), 9) AS shown, CASE WHEN evidence >= 0.75 THEN 'HIGH' WHEN evidence >= 0.5 THEN 'MEDIUM' WHEN evidence IS NOT NULL THEN 'LOW' ELSE 'UNAVAILABLE' END AS band FROM v_contacts")
def f02(v):
    """The library's expressions as SQL functions of the session."""
    c = v["v_contacts"]
    spark = c.sparkSession
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pl_display(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x BETWEEN 0 AND 1 THEN 0.70D + (0.90D - 0.70D) / (1 + exp(-28D * (x - 0.3139777305538386D))) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION pl_band(x DOUBLE) RETURNS STRING RETURN CASE WHEN x >= 0.75D THEN 'HIGH' WHEN x >= 0.5D THEN 'MEDIUM' WHEN x IS NOT NULL THEN 'LOW' ELSE 'UNAVAILABLE' END")
    return spark.sql("SELECT contact_id, round(pl_display(evidence), 9) AS shown, pl_band(evidence) AS band FROM {c}", c=c)


@register("W_reviews_latest_by_reviewer", "SELECT reviewer, verdict, count(*) AS n FROM (SELECT reviewer, contact_id, arg_max(verdict, (created_at, event_id)) AS verdict FROM v_reviews WHERE verdict IS NOT NULL GROUP BY reviewer, contact_id) AS x GROUP BY reviewer, verdict")
def reviewer_agreement(v):
    last = v["v_reviews"].filter("verdict is not null").groupBy("reviewer", "contact_id").agg(F.max_by("verdict", F.struct("created_at", "event_id")).alias("verdict"))
    return last.groupBy("reviewer", "verdict").agg(F.count("*").alias("n"))


