"""Queries of windows, sorting and top rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ordered
from .fixtures import digest_sql
from .registry import register


@register("W02_supersede_chain", "WITH w AS (SELECT event_id, contact_id, lag(event_id) OVER (PARTITION BY contact_id ORDER BY created_at, event_id) AS supersedes, lead(event_id) OVER (PARTITION BY contact_id ORDER BY created_at, event_id) IS NULL AS latest FROM v_reviews) SELECT * FROM w")
def w02(v):
    w = W.partitionBy("contact_id").orderBy("created_at", "event_id")
    return v["v_reviews"].select("event_id", "contact_id", F.lag("event_id").over(w).alias("supersedes"), F.lead("event_id").over(w).isNull().alias("latest"))


@register(
    "W03_consecutive_ping_run",
    """WITH p AS (SELECT DISTINCT survey_ref, raw_class, ping_start, ping_end FROM v_obs WHERE ping_start IS NOT NULL), g AS (SELECT *, CASE WHEN lag(ping_end) OVER w + 1 = ping_start THEN 0 ELSE 1 END AS cut FROM p WINDOW w AS (PARTITION BY survey_ref, raw_class ORDER BY ping_start, ping_end)),
    i AS (SELECT *, sum(cut) OVER (PARTITION BY survey_ref, raw_class ORDER BY ping_start, ping_end ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT survey_ref, raw_class, count(*) FILTER (WHERE island = m) AS trailing_run FROM (SELECT *, max(island) OVER (PARTITION BY survey_ref, raw_class) AS m FROM i) AS x GROUP BY survey_ref, raw_class""",
)
def w03(v):
    """Length of the last run of windows that follow on one another; any break starts again at 1."""
    p = v["v_obs"].filter("ping_start is not null").select("survey_ref", "raw_class", "ping_start", "ping_end").distinct()
    p = ordered.chains(p, ["survey_ref", "raw_class"], ["ping_start", "ping_end"], ["ping_end"], F.col("prev_ping_end") + 1 == F.col("ping_start"))
    return p.groupBy("survey_ref", "raw_class", "chain").agg(F.count("*").alias("n")).groupBy("survey_ref", "raw_class").agg(F.max_by("n", "chain").alias("trailing_run"))


SESSIONS = """WITH s AS (SELECT frame_id, survey_ref, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY survey_ref ORDER BY ts, frame_id) <= 7200000000 THEN 0 ELSE 1 END AS opens FROM v_nav),
q AS (SELECT *, sum(opens) OVER (PARTITION BY survey_ref ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS session FROM s) """


def _sessions(v, most: int):
    """Fixes with ``chain``: a gap of more than ``most`` microseconds opens one."""
    n = v["v_nav"].select("frame_id", "survey_ref", "ts")
    return ordered.chains(n, ["survey_ref"], ["ts", "frame_id"], ["ts"], F.unix_micros("ts") - F.unix_micros("prev_ts") <= most)


@register("W04_gap_sessions", SESSIONS + "SELECT survey_ref, session, count(*) AS frames, CAST(floor(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS seconds FROM q GROUP BY survey_ref, session")
def w04(v):
    s = _sessions(v, 7_200_000_000).groupBy("survey_ref", F.col("chain").alias("session"))
    return s.agg(F.count("*").alias("frames"), F.floor((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("seconds"))


@register(
    "W04_offset_plan",
    SESSIONS.replace("7200000000", "30000000") + """, o AS (SELECT survey_ref, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY survey_ref)) / 1e6 / 3600 AS off, session FROM q)
    SELECT survey_ref, CASE WHEN off < 200 THEN 'val' WHEN off < 500 THEN 'embargo' WHEN off < 700 THEN 'train' ELSE 'unused' END AS plan, count(*) AS frames, count(DISTINCT session) AS sessions FROM o GROUP BY ALL""",
)
def w04_plan(v):
    """Sessions by gaps above 30 seconds, and the part that an offset (hours here) from a survey's start belongs to."""
    s = _sessions(v, 30_000_000)
    start = v["v_nav"].groupBy("survey_ref").agg(F.min(F.unix_micros("ts")).alias("s"))
    off = (F.unix_micros("ts") - F.col("s")) / 1e6 / 3600
    plan = F.when(off < 200, "val").when(off < 500, "embargo").when(off < 700, "train").otherwise("unused")
    return s.join(start, "survey_ref").groupBy("survey_ref", plan.alias("plan")).agg(F.count("*").alias("frames"), F.countDistinct("chain").alias("sessions"))


@register("W05_anchored_blocks", "SELECT frame_id, survey_ref, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY survey_ref)) / 60000000e0) AS BIGINT) AS block FROM v_nav")
def w05(v):
    start = v["v_nav"].groupBy("survey_ref").agg(F.min(F.unix_micros("ts")).alias("s"))  # combinable, then a join: no window over a whole survey
    return v["v_nav"].join(start, "survey_ref").select("frame_id", "survey_ref", F.floor((F.unix_micros("ts") - F.col("s")) / 60e6).alias("block"))


@register("W06_one_per_parent", "SELECT split, group_key, min(frame_id::VARCHAR) AS representative, count(*) AS siblings, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id::VARCHAR) AS ids FROM v_frames GROUP BY split, group_key")
def w06(v):
    """The smallest path of each parent in a split, with its siblings; a path that stands twice fails."""
    i = F.col("frame_id").cast("string")
    twice = F.count(i) != F.countDistinct(i)
    f = v["v_frames"].groupBy("split", "group_key").agg(F.min(i).alias("representative"), F.count("*").alias("siblings"), F.array_join(F.array_sort(F.collect_list(i)), ",").alias("ids"), twice.alias("twice"))
    return f.withColumn("ids", F.when(F.col("twice"), F.raise_error(F.lit("a path stands twice")).cast("string")).otherwise(F.col("ids"))).drop("twice")


@register("W07_newest_reviews", "SELECT event_id, contact_id, verdict, (SELECT count(*) FROM v_reviews WHERE verdict IS NOT NULL) AS total FROM v_reviews WHERE verdict IS NOT NULL ORDER BY created_at DESC, event_id DESC LIMIT 100")
def w07(v):
    """The newest verdicts. The limit is the feature."""
    r = v["v_reviews"].filter("verdict is not null")
    return r.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(100).select("event_id", "contact_id", "verdict").crossJoin(F.broadcast(r.agg(F.count("*").alias("total"))))


RANK = "CASE category WHEN 'DERELICT_FISHING_GEAR' THEN 0 WHEN 'WRECK_OR_STRUCTURAL_DEBRIS' THEN 1 WHEN 'PIPELINE' THEN 2 ELSE 3 END"


@register("W08_review_queue_order", f"SELECT survey_id, contact_id, row_number() OVER (PARTITION BY survey_id ORDER BY latest_verdict IS NOT NULL, {RANK}, evidence DESC NULLS LAST, contact_id) AS place FROM v_contacts")
def w08(v):
    order = [F.col("latest_verdict").isNotNull(), F.expr(RANK), F.col("evidence").desc_nulls_last(), "contact_id"]
    return ordered.ranked(v["v_contacts"].select("survey_id", "contact_id", "latest_verdict", "evidence"), ["survey_id"], order, "place").select("survey_id", "contact_id", "place")


@register("W09_contact_view_order", "SELECT survey_id, contact_id, row_number() OVER (PARTITION BY survey_id ORDER BY coalesce(latest_verdict, 'UNCERTAIN') <> 'UNCERTAIN', evidence >= 0.75 DESC NULLS LAST, evidence DESC NULLS LAST, contact_id) AS place FROM v_contacts")
def w09(v):
    order = [F.coalesce("latest_verdict", F.lit("UNCERTAIN")) != "UNCERTAIN", (F.col("evidence") >= 0.75).desc_nulls_last(), F.col("evidence").desc_nulls_last(), "contact_id"]
    return ordered.ranked(v["v_contacts"].select("survey_id", "contact_id", "latest_verdict", "evidence"), ["survey_id"], order, "place").select("survey_id", "contact_id", "place")


@register("W10_top_patch_per_tile", "WITH t AS (SELECT image_id, arg_max(row_idx * 64 + col_idx, (sample, -row_idx, -col_idx)) AS patch, max(sample) AS score FROM v_imgs GROUP BY image_id) SELECT image_id, patch, score, patch % 64 * 8e0 AS box_x, patch // 64 * 8e0 AS box_y, 8e0 AS box_size FROM t")
def w10(v):
    """The strongest patch of each tile, the first of equals, and its box on the tile: 64 patches to a side of 512 pixels."""
    t = v["v_imgs"].groupBy("image_id").agg(F.max_by(F.expr("row_idx * 64 + col_idx"), F.expr("struct(sample, -row_idx, -col_idx)")).alias("patch"), F.max("sample").alias("score"))
    side = 512.0 / 64
    return t.select("image_id", "patch", "score", (F.col("patch") % 64 * side).alias("box_x"), (F.expr("patch div 64") * side).alias("box_y"), F.lit(side).alias("box_size"))


@register("W11_top_n_components", "SELECT frame_id, n FROM (SELECT frame_id, count(*) AS n FROM v_det GROUP BY frame_id) AS g ORDER BY n DESC, frame_id LIMIT 30")
def w11(v):
    return v["v_det"].groupBy("frame_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "frame_id").limit(30)


@register("W12_oversample_plan", "SELECT frame_id, unnest(range(0, CASE WHEN dataset LIKE '1%' THEN 5 WHEN dataset LIKE '2%' THEN 3 ELSE 1 END)) AS repeat_index FROM v_frames WHERE split = 'train'")
def w12(v):
    times = F.when(F.col("dataset").startswith("1"), 5).when(F.col("dataset").startswith("2"), 3).otherwise(1)
    return v["v_frames"].filter("split = 'train'").select("frame_id", F.explode(F.sequence(F.lit(0), times - 1)).alias("repeat_index"))


@register("W13_track_order", f"WITH {digest_sql('(SELECT survey_ref, ts, frame_id, frame_id::VARCHAR AS item FROM v_nav)', 'survey_ref', 'ts, frame_id')} SELECT survey_ref, n AS fixes, digest AS track FROM digests")
def w13(v):
    """The order of each survey's fixes as a digest of digests."""
    fixes = v["v_nav"].select("survey_ref", "ts", "frame_id")
    return ordered.digest_tree(fixes, ["survey_ref"], ["ts", "frame_id"], F.col("frame_id").cast("string")).select("survey_ref", F.col("n").alias("fixes"), F.col("digest").alias("track"))


@register("W14_history_sequence", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS sequence FROM conversations")
def w14(v):
    return v["conversations"].select("conv_id", "turn", "role", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role")).alias("sequence"))
