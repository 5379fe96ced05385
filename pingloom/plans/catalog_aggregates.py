"""Queries of aggregations."""

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates as A
from ..operators import ordered
from .catalog_boxes import IOU_SQL
from .catalog_joins import NEAR, j09
from .fixtures import digest_sql
from .registry import register


@register(
    "A08_window_persistence",
    f"""WITH n AS (SELECT a.detection_id, count(DISTINCT b.tile_id) AS observed, round(sqrt(var_pop((b.x1 + b.x2) / 2) + var_pop((b.y1 + b.y2) / 2)), 9) AS scatter FROM v_det AS a JOIN v_det AS b ON a.frame_id = b.frame_id AND a.raw_class = b.raw_class AND {IOU_SQL.format(a='a.', b='b.')} >= 0.30 GROUP BY a.detection_id),
    o AS (SELECT d.detection_id, t.opportunities FROM v_det AS d JOIN (SELECT frame_id, count(DISTINCT tile_id) AS opportunities FROM v_det GROUP BY frame_id) AS t ON d.frame_id = t.frame_id),
    p AS (SELECT n.detection_id, observed, opportunities, scatter, observed * 1e0 / opportunities AS p, 1.6448536269514722e0 * 1.6448536269514722e0 AS zz FROM n JOIN o ON n.detection_id = o.detection_id)
    SELECT detection_id, observed, opportunities, CASE WHEN opportunities > 1 THEN round(greatest(0e0, least(1e0, (p + zz / (2 * opportunities) - 1.6448536269514722e0 * sqrt((p * (1 - p) + zz / (4 * opportunities)) / opportunities)) / (1 + zz / opportunities))), 9) END AS wilson, CASE WHEN opportunities > 1 THEN scatter END AS scatter_px FROM p""",
)
def a08(v):
    from ..operators import joins as J

    d = v["v_det"].select("detection_id", "frame_id", "raw_class", "tile_id", "x1", "y1", "x2", "y2")
    centre = lambda p, q: (F.col(f"b.{p}") + F.col(f"b.{q}")) / 2
    n = J.overlapping_pairs(d, ["frame_id", "raw_class"]).groupBy(F.col("a.detection_id").alias("detection_id"), F.col("a.frame_id").alias("frame_id")).agg(F.countDistinct("b.tile_id").alias("observed"), F.round(F.sqrt(F.var_pop(centre("x1", "x2")) + F.var_pop(centre("y1", "y2"))), 9).alias("scatter"))
    o = d.groupBy("frame_id").agg(F.countDistinct("tile_id").alias("opportunities"))
    out, many = n.join(o, "frame_id"), F.col("opportunities") > 1
    return out.select("detection_id", "observed", "opportunities", F.when(many, F.round(scores.wilson_lower(F.col("observed"), F.col("opportunities")), 9)).alias("wilson"), F.when(many, F.col("scatter")).alias("scatter_px"))


@register("A09_split_and_class_counts", "SELECT split, dataset, width, raw_class, count(DISTINCT f.frame_id) AS frames, count(DISTINCT group_key) AS groups, count(detection_id) AS boxes FROM v_frames AS f LEFT JOIN v_det AS d ON f.frame_id = d.frame_id GROUP BY GROUPING SETS ((split), (dataset), (raw_class), (split, dataset), (split, width), (split, raw_class), (split, dataset, raw_class), ())")
def a09(v):
    """Counts by several sets of keys in one pass over frames and classes.

    Boxes are counted by frame and class before they meet the frames, so each row is one (frame, class). A frame is
    counted once where classes are kept apart, and by the first of its rows where they are not.
    """
    boxes = v["v_det"].groupBy("frame_id", "raw_class").agg(F.count("detection_id").alias("boxes"))
    first = boxes.groupBy("frame_id").agg(F.min("raw_class").alias("first_class"))
    boxes = boxes.join(first, "frame_id").withColumn("lead", (F.col("raw_class") == F.col("first_class")).cast("int"))
    f = v["v_frames"].select("frame_id", "split", "dataset", "width", "group_key").join(boxes, "frame_id", "left").withColumn("lead", F.coalesce("lead", F.lit(1)))
    sets = [["split"], ["dataset"], ["raw_class"], ["split", "dataset"], ["split", "width"], ["split", "raw_class"], ["split", "dataset", "raw_class"], []]
    out = f.groupingSets(sets, "split", "dataset", "width", "raw_class").agg(
        F.grouping("raw_class").alias("all_classes"), F.sum("lead").alias("leads"), F.count(F.lit(1)).alias("rows"), F.countDistinct("group_key").alias("groups"), F.coalesce(F.sum("boxes"), F.lit(0)).alias("boxes")
    )
    return out.select("split", "dataset", "width", "raw_class", F.when(F.col("all_classes") == 1, F.col("leads")).otherwise(F.col("rows")).alias("frames"), "groups", "boxes")


@register("A10_snapshot_identity", f"WITH {digest_sql('(SELECT survey_id, frame_id, frame_id::VARCHAR AS item FROM v_frames)', 'survey_id', 'frame_id')} SELECT survey_id, n AS frames, substr(sha256('split_v1|' || digest), 1, 16) AS snapshot_id FROM digests")
def a10(v):
    """Identity of each survey's snapshot: the split's name and the digest tree of its frames in order."""
    tree = ordered.digest_tree(v["v_frames"].select("survey_id", "frame_id"), ["survey_id"], ["frame_id"], F.col("frame_id").cast("string"))
    return tree.select("survey_id", F.col("n").alias("frames"), F.substring(F.sha2(F.concat(F.lit("split_v1|"), "digest"), 256), 1, 16).alias("snapshot_id"))


@register("A11_review_stats", "SELECT reviewer, count(*) AS events, count(verdict) AS verdicts, count(*) FILTER (WHERE verdict = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE verdict = 'REJECTED') AS rejected, count(*) FILTER (WHERE verdict = 'UNCERTAIN') AS uncertain, count(DISTINCT contact_id) AS contacts FROM v_reviews GROUP BY reviewer")
def a11(v):
    is_ = lambda k: F.count_if(F.col("verdict") == k)
    return v["v_reviews"].groupBy("reviewer").agg(F.count("*").alias("events"), F.count("verdict").alias("verdicts"), is_("CONFIRMED").alias("confirmed"), is_("REJECTED").alias("rejected"), is_("UNCERTAIN").alias("uncertain"), F.countDistinct("contact_id").alias("contacts"))


@register("A12_report_counts", "SELECT survey_id, count(*) AS contacts, count(*) FILTER (WHERE has_navigation) AS positioned, count(anomaly) AS open_set_scored, count(*) FILTER (WHERE verification IN ('SUPPORTED', 'WEAK_SUPPORT')) AS verified, count(latest_verdict) AS reviewed, count(*) FILTER (WHERE latest_verdict = 'CONFIRMED') AS confirmed FROM v_contacts GROUP BY survey_id")
def a12(v):
    c = F.col
    return v["v_contacts"].groupBy("survey_id").agg(F.count("*").alias("contacts"), F.count_if(c("has_navigation")).alias("positioned"), F.count("anomaly").alias("open_set_scored"), F.count_if(c("verification").isin("SUPPORTED", "WEAK_SUPPORT")).alias("verified"), F.count("latest_verdict").alias("reviewed"), F.count_if(c("latest_verdict") == "CONFIRMED").alias("confirmed"))


@register(
    "A13_survey_index",
    """WITH f AS (SELECT survey_id, count(*) AS frames, CAST(max(epoch(ts)) AS BIGINT) AS newest FROM v_frames GROUP BY survey_id), c AS (SELECT survey_id, count(*) AS contacts, count(latest_verdict) AS reviewed FROM v_contacts GROUP BY survey_id)
    SELECT f.survey_id, frames, newest, coalesce(contacts, 0) AS contacts, coalesce(reviewed, 0) AS reviewed FROM f LEFT JOIN c ON f.survey_id = c.survey_id ORDER BY newest DESC, f.survey_id""",
)
def a13(v):
    """All surveys, the newest first; how many of them are shown is up to the caller."""
    f = v["v_frames"].groupBy("survey_id").agg(F.count("*").alias("frames"), F.unix_timestamp(F.max("ts")).alias("newest"))
    c = v["v_contacts"].groupBy("survey_id").agg(F.count("*").alias("contacts"), F.count("latest_verdict").alias("reviewed"))
    return f.join(c, "survey_id", "left").select("survey_id", "frames", "newest", F.coalesce("contacts", F.lit(0)).alias("contacts"), F.coalesce("reviewed", F.lit(0)).alias("reviewed")).orderBy(F.col("newest").desc(), "survey_id")


@register("A15_class_counts", "SELECT coalesce(d.frame_id, g.frame_id) AS frame_id, coalesce(d.raw_class, g.raw_class) AS raw_class, coalesce(detections, 0) AS detections, coalesce(gt, 0) AS gt FROM (SELECT frame_id, raw_class, count(*) AS detections FROM v_det GROUP BY ALL) AS d FULL JOIN (SELECT frame_id, gt_class AS raw_class, count(*) AS gt FROM v_gt GROUP BY ALL) AS g ON d.frame_id = g.frame_id AND d.raw_class = g.raw_class")
def a15(v):
    d = v["v_det"].groupBy("frame_id", "raw_class").agg(F.count("*").alias("detections"))
    g = v["v_gt"].groupBy("frame_id", F.col("gt_class").alias("raw_class")).agg(F.count("*").alias("gt"))
    return d.join(g, ["frame_id", "raw_class"], "full").select("frame_id", "raw_class", F.coalesce("detections", F.lit(0)).alias("detections"), F.coalesce("gt", F.lit(0)).alias("gt"))


UNITS = "u AS (SELECT raw_class || '/' || CAST(floor(frame_id / 16) AS BIGINT) AS grp, sum(CASE WHEN raw_confidence > 0.5 THEN 1 ELSE 0 END) AS num, count(*) AS den FROM v_det GROUP BY ALL)"


@register(
    "A17_cluster_bootstrap",
    f"""WITH {UNITS}, k AS (SELECT *, row_number() OVER (ORDER BY grp COLLATE "C") - 1 AS i, count(*) OVER () AS n FROM u), s AS (SELECT r, slot FROM range(0, 300) AS a(r), (SELECT unnest(range(0, (SELECT count(*) FROM u))) AS slot)),
    d AS (SELECT r, ('0x' || substr(md5('11:' || r || ':' || slot), 1, 8))::BIGINT % (SELECT count(*) FROM u) AS i FROM s), p AS (SELECT r, sum(num) AS num, sum(den) AS den FROM d JOIN k ON d.i = k.i GROUP BY r),
    q AS (SELECT r, num * 1e0 / nullif(den, 0) AS rate FROM p), o AS (SELECT rate, row_number() OVER (ORDER BY rate, r) - 1 AS k, count(*) OVER () AS draws FROM q WHERE rate IS NOT NULL)
    SELECT round((SELECT sum(num) * 1e0 / sum(den) FROM u), 9) AS point, (SELECT count(*) FROM u) AS n_groups, max(draws) AS draws, 0 AS undefined_draws, round(max(CASE WHEN k = floor(0.025e0 * (draws - 1)) THEN rate END), 9) AS ci_low, round(max(CASE WHEN k = ceil(0.975e0 * (draws - 1)) THEN rate END), 9) AS ci_high FROM o""",
)
def a17(v):
    u = v["v_det"].select(F.concat_ws("/", "raw_class", F.floor(F.col("frame_id") / 16).cast("string")).alias("grp"), (F.col("raw_confidence") > 0.5).cast("int").alias("num"), F.lit(1).alias("den"))
    out = A.cluster_bootstrap(u, 300, 11)
    return out.select(F.round("point", 9).alias("point"), "n_groups", "draws", "undefined_draws", F.round("ci_low", 9).alias("ci_low"), F.round("ci_high", 9).alias("ci_high"))


@register(
    "A18_clopper_pearson",
    """WITH c AS (SELECT survey_id, count(*) FILTER (WHERE latest_verdict = 'CONFIRMED') AS k, count(*) AS n FROM v_contacts GROUP BY survey_id),
    b AS (SELECT survey_id, k, n, 0 AS step, 0e0 AS a_lo, 1e0 AS a_hi, 0e0 AS b_lo, 1e0 AS b_hi FROM c UNION ALL
      SELECT survey_id, k, n, step + 1, CASE WHEN low THEN (a_lo + a_hi) / 2 ELSE a_lo END, CASE WHEN low THEN a_hi ELSE (a_lo + a_hi) / 2 END, CASE WHEN high THEN (b_lo + b_hi) / 2 ELSE b_lo END, CASE WHEN high THEN b_hi ELSE (b_lo + b_hi) / 2 END
      FROM (SELECT *, list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((a_lo + a_hi) / 2) + (n - i) * ln(1 - (a_lo + a_hi) / 2)))) < 0.025 AS low,
        list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((b_lo + b_hi) / 2) + (n - i) * ln(1 - (b_lo + b_hi) / 2)))) > 0.025 AS high FROM b WHERE step < 48) AS s)
    SELECT survey_id, k, n, round(CASE WHEN k = 0 THEN 0 ELSE (a_lo + a_hi) / 2 END, 9) AS cp_low, round(CASE WHEN k = n THEN 1 ELSE (b_lo + b_hi) / 2 END, 9) AS cp_high FROM b WHERE step = 48""",
    recursive=True,
)
def a18(v):
    """Exact intervals of the confirmed share of each survey's contacts."""
    c = v["v_contacts"].groupBy("survey_id").agg(F.count_if(F.col("latest_verdict") == "CONFIRMED").alias("k"), F.count("*").alias("n"))
    return A.clopper_pearson(c, "k", "n").select("survey_id", "k", "n", F.round("cp_low", 9).alias("cp_low"), F.round("cp_high", 9).alias("cp_high"))


@register("A19_saturation_counts", "SELECT f.dataset, f.split, count(*) AS passes, count(*) FILTER (WHERE n >= 28) AS saturated, round(count(*) FILTER (WHERE n >= 28) * 1e0 / count(*), 9) AS rate FROM (SELECT frame_id, count(*) AS n FROM v_det GROUP BY frame_id) AS d JOIN v_frames AS f ON d.frame_id = f.frame_id GROUP BY f.dataset, f.split")
def a19(v):
    n = v["v_det"].groupBy("frame_id").agg(F.count("*").alias("n")).join(v["v_frames"].select("frame_id", "dataset", "split"), "frame_id")
    full = F.count_if(F.col("n") >= 28)
    return n.groupBy("dataset", "split").agg(F.count("*").alias("passes"), full.alias("saturated"), F.round(full / F.count("*"), 9).alias("rate"))


_Q = ", ".join(f"round(quantile_cont({{x}}, {p}), 9) AS {n}" for n, p in (("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9)))


@register("A20_quantile_summary", "SELECT raw_class, min(raw_confidence) AS min, " + _Q.format(x="raw_confidence") + ", max(raw_confidence) AS max FROM v_det GROUP BY raw_class")
def a20(v):
    return A.quantile_summary(v["v_det"], "raw_class", "raw_confidence")


@register("A21_group_statistics", "SELECT f.group_key, f.split, count(DISTINCT f.frame_id) AS images, count(d.detection_id) AS instances, round(median(d.x2 - d.x1), 9) AS median_width FROM v_frames AS f LEFT JOIN v_det AS d ON f.frame_id = d.frame_id GROUP BY f.group_key, f.split")
def a21(v):
    d = v["v_det"].select("frame_id", "detection_id", (F.col("x2") - F.col("x1")).alias("w"))
    return v["v_frames"].join(d, "frame_id", "left").groupBy("group_key", "split").agg(F.countDistinct("frame_id").alias("images"), F.count("detection_id").alias("instances"), F.round(F.median("w"), 9).alias("median_width"))


@register("A22_class_exposure", "SELECT raw_class, m AS oversample, count(*) * m AS instances, count(DISTINCT frame_id) * m AS positive_images, round(count(*) * m * 16e0 / (SELECT count(DISTINCT frame_id) FROM v_det), 9) AS per_batch, (SELECT count(DISTINCT frame_id) FROM v_det) - count(DISTINCT frame_id) AS background FROM v_det, (VALUES (1), (3), (5)) AS x(m) GROUP BY raw_class, m")
def a22(v):
    """Instances and positive images of a class under 1, 3 and 5 repeats, and what a batch of 16 holds."""
    total = v["v_det"].agg(F.countDistinct("frame_id").alias("t"))
    g = v["v_det"].groupBy("raw_class").agg(F.count("*").alias("n"), F.countDistinct("frame_id").alias("p")).crossJoin(F.broadcast(total))
    m = F.col("oversample")
    return g.withColumn("oversample", F.explode(F.array(*map(F.lit, (1, 3, 5))))).select("raw_class", "oversample", (F.col("n") * m).alias("instances"), (F.col("p") * m).alias("positive_images"), F.round(F.col("n") * m * 16 / F.col("t"), 9).alias("per_batch"), (F.col("t") - F.col("p")).alias("background"))


@register("A32_open_set_threshold", "WITH t AS (SELECT quantile_cont(anomaly, 0.99) AS tau FROM v_contacts WHERE segment = 'BUILDING'), s AS (SELECT survey_id, quantile_cont(anomaly, 0.995) AS q FROM v_contacts GROUP BY survey_id) SELECT c.survey_id, round(greatest(tau, q), 9) AS threshold, count(*) FILTER (WHERE anomaly >= greatest(tau, q)) AS candidates FROM v_contacts AS c JOIN s ON c.survey_id = s.survey_id, t GROUP BY c.survey_id, tau, q")
def a32(v):
    c = v["v_contacts"]
    tau = A.exact_quantiles(c.filter("segment = 'BUILDING'"), [], "anomaly", {"tau": 0.99}).select("tau")
    s = A.exact_quantiles(c, ["survey_id"], "anomaly", {"q": 0.995}).select("survey_id", "q")
    s = c.select("survey_id").distinct().join(s, "survey_id", "left").crossJoin(F.broadcast(tau)).select("survey_id", F.greatest("tau", "q").alias("threshold"))
    return c.join(s, "survey_id").groupBy("survey_id", "threshold").agg(F.count_if(F.col("anomaly") >= F.col("threshold")).alias("candidates")).withColumn("threshold", F.round("threshold", 9))


_ISOTONIC = """g AS (SELECT score, sum(label)::DOUBLE AS s, count(*)::DOUBLE AS n FROM v_scored GROUP BY ALL), c AS (SELECT *, sum(s) OVER (ORDER BY score) AS cs, sum(n) OVER (ORDER BY score) AS cn FROM g),
    m AS (SELECT a.score AS i, b.score AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM c AS a JOIN c AS b ON b.score >= a.score), l AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS least FROM m),
    k AS (SELECT j AS score, round(max(least), 9) AS fitted FROM l GROUP BY j)"""


@register("A34_isotonic_calibration", f"WITH {_ISOTONIC} SELECT score, fitted FROM k")
def a34(v):
    """The fitted value of each score that occurs among the labelled ones."""
    blocks = A.isotonic_blocks(v["v_scored"], "score", "label")
    return A.isotonic_lookup(v["v_scored"].select("score").distinct(), blocks, "score").withColumn("fitted", F.round("fitted", 9))


@register("A34_step_lookup", f"WITH {_ISOTONIC}, q AS (SELECT doc_id, (n_chars + doc_id % 7) / 20000e0 AS score FROM documents) SELECT doc_id, coalesce((SELECT arg_min(fitted, k.score) FROM k WHERE k.score >= q.score), (SELECT arg_max(fitted, k.score) FROM k)) AS fitted FROM q")
def a34_lookup(v):
    """Scores of all documents, most of which are no knots: the first knot at or above gives the value."""
    blocks = A.isotonic_blocks(v["v_scored"], "score", "label")
    q = v["documents"].select("doc_id", ((F.col("n_chars") + F.col("doc_id") % 7) / 20000).alias("score"))
    return A.isotonic_lookup(q, blocks, "score").select("doc_id", F.round("fitted", 9).alias("fitted"))


@register("A35_logistic_fusion_fit")
def a35(v):
    """L2 logistic regression on standardized contact evidence; the converged optimum, whatever the solver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = list(FUSION)
    # surveys whose number is divisible by 5 are held out
    c = _eight(v).filter("latest_verdict in ('CONFIRMED', 'REJECTED') and cast(substr(survey_id, 2) as int) % 5 <> 0").select((F.col("latest_verdict") == "CONFIRMED").cast("double").alias("label"), *names)
    model = LogisticRegression(regParam=0.01, standardization=True).fit(VectorAssembler(inputCols=names, outputCol="features").transform(c))
    rows = [(n, float(w)) for n, w in zip(names, model.coefficients, strict=True)] + [("intercept", float(model.intercept))]
    return c.sparkSession.createDataFrame(rows, "feature string, weight double")


#: Weights of the fitted fusion by feature (fixed values).
FUSION = {"logit": 0.4, "wilson": 1.25, "log_opportunities": 0.3, "shadow": 0.8, "shadow_applicable": -0.2, "context_z": 0.75, "clutter": -0.5, "anomaly": 0.6}
_EIGHT = """SELECT contact_id, latest_verdict, survey_id, coalesce(ln(p / (1 - p)), 0e0) AS logit, coalesce(persistence, 0e0) AS wilson, ln(1 + coalesce(strength * 10, 0e0)) AS log_opportunities, coalesce(physics, 0e0) AS shadow, CASE WHEN physics IS NOT NULL THEN 1e0 ELSE 0e0 END AS shadow_applicable,
coalesce(quality, 0e0) AS context_z, coalesce(artificiality, 0e0) AS clutter, coalesce(anomaly, 0e0) AS anomaly FROM (SELECT *, least(1e0 - 1e-6, greatest(1e-6, evidence)) AS p FROM v_contacts) AS c"""


def _eight(v):
    return v["v_contacts"].sparkSession.sql(_EIGHT.replace("FROM v_contacts", "FROM {c}"), c=v["v_contacts"])


@register("A36_logistic_fusion_score", f"WITH x AS ({_EIGHT}), c AS (SELECT contact_id, {', '.join(f'{w}e0 * {n} AS c_{n}' for n, w in FUSION.items())} FROM x) SELECT contact_id, {', '.join(f'round(c_{n}, 9) AS c_{n}' for n in FUSION)}, round(1 / (1 + exp(-greatest(-40e0, least(40e0, -1.5e0 + {' + '.join(f'c_{n}' for n in FUSION)})))), 9) AS fused FROM c")
def a36(v):
    """The contribution of each feature, and the sigmoid of their clamped sum."""
    parts = {n: F.col(n) * w for n, w in FUSION.items()}
    logit = sum(parts.values(), F.lit(-1.5))
    return _eight(v).select("contact_id", *[F.round(c, 9).alias(f"c_{n}") for n, c in parts.items()], F.round(1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), logit)))), 9).alias("fused"))


@register(
    "A37_auprc",
    """WITH s AS (SELECT doc_id, least(1e0, score) AS score, label FROM v_scored), r AS (SELECT label, row_number() OVER w AS rank, sum(label) OVER (ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING) AS hits FROM s WINDOW w AS (ORDER BY score DESC, doc_id))
    SELECT round(sum(CASE WHEN label = 1 THEN hits * 1e0 / rank END) / sum(label), 9) AS average_precision, count(*) AS n, sum(label)::BIGINT AS positives FROM r""",
)
def a37(v):
    s = v["v_scored"].withColumn("score", F.least(F.lit(1.0), F.col("score")))
    return A.average_precision(s, "score", "label", "doc_id").withColumn("average_precision", F.round("average_precision", 9))


#: Degrees that a coverage reaches beyond its fixes.
PAD = 0.002


@register("A39_track_extent", "SELECT survey_ref, round(min(latitude), 6) AS south, round(max(latitude), 6) AS north, min(longitude) AS west, max(longitude) AS east, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon, count(*) AS fixes, round(min(latitude) - 0.002e0, 6) AS coverage_south, round(max(latitude) + 0.002e0, 6) AS coverage_north, round(min(longitude) - 0.002e0, 6) AS coverage_west, round(max(longitude) + 0.002e0, 6) AS coverage_east FROM v_nav GROUP BY survey_ref")
def a39(v):
    return v["v_nav"].groupBy("survey_ref").agg(F.round(F.min("latitude"), 6).alias("south"), F.round(F.max("latitude"), 6).alias("north"), F.min("longitude").alias("west"), F.max("longitude").alias("east"), F.round(F.avg("latitude"), 6).alias("lat"), F.round(F.avg("longitude"), 6).alias("lon"), F.count("*").alias("fixes"), *[F.round(f(c) + sign * PAD, 6).alias(f"coverage_{n}") for n, c, f, sign in (("south", "latitude", F.min, -1), ("north", "latitude", F.max, 1), ("west", "longitude", F.min, -1), ("east", "longitude", F.max, 1))])


@register(
    "A40_duplicate_raster_groups",
    """WITH g AS (SELECT raster_sha256, count(*) AS n, min(frame_id) AS first FROM v_rasters WHERE raster_sha256 IS NOT NULL GROUP BY raster_sha256)
    SELECT r.frame_id, CASE WHEN n > 1 THEN 'DUPLICATE_RASTER' WHEN n = 1 THEN 'UNIQUE' END AS status, CASE WHEN n > 1 THEN first END AS group_representative, n AS members FROM v_rasters AS r LEFT JOIN g ON r.raster_sha256 = g.raster_sha256""",
)
def a40(v):
    """The status of each image, and its group by representative: a row for each member, whatever the size of the group."""
    r = v["v_rasters"]
    g = r.filter("raster_sha256 is not null").groupBy("raster_sha256").agg(F.count("*").alias("n"), F.min("frame_id").alias("first"))
    n = F.col("n")
    return r.join(g, "raster_sha256", "left").select("frame_id", F.when(n > 1, "DUPLICATE_RASTER").when(n == 1, "UNIQUE").alias("status"), F.when(n > 1, F.col("first")).alias("group_representative"), n.alias("members"))


@register(
    "A40_group_lists",
    "SELECT raster_sha256, count(*) AS members, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS ids FROM v_rasters WHERE raster_sha256 IS NOT NULL GROUP BY raster_sha256 HAVING count(*) > 1",
)
def a40_lists(v):
    """The sorted members of each group, once a group."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("frame_id")), lambda x: x.cast("string")), ",")
    return v["v_rasters"].filter("raster_sha256 is not null").groupBy("raster_sha256").agg(F.count("*").alias("members"), ids.alias("ids")).filter("members > 1")


@register(
    "A41_split_integrity",
    f"""WITH {NEAR} SELECT 'group_overlap' AS rule, group_key::VARCHAR AS subject FROM v_frames GROUP BY group_key HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'duplicate_raster_across_splits', r.raster_sha256 FROM v_rasters AS r JOIN v_frames AS f ON r.frame_id = f.frame_id WHERE raster_sha256 IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'test_without_positives', f.survey_id FROM v_frames AS f LEFT JOIN v_gt AS g ON f.frame_id = g.frame_id WHERE split = 'test' GROUP BY f.survey_id HAVING count(g.gt_id) = 0
    UNION ALL SELECT 'ineligible_in_evaluation', frame_id::VARCHAR FROM v_frames WHERE split IN ('val', 'test') AND dataset = '5-LOW'
    UNION ALL SELECT 'tile_split_differs', detection_id FROM v_det AS d JOIN v_frames AS f ON d.frame_id = f.frame_id WHERE CASE WHEN tile_id = 7 THEN 'test' ELSE f.split END <> f.split
    UNION ALL SELECT 'near_duplicate_across_splits', a_id || '-' || b_id FROM near""",
)
def a41(v):
    """Violations of the split rules, a row each; no rows: the split holds."""
    f = v["v_frames"]
    one = f.groupBy("group_key").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("group_overlap").alias("rule"), F.col("group_key").cast("string").alias("subject"))
    two = v["v_rasters"].filter("raster_sha256 is not null").join(f.select("frame_id", "split"), "frame_id").groupBy("raster_sha256").agg(F.countDistinct("split").alias("n")).filter("n > 1").select(F.lit("duplicate_raster_across_splits").alias("rule"), F.col("raster_sha256").alias("subject"))
    three = f.filter("split = 'test'").join(v["v_gt"].select("frame_id", "gt_id"), "frame_id", "left").groupBy("survey_id").agg(F.count("gt_id").alias("n")).filter("n = 0").select(F.lit("test_without_positives").alias("rule"), F.col("survey_id").alias("subject"))
    four = f.filter("split in ('val', 'test') and dataset = '5-LOW'").select(F.lit("ineligible_in_evaluation").alias("rule"), F.col("frame_id").cast("string").alias("subject"))
    tile = F.when(F.col("tile_id") == 7, "test").otherwise(F.col("split"))
    five = v["v_det"].select("detection_id", "frame_id", "tile_id").join(f.select("frame_id", "split"), "frame_id").filter(tile != F.col("split")).select(F.lit("tile_split_differs").alias("rule"), F.col("detection_id").alias("subject"))
    six = j09(v).select(F.lit("near_duplicate_across_splits").alias("rule"), F.concat_ws("-", "a_id", "b_id").alias("subject"))
    return one.unionByName(two).unionByName(three).unionByName(four).unionByName(five).unionByName(six)


@register("A44_sibling_distribution", "SELECT split, siblings, count(*) AS parents FROM (SELECT split, group_key, count(*) AS siblings FROM v_frames GROUP BY split, group_key) AS g GROUP BY split, siblings")
def a44(v):
    return v["v_frames"].groupBy("split", "group_key").agg(F.count("*").alias("siblings")).groupBy("split", "siblings").agg(F.count("*").alias("parents"))


@register("A45_sample_strata_counts", "SELECT dataset, width, count(*) AS images, count(DISTINCT group_key) AS clusters, count(DISTINCT survey_id) AS surveys FROM v_frames GROUP BY dataset, width")
def a45(v):
    return v["v_frames"].groupBy("dataset", "width").agg(F.count("*").alias("images"), F.countDistinct("group_key").alias("clusters"), F.countDistinct("survey_id").alias("surveys"))


@register("A48_confidence_acceptance", "SELECT survey_id, max(evidence) - min(evidence) > 0.03 AS ranges, count(*) FILTER (WHERE round(0.70e0 + (0.90e0 - 0.70e0) / (1 + exp(-28e0 * (evidence - 0.3139777305538386e0))), 2) = 0.9) <= 2 AS few_at_top, count(DISTINCT category) = 5 AS all_classes FROM v_contacts GROUP BY survey_id")
def a48(v):
    shown = F.round(scores.display_confidence(F.col("evidence")), 2)
    return v["v_contacts"].groupBy("survey_id").agg((F.max("evidence") - F.min("evidence") > 0.03).alias("ranges"), (F.count_if(shown == 0.9) <= 2).alias("few_at_top"), (F.countDistinct("category") == 5).alias("all_classes"))


@register("P25_letterbox_size", "SELECT raw_class, s AS size, round(avg((x2 - x1) * s / 2500), 9) AS mean_width, round(avg(CASE WHEN least(x2 - x1, y2 - y1) * s / 2500 < 4 THEN 1e0 ELSE 0e0 END), 9) AS share_under_4, round(avg(CASE WHEN least(x2 - x1, y2 - y1) * s / 2500 < 8 THEN 1e0 ELSE 0e0 END), 9) AS share_under_8 FROM v_det, (VALUES (640), (768), (960)) AS z(s) GROUP BY raw_class, s")
def p25(v):
    d = v["v_det"].withColumn("size", F.explode(F.array(*map(F.lit, (640, 768, 960)))))
    scale = lambda x: x * F.col("size") / 2500
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return d.groupBy("raw_class", "size").agg(F.round(F.avg(scale(w)), 9).alias("mean_width"), *[F.round(F.avg((scale(F.least(w, h)) < px).cast("double")), 9).alias(f"share_under_{px}") for px in (4, 8)])


@register("P29_capability_gates", "SELECT dataset, bool_and(width >= 640) AS wide, bool_and(frame_id % 97 <> 0) AS nadir, count(*) AS frames FROM v_frames GROUP BY dataset")
def p29(v):
    return v["v_frames"].groupBy("dataset").agg(F.every(F.col("width") >= 640).alias("wide"), F.every(F.col("frame_id") % 97 != 0).alias("nadir"), F.count("*").alias("frames"))
