"""What is known of contacts from their member observations: looks, evidence, place, reports.

Members are rows (key, contact_no, member_no, detection_id, ...) as ``sequential.fuse_contacts`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTACT = ["key", "contact_no"]


def contact_ids(members: DataFrame) -> list[str]:
    """What tells contacts apart: also the block of members that are dealt out by it, so that they stay where they are."""
    return [*(["block"] if "block" in members.columns else []), *CONTACT]


USABLE = ("MEASURED", "SYNTHETIC_DEMO")


def look_persistence(members: DataFrame) -> DataFrame:
    """Looks of each contact from its members with ``rel``, their relation to the member before.

    ``key, contact_no, looks, window_duplicates, basis, evidence_type, consecutive, score``. Only where every member has
    a verified place on the ping axis do looks count as sequential: ``consecutive`` is then the length of the last run
    of windows that follow on one another, and the score grows with looks and run.
    """
    ids = contact_ids(members)
    order = W.partitionBy(*ids).orderBy("q_ping_start", "q_detection_id")
    breaks = F.when(F.lag("q_ping_end").over(order) + 1 == F.col("q_ping_start"), 0).otherwise(1)
    rows = members.withColumn("_break", breaks).withColumn("_run", F.sum("_break").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.max("_run").over(W.partitionBy(*ids)))
    g = rows.groupBy(*ids).agg(
        F.count("*").alias("n"), (1 + F.count_if(F.col("rel") == "INDEPENDENT_LOOKS_ALONG_TRACK")).alias("looks"), F.count_if(F.col("rel") != "TILE_OVERLAP_DUPLICATE").alias("other"),
        F.every(F.col("q_ping_start").isNotNull()).alias("placed"), F.count_if(F.col("_run") == F.col("_last")).alias("run"),
    )
    g = g.withColumn("consecutive", F.when(F.col("placed"), F.col("run")).otherwise(1)).withColumn("window_duplicates", F.col("n") - F.col("looks"))
    many = F.col("looks") > 1
    return g.select(
        *CONTACT, "looks", "window_duplicates",
        F.when(F.col("n") == 1, "SINGLE").when(many, "INDEPENDENT_LOOKS_ALONG_TRACK").when(F.col("other") == 0, "TILE_OVERLAP_DUPLICATE").otherwise("SAME_LOOK_OVERLAPPING_WINDOWS").alias("basis"),
        F.when(many & F.col("placed"), "SEQUENTIAL_PING").when(F.col("window_duplicates") > 0, "WINDOW_OVERLAP_ONLY").when(many, "UNKNOWN").otherwise("SINGLE_OBSERVATION").alias("evidence_type"),
        "consecutive", F.when(many & F.col("placed"), F.least(F.lit(1.0), 0.35 + 0.13 * F.col("looks") + 0.25 * F.col("consecutive") / F.col("looks"))).otherwise(0.15).alias("score"),
    )


def contact_enrich(members: DataFrame) -> DataFrame:
    """Evidence of each contact from that of its members.

    Members carry quality_score, quality_flags (array), nadir_overlap, pipeline_verification, open_set_status,
    anomaly_score and anomaly_threshold. Quality is their mean, flags their union; the first verification by member
    number stands; of the members with available open-set evidence the strongest one (the first of equals) gives the
    record, which stays null without any.
    """
    available = F.col("open_set_status") == "AVAILABLE"
    strongest = F.min_by(F.struct("detection_id", "anomaly_score", "anomaly_threshold"), F.when(available, F.struct((-F.coalesce("anomaly_score", F.lit(0.0))).alias("a"), "member_no")))
    g = members.groupBy(*contact_ids(members)).agg(
        F.avg("quality_score").alias("quality_score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))).alias("quality_flags"), F.max("nadir_overlap").alias("nadir_overlap"),
        F.min_by("pipeline_verification", F.when(F.col("pipeline_verification").isNotNull(), F.col("member_no"))).alias("pipeline_verification"), strongest.alias("open_set"),
    )
    found = F.col("open_set.anomaly_score")
    return g.select(*CONTACT, "quality_score", "quality_flags", "nadir_overlap", "pipeline_verification", F.col("open_set.detection_id").alias("open_set_detection"), found.alias("anomaly_score"), F.coalesce(found >= F.col("open_set.anomaly_threshold"), F.lit(False)).alias("is_open_set_candidate"))


def contact_views(members: DataFrame, designated: DataFrame | None = None) -> DataFrame:
    """``key, contact_no, representative, n``: the designated (a column of members, or a table by contact) observation if it is a member, else the member of highest finite confidence, else the first."""
    finite = F.col("raw_confidence").isNotNull() & ~F.isnan("raw_confidence") & (F.abs("raw_confidence") < float("inf"))
    rank = F.struct(F.when(F.col("detection_id") == F.col("designated"), 0).when(finite, 1).otherwise(2).alias("kind"), F.when(finite, -F.col("raw_confidence")).otherwise(0.0).alias("c"), "member_no")
    rows = members if designated is None else members.join(designated, CONTACT, "left")
    return rows.groupBy(*contact_ids(rows)).agg(F.min_by("detection_id", rank).alias("representative"), F.count("*").alias("n")).select(*CONTACT, "representative", "n")


def platform_fixes(nav: DataFrame) -> DataFrame:
    """Usable fixes (with coordinates and a provenance for display) as map rows: the platform's place, never a contact's."""
    usable = nav.filter(F.col("provenance").isin(*USABLE) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    kind = F.when(F.col("provenance") == "MEASURED", "UPLOADER_DECLARATION_ONLY").otherwise("DISPLAY_ONLY_NOT_EVIDENCE")
    return usable.select(F.lit("PLATFORM_FIX_NOT_CONTACT_LOCATION").alias("role"), "survey_ref", F.col("frame_id").cast("string").alias("ref"), "longitude", "latitude", "provenance", kind.alias("verification"))


def contact_features(contacts: DataFrame, demo: bool = False) -> DataFrame:
    """Map rows of the contacts whose navigation evidence is AVAILABLE; synthetic geometry outside of a demo fails."""
    refused = F.when((F.col("provenance") == "SYNTHETIC_DEMO") & F.lit(not demo), F.raise_error("synthetic geometry refused").cast("string")).otherwise(F.lit("CONTACT"))
    return contacts.filter("navigation_status = 'AVAILABLE'").select(refused.alias("role"), "survey_ref", F.col("contact_id").alias("ref"), "longitude", "latitude", "provenance", F.lit("EVIDENCE").alias("verification"))


def geojson(rows: DataFrame) -> DataFrame:
    """A GeoJSON feature as text for each map row, beside its role and survey: the sink partitions by them, so no collection is held whole."""
    point = F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct("role", "ref", "survey_ref", "provenance", "verification").alias("properties"))
    return rows.select("role", "survey_ref", F.to_json(feature).alias("value"))


def place_contacts(members: DataFrame, own: DataFrame, fixes: DataFrame) -> DataFrame:
    """``key, contact_no, longitude, latitude, basis, frame_id, fan``: a contact's own position, else that of its first member whose frame has a fix.

    Contacts without either are left out. ``fan`` counts the contacts that share a fix, in the order of their names;
    own positions have 0.
    """
    placed = members.select(*CONTACT, "member_no", "frame_id").join(fixes.select("frame_id", F.col("longitude").alias("_lon"), F.col("latitude").alias("_lat")), "frame_id")
    first = placed.groupBy(*CONTACT).agg(F.min_by(F.struct("frame_id", "_lon", "_lat"), "member_no").alias("f"))
    by_fix = first.join(own, CONTACT, "left_anti").select(*CONTACT, F.col("f._lon").alias("longitude"), F.col("f._lat").alias("latitude"), F.lit("frame").alias("basis"), F.col("f.frame_id").alias("frame_id"))
    by_fix = by_fix.withColumn("fan", F.row_number().over(W.partitionBy("frame_id").orderBy(*CONTACT)) - 1)  # the contacts of a frame
    lead = members.groupBy(*CONTACT).agg(F.min_by("frame_id", "member_no").alias("frame_id"))
    recorded = own.join(lead, CONTACT).select(*CONTACT, "longitude", "latitude", F.lit("recorded").alias("basis"), "frame_id", F.lit(0).alias("fan"))
    return recorded.unionByName(by_fix)


def survey_columns(rows: DataFrame, id_columns: list[str], surveys: DataFrame) -> DataFrame:
    """Survey columns of report rows: ``rows`` (ids, place, survey_ref) name the surveys of each row's frames in order.

    One survey gives its values; of several, each is listed once in the order of its first frame, joined by pipes
    and aligned across the columns (a null provenance is an empty entry); none gives nulls.
    """
    columns = ("survey_ref", "membership_provenance", "navigation_provenance")
    met = rows.filter("survey_ref is not null").groupBy(*id_columns, "survey_ref").agg(F.min("place").alias("place")).join(surveys.select(*columns), "survey_ref")
    listed = met.groupBy(*id_columns).agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("s"))

    def joined(c: str) -> Column:
        return F.when(F.size("s") == 1, F.col("s")[0][c]).otherwise(F.array_join(F.transform("s", lambda x: F.coalesce(x[c], F.lit(""))), "|"))

    return listed.select(*id_columns, *[joined(c).alias(c) for c in columns])
