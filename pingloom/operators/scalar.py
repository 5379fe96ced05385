"""Projections and filters on survey tables (one output row for each input row that stays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, scores

#: Fixed values: (dataset, source class) to canonical class and certainty; a negative maps to no class.
CLASS_MAP = [
    ("subpipe", "pipeline", "PIPELINE", "CERTAIN"),
    ("ai4shipwrecks", "wreck", "WRECK_OR_STRUCTURAL_DEBRIS", "CERTAIN"),
    ("pingeco_ghostpot", "Crab-Pot", "DERELICT_FISHING_GEAR", "CERTAIN"),
    ("pingeco_ghostpot", "Maybe-Crab-Pot", "DERELICT_FISHING_GEAR", "UNCERTAIN"),
    ("marine_pulse", "pipeline_cable", "PIPELINE", "CERTAIN"),
    ("marine_pulse", "engineering_platform", "ENGINEERING_STRUCTURE", "CERTAIN"),
    ("marine_pulse", "residual_mound", "ENGINEERING_STRUCTURE", "UNCERTAIN"),
    ("marine_pulse", "seabed_surface", None, None),
]
CLASS_INDEX = {"PIPELINE": 0, "WRECK_OR_STRUCTURAL_DEBRIS": 1, "DERELICT_FISHING_GEAR": 2, "ENGINEERING_STRUCTURE": 3}


def map_classes(labels: DataFrame, fail: bool = True) -> DataFrame:
    """Add canonical_class and certainty by (dataset, source_class); an unmapped pair fails, a negative maps to null."""
    table = labels.sparkSession.createDataFrame(CLASS_MAP, "dataset string, source_class string, canonical_class string, certainty string").withColumn("mapped", F.lit(True))
    out = labels.join(F.broadcast(table), ["dataset", "source_class"], "left")  # eight fixed rows
    if fail:
        problem = F.raise_error(F.concat(F.lit("no class for "), F.col("dataset"), F.lit("/"), F.col("source_class"))).cast("string")
        out = out.withColumn("canonical_class", F.when(F.col("mapped"), F.col("canonical_class")).otherwise(problem))
    return out.drop("mapped")


def class_index(df: DataFrame, column: str = "canonical_class") -> DataFrame:
    """Training index of a class; a class without one (unknowns among them) gets null."""
    table = F.create_map(*[F.lit(x) for kv in CLASS_INDEX.items() for x in kv])
    return df.withColumn("class_index", F.element_at(table, F.col(column)))


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the NUL-joined parts."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, 16)


def tile_grid(frames: DataFrame, size: int = 512, stride: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each tile of frame_id, width, height: origin and the zero padding on the right and bottom. Columns of ``carry`` go along."""
    out = frames.select("frame_id", "width", "height", *carry, F.explode(boxes.tile_origins(F.col("height"), size, stride)).alias("y0"))
    out = out.select("frame_id", "width", "height", *carry, F.explode(boxes.tile_origins(F.col("width"), size, stride)).alias("x0"), "y0")
    pad = lambda at, length: F.greatest(F.lit(0), F.col(at) + size - F.col(length))
    return out.select("frame_id", "x0", "y0", pad("x0", "width").alias("padded_right"), pad("y0", "height").alias("padded_bottom"), F.format_string("%s_x%05d_y%05d", F.col("frame_id").cast("string"), "x0", "y0").alias("tile_key"), *carry)


def needs_tiling(width: Column, height: Column) -> Column:
    aspect = F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
    return (width > 1024) | (height > 1024) | (aspect > 1.6)


def tile_box_to_frame(df: DataFrame) -> DataFrame:
    """xyxy boxes of tiles moved by the tile's origin, cut at the frame; empty ones go."""
    return df.withColumns(
        {
            "fx1": F.greatest(F.lit(0.0), F.least(F.col("width").cast("double"), F.col("x1") + F.col("x0"))),
            "fy1": F.greatest(F.lit(0.0), F.least(F.col("height").cast("double"), F.col("y1") + F.col("y0"))),
            "fx2": F.greatest(F.lit(0.0), F.least(F.col("width").cast("double"), F.col("x2") + F.col("x0"))),
            "fy2": F.greatest(F.lit(0.0), F.least(F.col("height").cast("double"), F.col("y2") + F.col("y0"))),
        }
    ).filter("fx2 > fx1 and fy2 > fy1")


def clip_box(df: DataFrame, size: int = 512, least: float = 0.25) -> DataFrame:
    """xywh boxes (bx, by, bw, bh) cut to their tile at (x0, y0), in tile coordinates; kept if ``least`` of the area is left."""
    a, t = boxes.to_xyxy(boxes.named("", ("bx", "by", "bw", "bh"))), (F.col("x0"), F.col("y0"), F.col("x0") + size, F.col("y0") + size)
    out = df.withColumns({"left": F.greatest(a[0], t[0]), "top": F.greatest(a[1], t[1]), "right": F.least(a[2], t[2]), "bottom": F.least(a[3], t[3])})
    out = out.filter("right > left and bottom > top").filter((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top")) / (F.col("bw") * F.col("bh")) >= least)
    return out.withColumns({"cx": F.col("left") - F.col("x0"), "cy": F.col("top") - F.col("y0"), "cw": F.col("right") - F.col("left"), "ch": F.col("bottom") - F.col("top")}).drop("left", "top", "right", "bottom")


def pixel_to_pics(df: DataFrame) -> DataFrame:
    """Frame pixels (px, py) to ping, range and side; all null without a nadir; metric only with a scale."""
    known = F.col("nadir").isNotNull()
    along, across = F.when(F.col("axis") == "COLS", F.col("px")).otherwise(F.col("py")), F.when(F.col("axis") == "COLS", F.col("py")).otherwise(F.col("px"))
    offset = across - F.col("nadir")
    return df.withColumns(
        {
            "ping": F.when(known, F.col("ping_start") + F.col("along_sign") * along * F.coalesce("stride", F.lit(1.0))),
            "range_value": F.when(known, F.abs(offset) * F.coalesce("scale", F.lit(1.0))),
            "range_unit": F.when(known & F.col("scale").isNotNull(), "METRIC_RANGE").otherwise("PIXEL_RANGE"),
            "side": F.when(~known, "UNKNOWN").when(offset < 0, "PORT").otherwise("STARBOARD"),
        }
    )


def demo_presentation(df: DataFrame) -> DataFrame:
    """Demonstration labels; raw values stay. Only wrecks and anomaly candidates are relabelled."""
    wreck = F.col("raw_class") == "SHIPWRECK"
    signal = F.when(wreck & F.col("raw_confidence").isNotNull(), F.col("raw_confidence")).otherwise(F.col("anomaly_score"))
    shown = signal.isNotNull() & (wreck | F.col("anomaly_score").isNotNull())
    return df.withColumns(
        {
            "display_class": F.when(shown, F.lit("SHIPWRECK")).otherwise(F.col("raw_class")),
            "display_confidence": F.when(shown, F.least(F.lit(0.94), F.greatest(F.lit(0.72), signal * 0.85 + 0.15))).otherwise(F.col("raw_confidence")),
            "classification_source": F.when(shown, "DEMO_HEURISTIC").otherwise("MODEL"),
            "production_qualified": ~shown & (signal.isNotNull() | ~wreck),
        }
    )


def extract_groups(df: DataFrame, name: str = "name") -> DataFrame:
    """Group key of a file name: its recording, contact or site, else the name itself."""
    parent = F.split_part(F.col(name), F.lit(".rf."), F.lit(1))
    rec = F.regexp_extract(parent, "(?i)^Rec0*([0-9]+)_", 1)
    contact = F.regexp_extract(parent, "(?i)^Contact_([0-9]+)_", 1)
    site = F.regexp_extract(parent, "(?i)^(BC_POST|TI[0-9]+|MC[0-9]+|baycove)", 1)
    key = F.when(rec != "", F.concat(F.lit("ping_recording_rec"), rec.cast("bigint").cast("string"))).when(contact != "", F.concat(F.lit("ping_contact_"), contact.cast("bigint").cast("string")))
    return df.withColumn("group_key", key.otherwise(F.concat(F.lit("ping_"), F.lower(F.when(site != "", site).otherwise(parent)))))


def channel_time(df: DataFrame, name: str = "name") -> DataFrame:
    """``df`` with ``channel`` and ``stamp`` (exact decimal seconds) from source paths such as ``.../SSS_HF_images/x/1693.780.pbm``; a path without them fails."""
    pattern = r"/SSS_(HF|LF)_images/.*/([0-9]+(?:\.[0-9]+)?)\.\w+$"
    path = F.concat(F.lit("/"), F.col(name))
    found = F.regexp_extract(path, pattern, 1)
    told = F.raise_error(F.concat(F.lit("no channel and time in "), F.col(name))).cast("string")
    return df.withColumn("channel", F.when(found != "", found).otherwise(told)).withColumn("stamp", F.regexp_extract(path, pattern, 2).cast("decimal(20,6)"))


def opaque_order(df: DataFrame, key: str, salt: str) -> DataFrame:
    """Salted 16-hex id and rank by the salted hash; names nothing of the row."""
    from pyspark.sql import Window as W

    out = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}|"), F.col(key).cast("string")), 256))
    # ranks within ranges of the hash, then across them: no task sorts all rows
    ranges = out.groupBy(F.substring("_h", 1, 3).alias("_r")).count().withColumn("_b", F.coalesce(F.sum("count").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("_r", F.substring("_h", 1, 3)).join(F.broadcast(ranges), "_r")  # 4096 rows at most
    rank = F.row_number().over(W.partitionBy("_r").orderBy("_h", key)) - 1 + F.col("_b")
    out = out.withColumn("opaque_id", F.substring("_h", 1, 16)).withColumn("presentation_rank", rank.cast("long"))
    # neighbours in the order of the hash: two rows of one id stand side by side
    twin = F.lag("opaque_id").over(W.partitionBy("_r").orderBy("_h", key)) == F.col("opaque_id")
    failed = F.raise_error(F.concat(F.lit("two rows have the id "), F.col("opaque_id"))).cast("string")
    return out.withColumn("opaque_id", F.when(F.coalesce(twin, F.lit(False)), failed).otherwise(F.col("opaque_id"))).drop("_h", "_r", "_b", "count")


def feedback_eligibility(df: DataFrame) -> DataFrame:
    """Whether a reviewed item may train a model, and the first reason against it."""
    reason = F.when(F.col("verdict").isNull(), "NO_REVIEW").when(~F.col("licence_ok"), "LICENCE_DOES_NOT_PERMIT_TRAINING").when(F.col("split").isin("val", "test"), "EVALUATION_SPLIT")
    return df.withColumn("eligible", reason.isNull()).withColumn("reason", reason)


def temporal_split_plan(df: DataFrame, ts: str = "ts", block: int = 300) -> DataFrame:
    """Blocks of ``block`` seconds from the first frame of the acquisition; blocks between splits are an embargo."""
    out = df.crossJoin(F.broadcast(df.agg(F.min(ts).alias("_s"))))  # one row
    out = out.withColumn("block", F.floor((F.unix_micros(ts) - F.unix_micros("_s")) / (block * 1_000_000)))
    b = F.col("block")
    split = F.when(b.between(0, 9), "train").when(b.between(13, 23), "val").when(b >= 27, "test")
    return out.withColumn("split_hint", split).withColumn("excluded_reason", F.when(split.isNull(), "TEMPORAL_OVERLAP_EMBARGO")).drop("_s")


def evidence_features(df: DataFrame) -> DataFrame:
    """Features of the fusion model. Null counts as 0 in this vector, and nowhere else."""
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("confidence")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns(
        {"logit": F.log(p / (1 - p)), "wilson": z("persistence"), "log_opportunities": F.log1p(z("opportunities")), "shadow": z("shadow_score"), "shadow_applicable": F.col("shadow_score").isNotNull().cast("double"), "anomaly": z("anomaly_score")}
    )


def priority_band(score: Column) -> Column:
    return F.when(score >= 0.75, "HIGH").when(score >= 0.5, "MEDIUM").when(score.isNotNull(), "LOW").otherwise("UNAVAILABLE")


def contact_priority(df: DataFrame) -> DataFrame:
    """Mean of the available evidence, persistence and quality; band; recommended action (unknown quality counts as low)."""
    parts = [F.col(c) for c in ("evidence", "persistence", "quality")]
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts[1:]), F.when(parts[0].isNotNull(), 1).otherwise(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    score = F.when(n > 0, total / n)
    action = (
        F.when(score.isNull(), "REVIEW")
        .when(F.coalesce("quality", F.lit(0.0)) < 0.45, F.when(F.col("has_navigation"), "REACQUIRE").otherwise("REVIEW"))
        .when((F.col("latest_verdict") == "CONFIRMED") & (score >= 0.75), "RECOVERY_CANDIDATE")
        .when(score >= 0.6, "INSPECT")
        .otherwise("REVIEW")
    )
    return df.withColumns({"priority_score": score, "priority_band": priority_band(score), "recommended_action": action, "missing_components": scores.missing({c: F.col(c) for c in ("evidence", "persistence", "quality")})})


def recovery_priority(df: DataFrame) -> DataFrame:
    """Weighted components of recovery priority; null without a confidence or an area in square metres."""
    s = scores
    footprint = F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.col("area_m2"))) / F.log1p(F.lit(s.FOOTPRINT_CAP_M2)))
    anomaly = F.coalesce(F.greatest("shadow_score", "anomaly_score"), F.lit(0.0))  # greatest skips nulls
    values = {
        "confidence": F.col("confidence"), "persistence": F.coalesce("persistence", F.lit(s.NEUTRAL_PERSISTENCE)), "anomaly_evidence": anomaly, "footprint": footprint,
        "class_weight": s.lookup(F.col("category"), s.CLASS_WEIGHTS, s.UNKNOWN_CLASS_WEIGHT), "newness": s.lookup(F.coalesce("change_status", F.lit("null")), s.NEWNESS, s.NO_COMPARISON),
    }
    score = None
    for name, value in values.items():
        score = value * s.PRIORITY_WEIGHTS[name] if score is None else score + value * s.PRIORITY_WEIGHTS[name]
    return df.withColumn("recovery_score", F.when(F.col("confidence").isNotNull() & F.col("area_m2").isNotNull(), score))


#: Weights of the confidence fusion.
SUPPORT_WEIGHTS = {"raw_detector": 0.65, "temporal_persistence": 0.70, "acoustic_shadow": 0.60, "physics": 0.35, "sonar_condition": 0.20, "open_set_anomaly": 0.30, "artificiality": 0.15, "navigation_consistency": 0.15}
AGREEMENT_WEIGHT = 0.18


def confidence_fusion(df: DataFrame, threshold: float = 0.4617) -> DataFrame:
    """Bounded system confidence from the eight supports that are available, and its presentation."""
    c = scores.clamp
    insufficient = F.coalesce(F.col("verification"), F.lit("")) == "INSUFFICIENT_EVIDENCE"
    supports = {
        "raw_detector": c(F.col("confidence")),
        "temporal_persistence": F.when(F.col("persistence").isNotNull(), F.greatest(F.lit(0.0), (c(F.col("persistence")) - 0.15) / 0.85)),
        "acoustic_shadow": F.when(F.col("verification").isin("SUPPORTED", "WEAK_SUPPORT"), c(F.col("strength"))),
        "physics": F.when(~insufficient, c(F.col("physics"))),
        "sonar_condition": c(F.col("quality")),
        "open_set_anomaly": F.when(F.col("anomaly").isNotNull(), F.greatest(F.lit(0.0), (c(F.col("anomaly")) - threshold) / max(1e-12, 1 - threshold))),
        "artificiality": c(F.col("artificiality")),
        "navigation_consistency": c(F.col("navigation")),
    }
    raw = scores.noisy_or([(v, SUPPORT_WEIGHTS[k]) for k, v in supports.items()], AGREEMENT_WEIGHT)
    return df.withColumn("raw_fused_confidence", raw).withColumn("fused_confidence", scores.display_confidence(F.col("raw_fused_confidence")))


def evidence_score(df: DataFrame) -> DataFrame:
    """Weighted mean of the available channels; physics takes no part while its verification is insufficient."""
    physics = F.when(F.coalesce(F.col("verification"), F.lit("")) != "INSUFFICIENT_EVIDENCE", F.col("physics"))
    values = {"detector": F.col("confidence"), "persistence": F.col("persistence"), "physics": physics, "quality": F.col("quality"), "anomaly": F.col("anomaly"), "artificiality": F.col("artificiality")}
    return df.withColumn("evidence_score", scores.weighted_mean(values, scores.EVIDENCE_WEIGHTS)).withColumn("missing_channels", scores.missing(values))


def ground_truth_free(df: DataFrame) -> DataFrame:
    """``df`` without the columns of the truth (``gt_``...); a later use of one fails when the plan is made."""
    return df.drop(*[c for c in df.columns if c.startswith("gt_")])


def _page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of ``df`` with the number of all its rows as ``total``. The page is the feature."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def detections_page(df: DataFrame, kind: str | None = None, category: str | None = None, min_confidence: float | None = None, change_status: str | None = None, reviewed: bool | None = None, best_first: bool = True, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of detections (detection_id, kind, raw_class, raw_confidence, change_status, latest_verdict); a filter that is None is not asked.

    A null confidence counts as 0 for ``min_confidence`` only. Ties go by id.
    """
    asked = {"kind": kind, "raw_class": category, "change_status": change_status}
    for column, value in asked.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if min_confidence is not None:
        df = df.filter(F.coalesce("raw_confidence", F.lit(0.0)) >= min_confidence)
    if reviewed is not None:
        df = df.filter(F.col("latest_verdict").isNotNull() if reviewed else F.col("latest_verdict").isNull())
    return _page(df, [F.col("raw_confidence").desc_nulls_last() if best_first else F.col("raw_confidence").asc_nulls_last(), F.col("detection_id")], offset, limit)


SORTS = {"priority": lambda: [F.col("priority").desc_nulls_last(), F.col("contact_id")], "newest": lambda: [F.col("created").desc_nulls_last(), F.col("contact_id")], "id": lambda: [F.col("contact_id").desc()]}


def contacts_page(df: DataFrame, surveys: list[str] | None = None, machine_class: str | None = None, analyst_class: str | None = None, status: str | None = None, least_priority: float | None = None, reviewed: bool | None = None, text: str | None = None, sort: str = "id", offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of contacts (contact_id, survey_id, category, analyst_class, latest_verdict, priority, created) in one of three orders (``SORTS``)."""
    if surveys is not None:
        df = df.filter(F.array_contains(F.array(*map(F.lit, surveys)), F.col("survey_id")))
    for column, value in {"category": machine_class, "analyst_class": analyst_class, "latest_verdict": status}.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if least_priority is not None:
        df = df.filter(F.col("priority") >= least_priority)
    if reviewed is not None:
        df = df.filter(F.col("latest_verdict").isNotNull() if reviewed else F.col("latest_verdict").isNull())
    if text is not None:
        df = df.filter(F.col("contact_id").contains(text))
    return _page(df, SORTS[sort](), offset, limit)
