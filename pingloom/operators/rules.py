"""Contracts, populations, splits and orders: rules over tables, with a row for each violation or membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from .ordered import numbered, ranked

#: What a record must not be, by the name of the rule. Records carry lists as text joined by commas.
CONTRACT = {
    "demo_has_banner": "is_demo AND coalesce(demo_banner, '') = ''",
    "unavailable_is_explicit": "NOT applicable AND (reason IS NULL OR channel_score IS NOT NULL)",
    "missing_metric_length_has_reason": "length_m IS NULL AND coalesce(length_reason, '') = ''",
    "coordinates_have_provenance": "lat IS NOT NULL AND geo_provenance = 'NONE'",
    "registered_features_only": "features <> '' AND size(array_except(split(contributions, ','), split(features, ','))) > 0",
    "unknown_is_unclassified": "kind = 'UNKNOWN' AND (category <> 'UNKNOWN_ANOMALY_CANDIDATE' OR class_confidence IS NOT NULL)",
    "known_is_classified": "kind = 'KNOWN' AND category = 'UNKNOWN_ANOMALY_CANDIDATE'",
    "demo_geolocation_needs_demo": "geo_provenance = 'DEMO_METADATA' AND NOT is_demo",
    "removed_requires_coverage": "status = 'REMOVED' AND NOT inside_new_coverage",
    "components_sum_to_score": "abs(component_sum - score) > 1e-8",
}


def contract_violations(records: DataFrame, key: str, rules: dict[str, str] | None = None) -> DataFrame:
    """``rule, key``: a row for each rule that a record breaks; a comparison with null breaks none. One scan for all rules."""
    hit = F.array_compact(F.array(*[F.when(F.expr(broken), F.lit(name)) for name, broken in (rules or CONTRACT).items()]))
    return records.select(F.explode(hit).alias("rule"), key)


def evaluation_populations(rows: DataFrame, representatives: DataFrame) -> DataFrame:
    """``image_id, population, role``: the overlapping populations of test rows (image_id, dataset, channel, split).

    A row that is not of the test split fails. Of the dataset with augmented variants, ``representatives``
    (image_id) are the primary population; one of them that is missing from the rows fails.
    """
    told = F.concat(F.lit("not a test row: "), F.col("image_id").cast("string"))
    tested = F.when(F.col("split").eqNullSafe(F.lit("test")), F.col("image_id")).otherwise(F.raise_error(told).cast("long"))
    rows = rows.withColumn("image_id", tested)
    reps = representatives.select("image_id").distinct()
    variants = rows.filter("dataset = 'VARIANTS'")
    here = reps.join(variants.select("image_id", F.lit(True).alias("_here")), "image_id", "left")
    gone = F.raise_error(F.concat(F.lit("a representative is missing: "), F.col("image_id").cast("string"))).cast("long")
    primary = here.select(F.when(F.col("_here"), F.col("image_id")).otherwise(gone).alias("image_id"))
    of = lambda df, population, role: df.select("image_id", F.lit(population).alias("population") if isinstance(population, str) else population.alias("population"), F.lit(role).alias("role"))
    tracks = rows.filter("dataset = 'TRACKS'")
    out = of(tracks, "TRACKS|ALL_TEST", "PRIMARY").unionByName(of(tracks.filter("channel IN ('HF', 'LF')"), F.concat(F.lit("TRACKS|"), "channel"), "CHANNEL_BREAKDOWN"))
    out = out.unionByName(of(rows.filter("dataset = 'FRAGMENTS'"), "FRAGMENTS|FRAGMENT_LEVEL", "PRIMARY"))
    out = out.unionByName(of(primary, "VARIANTS|ONE_PER_PARENT", "PRIMARY"))
    return out.unionByName(of(variants, "VARIANTS|ALL_VARIANTS", "SENSITIVITY"))


def population_metrics(populations: DataFrame, counts: DataFrame) -> DataFrame:
    """Metrics of each population, threshold and class from counts (image_id, tau, raw_class, tp, detections, gt); null without a denominator."""
    g = populations.join(counts, "image_id").groupBy("population", "tau", "raw_class").agg(*[F.sum(c).alias(c) for c in ("tp", "detections", "gt")])
    share = lambda n, d: F.round(F.expr(f"try_divide({n}, {d})"), 9)
    return g.withColumns({"fp": F.expr("detections - tp"), "fn": F.expr("gt - tp"), "precision": share("tp", "detections"), "recall": share("tp", "gt"), "precision_for_claims": F.col("detections") >= 30, "recall_for_claims": F.col("gt") >= 30})


def make_splits(frames: DataFrame, seed: int = 20260830) -> DataFrame:
    """``group_key, split``: whole groups of frames (group_key, hint, official) to splits.

    Hints come first, then official test groups; two hints, or two official splits, in a group fail. The other groups
    follow in seeded hash order: a fifth validates if some group is tested already, else about 70/15/15 by the
    number of groups, which fails below three.
    """
    one = lambda c: F.when(F.max(c) != F.min(c), F.raise_error(F.concat(F.lit(f"{c} conflicts in group "), F.first("group_key").cast("string"))).cast("string")).otherwise(F.max(c))
    g = frames.groupBy("group_key").agg(one("hint").alias("hint"), one("official").alias("official"))
    g = stored(g.withColumn("fixed", F.coalesce("hint", F.when(F.col("official") == "test", "test"))))
    fixed, loose = g.filter("fixed is not null"), g.filter("fixed is null")
    tested, n = not fixed.filter("fixed = 'test'").isEmpty(), loose.count()
    if not n:
        missing = {"train", "val", "test"} - {r.fixed for r in fixed.select("fixed").distinct().collect()}
        if missing and not fixed.isEmpty():
            raise ValueError(f"hints name no groups for {', '.join(sorted(missing))}")
        return fixed.select("group_key", F.col("fixed").alias("split"))
    if tested:
        cuts = [("val", max(1, round(n * 0.2)) if n > 2 else 0), ("train", n)]
    elif n < 3:
        raise ValueError("fewer than three groups for train, val and test")
    else:
        train, val = max(1, round(n * 0.70)), max(1, round(n * 0.15))
        train, val = (n - 2, 1) if train + val >= n else (train, val)
        cuts = [("train", train), ("val", train + val), ("test", n)]
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("group_key").cast("string")), 256)
    split = None
    for name, end in cuts:
        split = (F if split is None else split).when(F.col("place") <= end, F.lit(name))
    placed = numbered(loose.select("group_key", order.alias("h")), ["h", "group_key"], "place").select("group_key", split.alias("split"))
    return fixed.select("group_key", F.col("fixed").alias("split")).unionByName(placed)


def comparison_gates(surveys: DataFrame, pairs: DataFrame) -> DataFrame:
    """``new_id, baseline_id, gate, label, supported``: a row for each blocker of a comparison; one without is a supported pair.

    ``surveys``: survey_id, level (spatial reference), coverage (has a polygon). Comparing needs both surveys to be at
    L2 at least and to have a coverage polygon, and a baseline at all.
    """
    side = lambda label: surveys.select(F.col("survey_id").alias(f"{label}_id"), F.struct(F.col("level"), F.col("coverage")).alias(label))
    both = pairs.join(side("new"), "new_id", "left").join(side("baseline"), "baseline_id", "left")

    def gate(name: str, label: str, broken: Column) -> Column:
        return F.when(broken, F.struct(F.lit(name).alias("gate"), F.lit(label).alias("label")))

    blockers = [gate("BASELINE_SURVEY", "baseline", F.col("baseline").isNull())]
    for label in ("new", "baseline"):
        known = F.col(label).isNotNull()
        blockers.append(gate("SPATIAL_REFERENCE_LEVEL", label, known & ~F.coalesce(F.col(f"{label}.level").isin("L2_TRACK_RELATIVE", "L3_SURVEYED"), F.lit(False))))
        blockers.append(gate("COVERAGE_POLYGON", label, known & ~F.coalesce(F.col(f"{label}.coverage"), F.lit(False))))
    rows = both.select("new_id", "baseline_id", F.array_compact(F.array(*blockers)).alias("b"))
    return rows.select("new_id", "baseline_id", (F.size("b") == 0).alias("supported"), F.explode_outer("b").alias("x")).select("new_id", "baseline_id", "x.gate", "x.label", "supported")


def role_orders(contacts: DataFrame) -> DataFrame:
    """``role, contact_id, place``: contacts (contact_id, priority_rank, reviewed, track) in the order that each role works in.

    Analysts: not reviewed first, then priority; supervisors: priority, then reviewed first; field officers: along
    the track (contacts without a place last). Ties go by id.
    """
    reviewed = F.col("reviewed").cast("int")
    keys = {"analyst": (reviewed, F.col("priority_rank")), "supervisor": (F.col("priority_rank"), -reviewed), "field_officer": (F.coalesce("track", F.lit(1 << 53)), F.lit(0))}
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), a.cast("long").alias("a"), b.cast("long").alias("b")) for role, (a, b) in keys.items()]))
    rows = contacts.select("contact_id", each.alias("k")).select("contact_id", "k.*")
    return ranked(rows, ["role"], ["a", "b", "contact_id"], "place").select("role", "contact_id", "place")


def shared_rows(frames: DataFrame, rows: DataFrame) -> DataFrame:
    """``a_id, b_id, shared``: digests in common of neighbouring frames (a_id, b_id), 0 too; ``rows``: frame_id, digest.

    Only neighbours meet, so a digest that all frames hold costs no more than any other.
    """
    kept = rows.select("frame_id", "digest").distinct()
    one = frames.join(kept.withColumnRenamed("frame_id", "a_id"), "a_id").select("a_id", "b_id", "digest")
    met = one.join(kept.withColumnRenamed("frame_id", "b_id"), ["b_id", "digest"]).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    return frames.join(met, ["a_id", "b_id"], "left").select("a_id", "b_id", F.coalesce("shared", F.lit(0)).alias("shared"))


#: Frames of one digest that meet in one block.
BLOCK = 256


def sharing_frames(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a_id, b_id, shared``: all pairs of frames a_id < b_id with digests in common, and their number; ``rows``: frame_id, digest.

    The frames of a digest meet in pairs of blocks, each a key of its own, so no key has more than ``block`` frames on
    either side, however many frames hold a digest.
    """
    kept = rows.select("frame_id", "digest").filter("digest is not null").distinct()
    kept = kept.join(kept.groupBy("digest").agg(F.count(F.lit(1)).alias("frames")).filter("frames > 1"), "digest")
    kept = ranked(kept, ["digest"], ["frame_id"], "n").select("frame_id", "digest", F.expr(f"(n - 1) div {block}").alias("own"), F.expr(f"(frames - 1) div {block}").alias("last"))
    kept = stored(kept)  # both sides read it
    one = kept.select(F.col("frame_id").alias("a_id"), "digest", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"))
    two = kept.select(F.col("frame_id").alias("b_id"), "digest", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"))
    return one.join(two, ["digest", "i", "j"]).filter("a_id < b_id").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))


def snapshot_errors(tiles: DataFrame, boxes: DataFrame, frames: DataFrame, size: int = 512) -> DataFrame:
    """``subject, error``: what is wrong with a snapshot of tiles.

    ``tiles``: tile_key, frame_id, tile_w, tile_h, split, has_label; ``boxes``: tile_key, box_id, x, y, w, h on the tile;
    ``frames``: frame_id, split. A tile has the fixed size, a label file (empty or not) and the split of its frame; a
    box has an area and lies on its tile.
    """
    kinds = {
        "TILE_DIMENSIONS_INVALID": (F.col("tile_w") != size) | (F.col("tile_h") != size) | F.col("tile_w").isNull() | F.col("tile_h").isNull(),
        "MISSING_LABEL_FILE": ~F.coalesce("has_label", F.lit(False)),
        "SPLIT_INHERITANCE_VIOLATION": ~F.col("split").eqNullSafe(F.col("frame_split")),
    }
    held = tiles.join(frames.select("frame_id", F.col("split").alias("frame_split")).hint("shuffle_hash"), "frame_id", "left")  # frames grow with tiles: not sent to all tasks
    found = held.select(F.col("tile_key").alias("subject"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]))).alias("error"))
    wrong = "w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > {0} OR y + h > {0}".format(size)
    return found.unionByName(boxes.filter(wrong).select(F.concat_ws(":", "tile_key", "box_id").alias("subject"), F.lit("INVALID_CLIPPED_BOX").alias("error")))


def form_surveys(frames: DataFrame, declared: DataFrame, verified: DataFrame) -> DataFrame:
    """``frame_id, survey_ref, membership, navigation_provenance``: declared groups first, then verified ones, else a survey of its own.

    ``frames``: frame_id, provenance (declared for the frame, or null); ``declared``: frame_id, group_ref;
    ``verified``: frame_id, component. A survey has a provenance only if all its members declare the same one.
    """
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = frames.join(declared.select("frame_id", "group_ref"), "frame_id", "left").join(verified.select("frame_id", "component"), "frame_id", "left")
    ref = F.when(F.col("group_ref").isNotNull(), text("declared.", "group_ref")).when(F.col("component").isNotNull(), text("verified.", "component")).otherwise(text("singleton.", "frame_id"))
    kind = F.when(F.col("group_ref").isNotNull(), "DECLARED").when(F.col("component").isNotNull(), "VERIFIED").otherwise("SINGLETON")
    rows = rows.select("frame_id", ref.alias("survey_ref"), kind.alias("membership"), "provenance")
    agreed = F.when(F.every(F.col("provenance").isNotNull()) & (F.min("provenance") == F.max("provenance")), F.min("provenance"))
    return rows.join(rows.groupBy("survey_ref").agg(agreed.alias("navigation_provenance")), "survey_ref").select("frame_id", "survey_ref", "membership", "navigation_provenance")
