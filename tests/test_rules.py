"""Rules over tables: contracts, populations, splits, gates, orders, contacts on the map and in reports."""

import pytest

from pingloom.operators import contacts, rules


def test_contract_rules_name_what_is_broken(spark):
    good = dict(is_demo=False, demo_banner=None, applicable=True, reason=None, channel_score=0.5, length_m=1.0, length_reason=None, lat=None, geo_provenance="NONE", features="a,b", contributions="b", kind="KNOWN", category="PIPELINE", class_confidence=0.5, status="NEW", inside_new_coverage=False, component_sum=0.5, score=0.5)
    broken = {
        "demo_has_banner": dict(is_demo=True, demo_banner=""), "unavailable_is_explicit": dict(applicable=False), "missing_metric_length_has_reason": dict(length_m=None), "coordinates_have_provenance": dict(lat=1.0),
        "registered_features_only": dict(contributions="b,c"), "unknown_is_unclassified": dict(kind="UNKNOWN", category="UNKNOWN_ANOMALY_CANDIDATE"), "known_is_classified": dict(category="UNKNOWN_ANOMALY_CANDIDATE"),
        "demo_geolocation_needs_demo": dict(geo_provenance="DEMO_METADATA"), "removed_requires_coverage": dict(status="REMOVED"), "components_sum_to_score": dict(score=0.6),
    }
    rows = [("good", *good.values())] + [(name, *{**good, **change}.values()) for name, change in broken.items()] + [("explicit", *{**good, "applicable": False, "reason": "none", "channel_score": None}.values())]
    kinds = ["boolean", "string", "boolean", "string", "double", "double", "string", "double", "string", "string", "string", "string", "string", "double", "string", "boolean", "double", "double"]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} {k}" for c, k in zip(good, kinds)))
    assert sorted((r.rule, r.id) for r in rules.contract_violations(df, "id").collect()) == sorted((n, n) for n in broken)
    assert rules.contract_violations(df.limit(0), "id").collect() == []


def test_populations_refuse_other_splits_and_missing_representatives(spark):
    schema = "image_id long, dataset string, channel string, split string"
    rows = [(1, "TRACKS", "HF", "test"), (2, "TRACKS", None, "test"), (3, "FRAGMENTS", None, "test"), (4, "VARIANTS", None, "test"), (5, "VARIANTS", None, "test")]
    df, reps = spark.createDataFrame(rows, schema), spark.createDataFrame([(5,)], "image_id long")
    got = sorted((r.image_id, r.population) for r in rules.evaluation_populations(df, reps).collect())
    assert got == [(1, "TRACKS|ALL_TEST"), (1, "TRACKS|HF"), (2, "TRACKS|ALL_TEST"), (3, "FRAGMENTS|FRAGMENT_LEVEL"), (4, "VARIANTS|ALL_VARIANTS"), (5, "VARIANTS|ALL_VARIANTS"), (5, "VARIANTS|ONE_PER_PARENT")]
    with pytest.raises(Exception, match="not a test row: 9"):
        rules.evaluation_populations(df.unionByName(spark.createDataFrame([(9, "TRACKS", None, "val")], schema)), reps).collect()
    with pytest.raises(Exception, match="representative is missing: 7"):
        rules.evaluation_populations(df, spark.createDataFrame([(7,)], "image_id long")).collect()
    counts = spark.createDataFrame([(1, 0.5, "P", 1, 2, 0)], "image_id long, tau double, raw_class string, tp long, detections long, gt long")
    (r,) = rules.population_metrics(rules.evaluation_populations(df, reps).filter("population = 'TRACKS|HF'"), counts).collect()
    assert (r.precision, r.recall, r.fp, r.precision_for_claims) == (0.5, None, 1, False)


def test_splits_of_whole_groups(spark):
    schema = "group_key long, hint string, official string"
    split = lambda rows: {r.group_key: r.split for r in rules.make_splits(spark.createDataFrame(rows, schema)).collect()}
    free = [(k, None, None) for k in range(20)]
    got = split(free)
    assert sorted(got.values()).count("train") == 14 and sorted(got.values()).count("val") == 3 and sorted(got.values()).count("test") == 3
    assert split(free) == got
    tested = split([*free, (50, None, "test"), (51, "val", "test"), (52, None, "train")])
    assert tested[50] == "test" and tested[51] == "val" and "test" not in {tested[k] for k in range(20)} | {tested[52]} and list(tested.values()).count("val") == 1 + 4
    assert set(split([(1, None, None), (2, None, None), (3, None, None)]).values()) == {"train", "val", "test"}
    with pytest.raises(ValueError, match="fewer than three"):
        split([(1, None, None), (2, None, None)])
    with pytest.raises(Exception, match="hint conflicts in group 1"):
        split([(1, "val", None), (1, "test", None), *free[2:]])
    with pytest.raises(ValueError, match="no groups for val"):
        split([(1, "train", None), (2, "test", None)])
    assert split([]) == {}


def test_gates_list_each_blocker(spark):
    s = spark.createDataFrame([("a", "L2_TRACK_RELATIVE", True), ("b", "L1_FRAME_RELATIVE", False), ("c", None, True)], "survey_id string, level string, coverage boolean")
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "zz")], "new_id string, baseline_id string")
    got = sorted((r.new_id, r.baseline_id, r.gate or "", r.label or "", r.supported) for r in rules.comparison_gates(s, pairs).collect())
    assert got == [("a", "a", "", "", True), ("a", "b", "COVERAGE_POLYGON", "baseline", False), ("a", "b", "SPATIAL_REFERENCE_LEVEL", "baseline", False), ("c", "zz", "BASELINE_SURVEY", "baseline", False), ("c", "zz", "SPATIAL_REFERENCE_LEVEL", "new", False)]


def test_roles_see_contacts_in_their_own_order(spark):
    c = spark.createDataFrame([("x", 1, True, 5), ("y", 0, True, None), ("z", 1, False, 2)], "contact_id string, priority_rank int, reviewed boolean, track long")
    got = {}
    for r in rules.role_orders(c).orderBy("place").collect():
        got.setdefault(r.role, []).append(r.contact_id)
    assert got == {"analyst": ["z", "y", "x"], "supervisor": ["y", "x", "z"], "field_officer": ["z", "x", "y"]}


def test_neighbours_alone_are_compared(spark):
    rows = spark.createDataFrame([(1, "blank"), (1, "p"), (2, "blank"), (2, "p"), (2, "p"), (3, "q"), (4, "blank")], "frame_id long, digest string")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a_id long, b_id long")
    assert sorted(tuple(r) for r in rules.shared_rows(pairs, rows).collect()) == [(1, 2, 2), (2, 3, 0), (3, 4, 0)]


MEMBERS = "key string, contact_no int, member_no int, detection_id string, frame_id long, raw_confidence double"


def test_views_take_the_designated_member_then_the_surest_finite_one(spark):
    nan = float("nan")
    m = spark.createDataFrame([("k", 1, 0, "a", 1, 0.2), ("k", 1, 1, "b", 1, 0.9), ("k", 2, 0, "c", 1, nan), ("k", 2, 1, "d", 2, 0.1), ("k", 3, 0, "e", 1, None), ("k", 3, 1, "f", 1, nan)], MEMBERS)
    d = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, contact_no int, designated string")
    assert {(r.contact_no, r.representative, r.n) for r in contacts.contact_views(m, d).collect()} == {(1, "a", 2), (2, "d", 2), (3, "e", 2)}


def test_contacts_are_placed_by_themselves_or_by_their_first_fix(spark):
    m = spark.createDataFrame([("k", 1, 0, "a", 1, 0.2), ("k", 2, 0, "b", 9, 0.2), ("k", 2, 1, "c", 2, 0.2), ("k", 3, 0, "d", 2, 0.2), ("k", 4, 0, "e", 9, 0.2)], MEMBERS)
    own = spark.createDataFrame([("k", 1, 7.0, 8.0)], "key string, contact_no int, longitude double, latitude double")
    fixes = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "frame_id long, longitude double, latitude double")
    got = sorted((r.contact_no, r.longitude, r.basis, r.frame_id, r.fan) for r in contacts.place_contacts(m, own, fixes).collect())
    assert got == [(1, 7.0, "recorded", 1, 0), (2, 3.0, "frame", 2, 0), (3, 3.0, "frame", 2, 1)]


def test_map_rows_keep_contacts_and_platform_apart(spark):
    nav = spark.createDataFrame([("s", 1, 1.0, 2.0, "MEASURED"), ("s", 2, None, 2.0, "MEASURED"), ("s", 3, 1.0, 2.0, None), ("s", 4, 1.0, 2.0, "SYNTHETIC_DEMO")], "survey_ref string, frame_id long, longitude double, latitude double, provenance string")
    assert {(r.ref, r.verification) for r in contacts.platform_fixes(nav).collect()} == {("1", "UPLOADER_DECLARATION_ONLY"), ("4", "DISPLAY_ONLY_NOT_EVIDENCE")}
    schema = "survey_ref string, contact_id string, longitude double, latitude double, provenance string, navigation_status string"
    real = spark.createDataFrame([("s", "c1", 1.0, 2.0, "MEASURED", "AVAILABLE"), ("s", "c2", 1.0, 2.0, "SYNTHETIC_DEMO", "UNAVAILABLE")], schema)
    assert [(r.role, r.ref) for r in contacts.contact_features(real).collect()] == [("CONTACT", "c1")]
    made = spark.createDataFrame([("s", "c1", 1.0, 2.0, "SYNTHETIC_DEMO", "AVAILABLE")], schema)
    assert contacts.contact_features(made, demo=True).count() == 1
    with pytest.raises(Exception, match="refused"):
        contacts.contact_features(made).collect()
    text = contacts.geojson(contacts.contact_features(real)).first().value
    assert '"coordinates":[1.0,2.0]' in text and '"type":"Feature"' in text


def test_survey_columns_align_their_lists(spark):
    surveys = spark.createDataFrame([("a", "VERIFIED", None), ("b", "DECLARED", "MEASURED")], "survey_ref string, membership_provenance string, navigation_provenance string")
    rows = spark.createDataFrame([(1, 3, "a"), (1, 1, "b"), (1, 2, "b"), (2, 1, "a"), (3, 1, None), (4, 1, "unknown")], "id long, place int, survey_ref string")
    got = {r.id: tuple(r)[1:] for r in contacts.survey_columns(rows, ["id"], surveys).collect()}
    assert got == {1: ("b|a", "DECLARED|VERIFIED", "MEASURED|"), 2: ("a", "VERIFIED", None)}


def test_evidence_of_members_becomes_that_of_the_contact(spark):
    schema = MEMBERS + ", quality_score double, quality_flags array<string>, nadir_overlap double, pipeline_verification string, open_set_status string, anomaly_score double, anomaly_threshold double"
    rows = [("k", 1, 0, "a", 1, 0.5, 0.2, ["B"], None, None, "UNAVAILABLE", 0.99, 0.7), ("k", 1, 1, "b", 1, 0.5, 0.4, ["A", "B"], 1.0, "second", "AVAILABLE", 0.8, 0.7), ("k", 1, 2, "c", 1, 0.5, None, [], 0.0, "third", "AVAILABLE", 0.8, 0.7), ("k", 2, 0, "d", 1, 0.5, None, [], None, None, "UNAVAILABLE", 0.9, 0.7)]
    got = {r.contact_no: r for r in contacts.contact_enrich(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].quality_score == pytest.approx(0.3) and got[1].quality_flags == ["A", "B"] and got[1].nadir_overlap == 1.0 and got[1].pipeline_verification == "second"
    assert (got[1].open_set_detection, got[1].is_open_set_candidate) == ("b", True)
    assert (got[2].quality_score, got[2].quality_flags, got[2].anomaly_score, got[2].is_open_set_candidate) == (None, [], None, False)


def test_looks_count_only_on_a_verified_axis(spark):
    schema = "key string, contact_no int, member_no int, rel string, q_ping_start long, q_ping_end long, q_detection_id string"
    look, overlap = "INDEPENDENT_LOOKS_ALONG_TRACK", "SAME_LOOK_OVERLAPPING_WINDOWS"
    rows = [("k", 1, 0, None, 0, 9, "a"), ("k", 1, 1, look, 10, 19, "b"), ("k", 1, 2, look, 20, 29, "c"), ("k", 2, 0, None, 0, 9, "a"), ("k", 2, 1, overlap, 5, 14, "b"), ("k", 3, 0, None, None, None, "a"), ("k", 3, 1, "TILE_OVERLAP_DUPLICATE", None, None, "b"), ("k", 4, 0, None, 3, 5, "z")]
    got = {r.contact_no: tuple(r)[2:] for r in contacts.look_persistence(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (3, 0, look, "SEQUENTIAL_PING", 3, pytest.approx(0.35 + 0.39 + 0.25))
    assert got[2] == (1, 1, overlap, "WINDOW_OVERLAP_ONLY", 1, 0.15)
    assert got[3] == (1, 1, "TILE_OVERLAP_DUPLICATE", "WINDOW_OVERLAP_ONLY", 1, 0.15)
    assert got[4] == (1, 0, "SINGLE", "SINGLE_OBSERVATION", 1, 0.15)


def test_written_rasters_are_read_back(spark, tmp_path):
    from pingloom.sources import files

    rows = [("a.png", 2, 2, 1, [0, 255, 7, 8], False), ("b.png", 1, 2, 3, [1, 2, 3, 4, 5, 6], False), ("c.png", 2, 2, 1, [0, 1, 2, 3], True)]
    path = f"file://{tmp_path}/rasters"
    assert files.write_rasters(spark.createDataFrame(rows, "name string, width int, height int, channels int, samples array<int>, damaged boolean"), path) == 3
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.channels, r.identity == r.raster_sha256) for r in files.scan_rasters(spark, path).collect()}
    assert got["a.png"] == (2, 2, 1, True) and got["b.png"] == (1, 2, 3, True) and got["c.png"][:3] == (None, None, None)
    lines = {(r.frame, r.row_idx): r.samples for r in files.explode_ping_rows(spark, path).collect()}
    assert lines == {("a.png", 0): [0, 255], ("a.png", 1): [7, 8], ("b.png", 0): [3], ("b.png", 1): [6]}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_groups_are_assigned_alike_in_any_chunks(spark, chunk):
    import hashlib
    import random

    from pingloom.operators import sequential

    rng = random.Random(9)
    sizes = {k: rng.randint(1, 40) for k in range(23)}
    got = {r.group_key: r.split for r in sequential.assign_groups(spark.createDataFrame(list(sizes.items()), "group_key int, n int"), seed=5, chunk=chunk).collect()}
    total = sum(sizes.values())
    target, have, want = {"train": total * 0.70, "val": total * 0.15, "test": total * 0.15}, {"train": 0.0, "val": 0.0, "test": 0.0}, {}
    for k in sorted(sizes, key=lambda k: (hashlib.sha256(f"5:{k}".encode()).hexdigest(), k)):
        best = min(have, key=lambda s: (have[s] / max(target[s], 1), have[s], s))
        have[best] += sizes[k]
        want[k] = best
    assert got == want
    assert sequential.assign_groups(spark.createDataFrame([], "group_key int, n int")).collect() == []


def test_the_lattice_is_cut_at_gaps(spark):
    import datetime
    import random

    from pingloom.operators import sequential

    rng, start = random.Random(2), datetime.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([1, 3, 7, 30, 0])
        rows.append((rng.choice(["a", "b"]), i, start + datetime.timedelta(seconds=t)))
    want = set()
    for key in "ab":
        last = None
        for _, i, ts in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if last is None or (ts - last).total_seconds() >= 25:
                want.add((key, i))
                last = ts
    got = sequential.disjoint_lattice(spark.createDataFrame(rows, "key string, frame_id long, ts timestamp"), "key")
    assert {(r.key, r.frame_id) for r in got.collect()} == want


def test_average_precision_of_many_equal_scores(spark):
    from pingloom.operators import aggregates

    rows = [(i, 0.5, i % 3 == 0) for i in range(60)] + [(100, 0.9, True), (101, 0.1, True)]
    df = spark.createDataFrame([(i, s, int(y)) for i, s, y in rows], "id int, s double, y int").repartition(4)
    hits, total = 0, 0.0
    for rank, (_, _, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        hits += y
        total += hits / rank if y else 0
    assert aggregates.average_precision(df, "s", "y", "id").first().average_precision == pytest.approx(total / hits)
    assert aggregates.average_precision(df.filter("y = 0"), "s", "y", "id").first().average_precision is None


def test_prediction_lines_and_channel_paths_fail_loudly(spark):
    from pingloom.operators import scalar
    from pingloom.sources import navigation

    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.2 0.2"), ("b", "1 0.5 0.5 0.2 0.2 0.9")], "name string, line string")
    assert {r.name: r.confidence for r in navigation.yolo_boxes(lines, 10, 10).collect()} == {"a": None, "b": 0.9}
    with pytest.raises(Exception, match="unsupported prediction line: a"):
        navigation.yolo_boxes(lines, 10, 10, predictions=True).collect()
    names = spark.createDataFrame([("d/SSS_HF_images/Image/1693569378.780.pbm",)], "name string")
    (r,) = scalar.channel_time(names).collect()
    assert (r.channel, str(r.stamp)) == ("HF", "1693569378.780000")
    with pytest.raises(Exception, match="no channel and time"):
        scalar.channel_time(spark.createDataFrame([("x/y.png",)], "name string")).collect()


def test_snapshot_errors_name_tiles_and_boxes(spark):
    tiles = spark.createDataFrame([("ok", 1, 512, 512, "train", True), ("small", 1, 500, 512, "train", True), ("bare", 1, 512, 512, "train", False), ("moved", 1, 512, 512, "val", True), ("lost", 9, None, 512, "val", None)], "tile_key string, frame_id long, tile_w int, tile_h int, split string, has_label boolean")
    boxes = spark.createDataFrame([("ok", "a", 0.0, 0.0, 512.0, 5.0), ("ok", "b", 1.0, 0.0, 512.0, 5.0), ("ok", "c", 1.0, 0.0, 0.0, 5.0), ("ok", "d", -1.0, 0.0, 5.0, 5.0)], "tile_key string, box_id string, x double, y double, w double, h double")
    frames = spark.createDataFrame([(1, "train")], "frame_id long, split string")
    got = sorted((r.subject, r.error) for r in rules.snapshot_errors(tiles, boxes, frames).collect())
    assert got == sorted([("small", "TILE_DIMENSIONS_INVALID"), ("bare", "MISSING_LABEL_FILE"), ("moved", "SPLIT_INHERITANCE_VIOLATION"), ("lost", "TILE_DIMENSIONS_INVALID"), ("lost", "MISSING_LABEL_FILE"), ("lost", "SPLIT_INHERITANCE_VIOLATION"), *[(f"ok:{b}", "INVALID_CLIPPED_BOX") for b in "bcd"]])


def test_surveys_carry_a_provenance_only_if_all_members_agree(spark):
    frames = spark.createDataFrame([(1, "MEASURED"), (2, "MEASURED"), (3, None), (4, "MEASURED"), (5, "MEASURED"), (6, "SYNTHETIC_DEMO"), (7, None), (8, "MEASURED")], "frame_id long, provenance string")
    declared = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "frame_id long, group_ref long")
    verified = spark.createDataFrame([(4, 4), (5, 5), (6, 5)], "frame_id long, component long")
    got = {r.frame_id: (r.survey_ref, r.membership, r.navigation_provenance) for r in rules.form_surveys(frames, declared, verified).collect()}
    assert got == {
        1: ("declared.1", "DECLARED", "MEASURED"), 2: ("declared.1", "DECLARED", "MEASURED"), 3: ("declared.3", "DECLARED", None), 4: ("declared.3", "DECLARED", None),
        5: ("verified.5", "VERIFIED", None), 6: ("verified.5", "VERIFIED", None), 7: ("singleton.7", "SINGLETON", None), 8: ("singleton.8", "SINGLETON", "MEASURED"),
    }


def test_written_texts_are_read_back(spark, tmp_path):
    from pingloom.sources import files

    rows = [("a.txt", "0 0.5 0.5 1 1\n1 0.25 0.25 0.5 0.5"), ("b.txt", None), ("c.txt", "é")]
    path = f"file://{tmp_path}/labels"
    assert files.write_texts(spark.createDataFrame(rows, "name string, text string"), path) == 3
    assert {(r.name, r.text) for r in files.read_texts(spark, path).collect()} >= {rows[0], rows[2]}
    assert (tmp_path / "labels" / "b.txt").read_bytes() == b"" and (tmp_path / "labels" / "a.txt").read_bytes() == (rows[0][1] + "\n").encode()
