"""Hand-made cases: order, ties, nulls, boundaries, and streams against their batch twins."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pingloom.functions import boxes, scorers, scores
from pingloom.operators import aggregates, components, joins, scalar, sequential
from pingloom.sources import navigation
from pingloom.streaming import jobs

DET = "detection_id string, frame_id long, raw_class string, raw_confidence double, x1 double, y1 double, x2 double, y2 double"


def test_nms_keeps_at_the_threshold(spark):
    # overlap 5 of 15 units of area: IoU 1/3
    d = spark.createDataFrame([("a", 1, "P", 0.9, 0.0, 0.0, 10.0, 1.0), ("b", 1, "P", 0.8, 5.0, 0.0, 15.0, 1.0), ("c", 1, "S", 0.7, 0.0, 0.0, 10.0, 1.0)], DET)
    ids = lambda t: sorted(r.detection_id for r in sequential.class_aware_nms(d, t).collect())
    assert ids(1 / 3) == ["a", "b", "c"]
    assert ids(0.33) == ["a", "c"]


def test_matching_takes_the_best_free_box_and_the_first_of_equals(spark):
    d = spark.createDataFrame([("a", 1, "P", 0.9, 0.0, 0.0, 10.0, 10.0), ("b", 1, "P", 0.8, 0.0, 0.0, 10.0, 10.0), ("c", 1, "P", 0.7, 0.0, 0.0, 10.0, 10.0)], DET)
    g = spark.createDataFrame([("g2", 1, "P", 0.0, 0.0, 10.0, 10.0), ("g1", 1, "P", 0.0, 0.0, 10.0, 10.0)], "gt_id string, frame_id long, gt_class string, gx1 double, gy1 double, gx2 double, gy2 double")
    assert {(r.detection_id, r.gt_id) for r in sequential.match_detections(d, g, 0.5).collect()} == {("a", "g1"), ("b", "g2")}


def test_iou_of_touching_boxes_is_zero(spark):
    row = spark.range(1).select(boxes.iou(tuple(map(F.lit, (0.0, 0.0, 1.0, 1.0))), tuple(map(F.lit, (1.0, 0.0, 2.0, 1.0)))).alias("x")).first()
    assert row.x == 0.0


def test_missing_evidence_is_left_out(spark):
    d = spark.createDataFrame([(None, None, None), (0.5, None, 1.0)], "a double, b double, c double")
    got = [r.s for r in d.select(scores.weighted_mean({"detector": F.col("a"), "persistence": F.col("b"), "quality": F.col("c")}, scores.EVIDENCE_WEIGHTS).alias("s")).collect()]
    assert got[0] is None
    assert got[1] == pytest.approx((0.5 * 0.30 + 1.0 * 0.15) / 0.45)


def test_clopper_pearson_known_values(spark):
    d = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k int, n int")
    got = {(r.k, r.n): (r.cp_low, r.cp_high) for r in aggregates.clopper_pearson(d, "k", "n").collect()}
    assert got[(0, 10)] == pytest.approx((0.0, 0.30849710781876083), abs=1e-9)
    assert got[(10, 10)] == pytest.approx((1 - 0.30849710781876083, 1.0), abs=1e-9)
    assert got[(5, 10)] == pytest.approx((0.18708602844739855, 0.8129139715526015), abs=1e-9)
    assert got[(0, 0)] == (None, None)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {1} and {got[i] for i in range(100, 140)} == {100} and len(got) == 100
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_offsets_refuse_a_component_that_disagrees(spark):
    good = [(2, 1, 20), (3, 2, 20), (3, 1, 40)]
    bad = [(12, 11, 20), (13, 12, 20), (13, 11, 30)]
    got = {r.node: r.ping_offset for r in components.components_with_offsets(spark.createDataFrame(good + bad, "later long, earlier long, k long")).collect()}
    assert got == {3: 0, 2: 20, 1: 40}


def test_row_shift_needs_one_shift_and_no_repeats(spark):
    rows = []
    for f, start in ((1, 0), (2, 10)):
        rows += [(f, 20, i, f"d{start + i}") for i in range(20)]
    rows += [(3, 20, i, "same") for i in range(20)] + [(4, 20, i, "same") for i in range(20)]  # uniform: never verified
    rows += [(5, 20, i, f"e{i}") for i in range(20)] + [(6, 20, i, f"e{i}") for i in range(20)]  # identical: k = 0
    got = [(r.later, r.earlier, r.k) for r in joins.row_shift_pairs(spark.createDataFrame(rows, "frame_id long, height int, row_idx int, digest string")).collect()]
    assert got == [(1, 2, 10)]


def test_row_shift_keeps_frames_with_equal_rows(spark):
    line = [f"d{i}" for i in range(30)]
    line[12] = line[15] = "blank"
    frames = {1: line[:20], 2: line[10:], 3: line[10:]}  # 2 and 3 are one content
    frames |= {4: ["p", "q"] * 10, 5: ["q", "p"] * 10}  # periodic: several shifts
    rows = [(f, 20, i, d) for f, ds in frames.items() for i, d in enumerate(ds)]
    got = sorted((r.later, r.earlier, r.k) for r in joins.row_shift_pairs(spark.createDataFrame(rows, "frame_id long, height int, row_idx int, digest string")).collect())
    assert got == [(1, 2, 10), (1, 3, 10)]


def test_survey_comparison_uses_a_new_record_once(spark):
    base = spark.createDataFrame([("a", True), ("b", True), ("c", None)], "base_id string, covered boolean")
    new = spark.createDataFrame([("n1", "a"), ("n2", "a"), ("n3", None)], "new_id string, matched_id string")
    got = {(r.base_id, r.new_id, r.status) for r in joins.compare_surveys(base, new).collect()}
    assert got == {("a", "n1", "UNCHANGED"), ("b", None, "NOT_DETECTED"), ("c", None, "NOT_SURVEYED"), (None, "n2", "NEW"), (None, "n3", "NEW")}


def test_fusion_does_not_depend_on_input_order(spark):
    from pingloom.plans.fixtures import Views

    obs = Views(spark, "/root/testdata/sf0.001")["v_obs"]
    take = lambda d: sorted((r.detection_id, r.contact_no, r.member_no) for r in sequential.fuse_contacts(d).collect())
    assert take(obs) == take(obs.orderBy(F.rand(5)).repartition(7))


def test_priority_treats_unknown_quality_as_low(spark):
    d = spark.createDataFrame([("a", 0.9, 0.9, None, True, None), ("b", None, None, None, True, None), ("c", 0.9, 0.9, 0.9, True, "CONFIRMED")], "id string, evidence double, persistence double, quality double, has_navigation boolean, latest_verdict string")
    got = {r.id: (r.priority_band, r.recommended_action) for r in scalar.contact_priority(d).collect()}
    assert got == {"a": ("HIGH", "REACQUIRE"), "b": ("UNAVAILABLE", "REVIEW"), "c": ("HIGH", "RECOVERY_CANDIDATE")}


def test_unmapped_class_fails(spark):
    d = spark.createDataFrame([("subpipe", "buoy")], "dataset string, source_class string")
    with pytest.raises(Exception, match="no class for"):
        scalar.map_classes(d).collect()


def test_navigation_csv_first_problem(spark, tmp_path):
    head = "frame,timestamp_utc,latitude,longitude,heading_deg,ping_end\n"
    (tmp_path / "a.csv").write_text(head + "f1,2024-01-02T03:04:05Z,1,2,,7\nf2,soon,91,2,,\n ,2024-01-02T03:04:05Z,1,2,,\nf1,,1,2,,\nf3,,1,2,north,\nf4,later,1,2,,\nf5,,1,x,,\nf6,,1,2,,1.5\n")
    (tmp_path / "b.csv").write_text(head + "f1,,3,4,9,\nf7,,,4,,\n")
    rows = navigation.scan_navigation_csv(spark, str(tmp_path / "*.csv"))
    got = {(r.file[-5:], r.row, r.field, r.problem) for r in navigation.first_problems(rows).collect()}
    assert got == {
        ("a.csv", 3, "latitude", "invalid"), ("a.csv", 4, "frame", "missing"), ("a.csv", 5, "frame", "duplicate"), ("a.csv", 6, "heading_deg", "invalid"), ("a.csv", 7, "timestamp_utc", "invalid"),
        ("a.csv", 8, "longitude", "invalid"), ("a.csv", 9, "ping_end", "invalid"), ("b.csv", 3, "latitude", "missing"),
    }
    fixes = sorted((r.file[-5:], r.row, r.frame, r.ts is None, r.ping_end, r.speed_mps) for r in navigation.valid_fixes(rows).collect())
    assert fixes == [("a.csv", 2, "f1", False, 7, None), ("b.csv", 2, "f1", True, None, None)]


def test_navigation_rows_are_numbered_within_each_file(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("frame,timestamp_utc,latitude,longitude\n" + "".join(f"{name}{i},,1,2\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = navigation.scan_navigation_csv(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 10_000 and all(r.row == int(r.frame[1:]) + 2 for r in rows)
    (tmp_path / "c.csv").write_text("frame,latitude\nx,1\n")
    with pytest.raises(ValueError):
        navigation.scan_navigation_csv(spark, str(tmp_path / "c.csv"))


def test_offsets_of_a_long_chain(spark):
    order = list(range(1000))
    import random

    random.Random(4).shuffle(order)
    links = [(order[i + 1], order[i], 7) for i in range(999)]
    got = {r.node: r.ping_offset for r in components.components_with_offsets(spark.createDataFrame(links, "later long, earlier long, k long")).collect()}
    assert got == {x: 7 * (999 - i) for i, x in enumerate(order)}


def test_components_of_a_wide_raster(spark):
    from pyspark.sql import functions as F

    px = spark.range(12_000).select(F.lit(1).alias("image_id"), F.lit(0).alias("row_idx"), F.col("id").alias("col_idx"), F.when(F.col("id").isin(0, 10_000), 255).otherwise(0).alias("sample"))
    px = px.unionByName(spark.createDataFrame([(1, 1, 0, 255)], "image_id int, row_idx int, col_idx long, sample int"))
    got = sorted((r.x, r.y, r.w, r.h, r.area) for r in components.mask_components(px, 200).collect())
    assert got == [(0, 0, 1, 2, 2), (10_000, 0, 1, 1, 1)]


def test_columns_of_the_truth_cannot_be_read(spark):
    from pyspark.errors import AnalysisException

    free = scalar.ground_truth_free(spark.createDataFrame([(1, 2)], "a int, gt_class int"))
    assert free.columns == ["a"]
    with pytest.raises(AnalysisException):
        free.select("gt_class").collect()


def test_rules_that_fail(spark):
    base, new = spark.createDataFrame([("a", True, None)], "base_id string, covered boolean, verdict string"), spark.createDataFrame([("n", "a")], "new_id string, matched_id string")
    with pytest.raises(ValueError):
        joins.compare_surveys(base, new, "L1")
    assert [r.status for r in joins.compare_surveys(base, new, "L3", confirmed_only=True).collect()] == ["NEW"]
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="unknown category"):
        spark.createDataFrame([("x",)], "c string").select(navigation.known_category(F.col("c"), ("y",))).collect()
    with pytest.raises(Exception, match="two rows have the id"):
        scalar.opaque_order(spark.createDataFrame([("x",), ("x",)], "c string"), "c", "s").collect()


def test_near_duplicates_are_confirmed(spark):
    x = [float((i * 37) % 200) for i in range(64)]
    rows = [(1, "train", x), (2, "test", [x[0] + 5, *x[1:]]), (3, "test", [v + 9 for v in x]), (4, "train", x), (5, "val", x[::-1])]
    im = joins.with_difference_hash(spark.createDataFrame(rows, "id long, split string, x array<double>"))
    assert sorted((r.a_id, r.b_id) for r in joins.near_duplicates(im).collect()) == [(1, 2), (2, 4)]



def test_immutable_target_is_refused(spark, tmp_path):
    d = spark.range(3)
    navigation.write_immutable(d, str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        navigation.write_immutable(d, str(tmp_path / "out"))


def test_scorer_hook(spark):
    d = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r.score_reason for r in scorers.score(d, None).collect()] == ["SCORER_NOT_AVAILABLE"] * 2
    assert sorted(r.score for r in scorers.score(d, lambda b: b["x"] * 2).collect()) == [2.0, 4.0]


def _same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_review_stream_equals_batch(spark, tmp_path):
    from pingloom.plans.fixtures import Views

    views = Views(spark, "/root/testdata/sf0.001")
    events, contacts = views["v_reviews"], views["v_contacts"]
    for k in range(3):
        events.filter(f"event_id % 3 = {k}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = str(tmp_path / "table")
    jobs.run_reviews(stream, table, str(tmp_path / "check"), contacts).awaitTermination(120)
    assert _same_rows(jobs.review_state(spark.read.parquet(f"{table}/events").select(events.columns)).drop("last"), jobs.review_state(events).drop("last"))
    state = jobs.latest_reviews(spark, table)
    assert _same_rows(state.drop("last"), jobs.review_state(events).drop("last").select(state.drop("last").columns))
    # the newest row of each contact that had a verdict carries the priority that all verdicts give
    columns = ["latest_verdict", "review_count", "disposition", "priority_score", "priority_band", "recommended_action"]
    last = spark.read.parquet(f"{table}/contacts").groupBy("contact_id").agg(F.max_by(F.struct(*columns), "batch").alias("c")).select("contact_id", "c.*")
    assert last.count() > 0 and _same_rows(last, jobs.with_priority(contacts, jobs.review_state(events)).filter("review_count > 0").select("contact_id", *columns))
    # all batches once more under their numbers, as after a lost checkpoint: nothing is counted twice
    before = state.collect()
    jobs.run_reviews(stream, table, str(tmp_path / "check2"), contacts).awaitTermination(120)
    assert sorted(before) == sorted(jobs.latest_reviews(spark, table).collect())


def test_uploads_are_taken_once_for_each_mission_also_when_a_batch_runs_again(spark, tmp_path):
    schema = "upload_id long, mission string, sha string"
    batches = [[(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", None)], [(5, "a", "x"), (6, None, "y"), (7, "b", "z"), (8, "a", None)], [(9, None, "y"), (10, "b", "z"), (11, "c", "z")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / f"in{k}"))
    table, check = str(tmp_path / "table"), str(tmp_path / "check")

    def run(upto, where):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json([str(tmp_path / f"in{k}") for k in range(upto)][0] if upto == 1 else str(tmp_path / "in[0-9]"))
        jobs.run_uploads(stream, table, where).awaitTermination(120)
        return sorted((r.upload_id, r.mission, r.earlier, r.rejected) for r in spark.read.parquet(f"{table}/uploads").collect())

    first = run(3, check)
    whole = spark.createDataFrame([r for rows in batches for r in rows], schema)
    none = whole.select("mission", "sha", F.col("upload_id").alias("earlier")).limit(0)
    taken = {(r.upload_id, r.mission) for r in jobs.split_uploads(none, whole).filter("not rejected").collect()}
    assert {(i, m) for i, m, _, rejected in first if not rejected} == taken == {(1, "a"), (3, "b"), (4, "a"), (6, None), (7, "b"), (8, "a"), (11, "c")}
    assert (5, "a", 1, True) in first and (9, None, 6, True) in first and (2, "a", 1, True) in first
    # all batches once more under their numbers, as after a lost checkpoint: the table stays as it was
    assert run(3, str(tmp_path / "check2")) == first


def test_sessions_with_late_events_equal_the_batch(spark, tmp_path):
    import datetime

    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for seq in range(240):
        lag = 0 if rng.random() < 0.8 else rng.randint(0, 900)
        rows.append((rng.choice(["a", "b", None]), start + datetime.timedelta(seconds=seq * 20 + rng.randint(0, 40) - lag), seq))
    end = [(k, start + datetime.timedelta(days=3), 1000 + i) for i, k in enumerate(["a", "b", None])]  # closes what is open
    schema = "k string, ts timestamp, seq long"
    for a in range(0, 240, 80):
        spark.createDataFrame(rows[a : a + 80], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{a:03}"))
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(str(tmp_path / "in/900"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = jobs.run_sessions_with_late(stream, "k", "seq", gap=30, delay=300)
    out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("k", "kind", "start", "end").agg(F.sum("n").alias("n"))
    want = jobs.sessions_with_late(spark.createDataFrame([*rows, *end], schema), "k", ["seq"], gap=30, delay=300).filter(F.coalesce(F.col("start") < "2024-01-03", F.lit(True)))
    assert want.filter("kind = 'LATE'").count() >= 2 and want.filter("kind = 'SESSION'").count() > 6
    assert _same_rows(got, want.select(got.columns))


def test_session_stream_equals_batch(spark, tmp_path):
    from pingloom.plans.fixtures import Views

    nav = Views(spark, "/root/testdata/sf0.001")["v_nav"].select("survey_ref", "ts")
    nav.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(nav.schema).parquet(str(tmp_path / "in"))
    q = jobs.sessions(stream, "survey_ref", "2 hours", late="1 hour").writeStream.outputMode("complete").format("memory").queryName("sessions_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("sessions_out"), jobs.sessions(nav, "survey_ref", "2 hours")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_bootstrap_of_one_group_is_a_point(spark):
    d = spark.createDataFrame([("g", 1, 2), ("g", 1, 2)], "grp string, num int, den int")
    r = aggregates.cluster_bootstrap(d, 20, 1).first()
    assert (r.point, r.ci_low, r.ci_high, r.undefined_draws) == (0.5, 0.5, 0.5, 0)
    assert not math.isnan(r.point)


def _png(path, rows):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = b"".join(b"\0" + bytes(r) for r in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b""))


def test_rasters_and_ping_rows(spark, tmp_path):
    from pingloom.sources import files

    _png(tmp_path / "a.png", [[0, 128, 255], [7, 8, 9]])
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[-1]: (r.width, r.height, r.channels, len(r.raster_sha256)) for r in files.scan_rasters(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (3, 2, 1, 64), "b.png": (None, None, None, 64)}
    rows = {r.row_idx: r.samples for r in files.explode_ping_rows(spark, str(tmp_path)).collect()}
    assert rows == {0: [0, 128, 255], 1: [7, 8, 9]}
    assert [r.name for r in files.checksums(spark, str(tmp_path)).collect()] == ["a.png", "b.png"]


def test_coco(spark, tmp_path):
    from pingloom.sources import files

    text = '{"images": [{"id": 1, "file_name": "f"}], "annotations": [{"id": 5, "image_id": 1, "category_id": 2, "bbox": [1, 2, 3, 4]}, {"id": 6, "image_id": 1, "category_id": 2, "bbox": [1, 2]}, {"id": 7, "image_id": 9, "category_id": 2, "bbox": [1, 2, 3, 4]}], "categories": [{"id": %d, "name": "wreck"}]}'
    (tmp_path / "ok.json").write_text(text % 2)
    assert [(r.id, r.category) for r in files.scan_coco(spark, str(tmp_path / "ok.json")).collect()] == [(5, "wreck")]
    (tmp_path / "bad.json").write_text(text % 3)
    with pytest.raises(Exception, match="no category"):
        files.scan_coco(spark, str(tmp_path / "bad.json")).collect()


def test_stored_tables_are_cleared(spark, tmp_path):
    from pingloom.functions import storage

    storage.clear(spark)
    d = storage.stored(spark.range(5))
    assert d.count() == 5 and storage.clear(spark) == 1
    with pytest.raises(Exception):
        spark.read.parquet(d.inputFiles()[0]).count()

def test_dropped_deletes_one_stored_table(spark):
    from pingloom.functions import storage

    first, second = storage.stored(spark.range(5)), storage.stored(spark.range(7))
    storage.dropped(first)
    assert second.count() == 7 and not any(f.split("/")[-2] in path for f in first.inputFiles() for path in storage._written)
    storage.dropped(spark.range(3))  # no stored table: nothing is deleted
    assert second.count() == 7


# ---- ordered scans, nearest vectors, near hashes, quantiles, intervals, isotonic fits


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many ranges as the session has shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_ordered_scan_carries_one_key_through_all_ranges(spark, many_ranges):
    from pingloom.operators import ordered

    rng = random.Random(3)
    rows = [("one" if rng.random() < 0.9 else None, i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(7)
    laid = ordered.laid_out(df, ["k"], ["t"])
    per = [r["count"] for r in laid.filter("k = 'one'").groupBy("_part").count().collect()]
    assert len(per) >= 3 and max(per) < 2000  # one key is spread over the tasks
    out = ordered.with_running(ordered.with_previous(laid, ["k"], ["v"]), ["k"], sums={"total": F.col("v")}, highs={"high": F.col("v")})
    got = {(r.k, r.t): (r.prev_v, r.total, r.high) for r in out.collect()}
    want, state = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        prev, total, high = state.get(k, (None, 0, None))
        want[k, t] = (prev, total + v, high)
        state[k] = (v, total + v, v if high is None else max(high, v))
    assert got == want
    chained = ordered.chains(df, ["k"], ["t"], ["v"], F.col("v") >= F.col("prev_v"))
    number, last, want = {}, {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        number[k] = number.get(k, 0) + (0 if k in last and v >= last[k] else 1)
        last[k] = v
        want[k, t] = number[k]
    assert {(r.k, r.t): r.chain for r in chained.collect()} == want
    assert [r.number for r in ordered.numbered(df, ["t"]).orderBy("t").collect()] == list(range(1, 3001))
    empty = ordered.chains(df.limit(0), ["k"], ["t"], ["v"], F.col("v") >= F.col("prev_v"))
    assert empty.collect() == []


def test_a_digest_tree_groups_no_more_than_its_fan(spark, many_ranges):
    import hashlib

    from pingloom.operators import ordered

    df = spark.range(25).select(F.lit("k").alias("k"), "id")
    (r,) = ordered.digest_tree(df, ["k"], ["id"], F.col("id").cast("string"), fan=4).collect()
    level = [str(i) for i in range(25)]
    for _ in range(ordered.LEVELS):
        level = [hashlib.sha256(",".join(level[a : a + 4]).encode()).hexdigest() for a in range(0, len(level), 4)]
    assert r.n == 25 and r.digest == level[0]


@pytest.mark.parametrize("tile", [8, 1024])
def test_nearest_distances_are_exact_and_mostly_not_computed(spark, many_ranges, tile):
    import numpy as np

    from pingloom.operators.nearest import nearest_distance

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 20
    bank = np.concatenate([c + rng.normal(size=(120, 8)) for c in centres] + [np.repeat(centres[:1], 300, 0)])  # one cell holds copies
    asked = np.concatenate([centres[rng.integers(0, 12, 60)] + rng.normal(size=(60, 8)), rng.normal(size=(5, 8)) * 40, centres[:1]])
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<double>").repartition(3)
    got = nearest_distance(frame(asked), frame(bank), tile=tile).collect()
    want = np.sqrt(((asked[:, None] - bank[None]) ** 2).sum(2)).min(1)
    assert len(got) == len(asked) and all(r.distance == pytest.approx(want[r.vec_id], abs=1e-12) for r in got)
    if tile == 8:
        assert sum(r.compared for r in got) < 0.5 * len(asked) * len(bank)
    short = spark.createDataFrame([(1, [1.0])], "vec_id long, x array<double>")
    with pytest.raises(Exception, match="components"):
        nearest_distance(short, frame(bank)).collect()
    with pytest.raises(ValueError, match="empty"):
        nearest_distance(short, short.limit(0))
    assert nearest_distance(short.limit(0), short).collect() == []


@pytest.mark.parametrize("most_alike", [1, 4, 1000])
def test_near_hashes_are_found_however_many_share_their_keys(spark, most_alike):
    from pingloom.operators import joins

    rng = random.Random(5)
    values = {rng.getrandbits(63) for _ in range(60)}
    hot = rng.getrandbits(63)  # most hashes agree in all but the last bits
    for _ in range(80):
        values.add(hot ^ rng.getrandbits(14))
        v = rng.choice(sorted(values))
        values.add(v ^ sum({1 << rng.randrange(63) for _ in range(rng.randint(0, 5))}))
    values = sorted(values)
    splits = {v: sorted(rng.sample(["a", "b", "c"], rng.choice([1, 1, 2]))) for v in values}
    hashes = spark.createDataFrame([(v, splits[v]) for v in values], "h long, splits array<string>")
    got = {(r.p, r.q): r.distance for r in joins.near_hashes(hashes, 4, most_alike).collect()}
    want = {(p, q): (p ^ q).bit_count() for i, p in enumerate(values) for q in values[i:] if (p ^ q).bit_count() <= 4 and (splits[p] != splits[q] or len(splits[p]) > 1)}
    assert got == want
    assert joins.near_hashes(hashes.limit(0)).collect() == []


def test_quantiles_narrow_down_to_the_wanted_ranks(spark):
    import numpy as np

    from pingloom.operators import aggregates

    rng = np.random.default_rng(1)
    data = {"heavy": np.exp(rng.normal(size=700) * 6), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([2.5]), None: rng.normal(size=40)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("empty", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    points = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r.k: r for r in aggregates.exact_quantiles(df, ["k"], "v", points, most=5, bins=4).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        assert got[k].n == len(vs)
        for name, p in points.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)
    (whole,) = aggregates.exact_quantiles(df, [], "v", {"c": 0.5}, most=3, bins=3).collect()
    assert whole.c == pytest.approx(np.median([v for _, v in rows if v is not None]))
    summary = {r.k: r for r in aggregates.quantile_summary(df, "k", "v").collect()}
    assert summary["empty"].median is None and summary["one"].max == 2.5


def test_exact_intervals_of_large_counts(spark):
    from pingloom.operators import aggregates

    cases = [(0, 10), (10, 10), (3, 10), (50, 100), (1, 1), (0, 0), (300_000, 1_000_000), (7, 1_000_000)]
    got = {(r.k, r.n): r for r in aggregates.clopper_pearson(spark.createDataFrame(cases, "k long, n long"), "k", "n").collect()}
    assert got[0, 10].cp_low == 0 and got[0, 10].cp_high == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)
    assert got[10, 10].cp_high == 1 and got[10, 10].cp_low == pytest.approx(0.025 ** (1 / 10), abs=1e-9)
    assert (round(got[3, 10].cp_low, 6), round(got[3, 10].cp_high, 6)) == (0.066740, 0.652453)
    assert (round(got[50, 100].cp_low, 6), round(got[50, 100].cp_high, 6)) == (0.398321, 0.601679)
    assert got[0, 0].cp_low is None and got[0, 0].cp_high is None

    def tail(k, n, p):
        """P(X >= k) by a sum around the mode, in logarithms."""
        import math

        term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        return math.fsum(term(i) for i in range(k, min(n, k + 20_000)))

    for k, n in ((300_000, 1_000_000), (7, 1_000_000)):
        assert tail(k, n, got[k, n].cp_low) == pytest.approx(0.025, rel=1e-5)
        assert 1 - tail(k + 1, n, got[k, n].cp_high) == pytest.approx(0.025, rel=1e-4)


@pytest.mark.parametrize("chunk", [2, 7, 1000])
def test_isotonic_blocks_pool_across_chunks(spark, many_ranges, chunk):
    from pingloom.operators import aggregates

    rng = random.Random(chunk)
    data = [(x, int(rng.random() < (0.9 - x if rng.random() < 0.3 else x))) for x in (rng.randint(0, 80) / 80 for _ in range(150))]
    df = spark.createDataFrame(data, "x double, y int").repartition(4)
    blocks = sorted((r.lo, r.hi, r.fitted) for r in aggregates.isotonic_blocks(df, "x", "y", chunk).collect())
    stack = []
    for x in sorted({x for x, _ in data}):
        own = [y for v, y in data if v == x]
        stack.append([x, x, sum(own), len(own)])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            last = stack.pop()
            stack[-1] = [stack[-1][0], last[1], stack[-1][2] + last[2], stack[-1][3] + last[3]]
    assert blocks == [(lo, hi, s / n) for lo, hi, s, n in stack]
    asked = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 0.333, 0.5, 1.0, 9.0, None])], "i int, x double")
    table = spark.createDataFrame(blocks, "lo double, hi double, fitted double")
    got = {r.i: r.fitted for r in aggregates.isotonic_lookup(asked, table, "x").collect()}
    want = {i: None if v is None else next((f for _, hi, f in blocks if hi >= v), blocks[-1][2]) for i, v in enumerate([-1.0, 0.0, 0.333, 0.5, 1.0, 9.0, None])}
    assert got == want


def test_a_survey_is_cut_where_no_contact_can_cross(spark, many_ranges):
    from pingloom.operators import sequential

    schema = "detection_id string, frame_id long, tile_id int, raw_class string, inference_mode string, raw_confidence double, x1 double, y1 double, x2 double, y2 double, nx1 double, ny1 double, nx2 double, ny2 double, survey_ref string, ping_start long, ping_end long"
    rng = random.Random(4)
    rows = []
    for f in range(120):  # frames of one survey, with a gap after every tenth
        start = f * 20 + f // 10 * 100
        for d in range(3):
            x, y = rng.randint(0, 30), rng.randint(0, 10)
            rows.append((f"d{f:03}_{d}", f, d, "PIPELINE", "TILED", 0.5, float(x), float(y), x + 25.0, y + 12.0, x / 64, y / 40, (x + 25) / 64, (y + 12) / 40, "s1", start, start + 19 + 20 * (f % 2)))
    df = spark.createDataFrame(rows, schema).repartition(6)
    segments = sequential.contact_segments(df)
    sizes = [r["count"] for r in segments.groupBy("key", "segment").count().collect()]
    assert len(sizes) == 12 and max(sizes) == 30
    got = {r.detection_id: (r.contact_no, r.member_no) for r in sequential.fuse_contacts(df).collect()}
    # the rule itself, over the whole survey in one list
    pair = spark.createDataFrame(rows, schema)
    a, b = (pair.select(*[F.col(c).alias(f"{p}{c}") for c in pair.columns]) for p in ("a_", "b_"))
    related = {(r.a_detection_id, r.b_detection_id) for r in a.join(b, F.expr("abs(a_frame_id - b_frame_id) <= 12")).filter(sequential.relation("a_", "b_").isNotNull()).select("a_detection_id", "b_detection_id").collect()}
    groups, want = [], {}
    for n, r in enumerate(sorted(rows, key=lambda r: (r[15], r[1], r[0]))):
        at = next((i for i, g in enumerate(groups) if (g, r[0]) in related), None)
        if at is None:
            groups.append(r[0])
            at = len(groups) - 1
        groups[at] = r[0]
        want[r[0]] = (at + 1, n)
    assert got == want


def test_a_verified_chain_may_not_cross_splits(spark, many_ranges):
    from pingloom.operators import sequential

    frames = [(1, "c", 1, 64, 40, "train"), (2, "c", 2, 64, 40, "train"), (3, "c", 3, 64, 40, "val"), (4, "c", 4, 63, 40, "val"), (9, None, 1, 64, 40, "val")]
    schema = "frame_id long, channel string, ts long, width int, height int, split string"
    pairs = lambda rows: spark.createDataFrame(rows, "later long, earlier long")
    got = sorted((r.frame_id, r.chain, r.start) for r in sequential.verified_chains(spark.createDataFrame(frames, schema), pairs([(2, 1), (3, 4)])).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 3, 4), (9, 1, 1)]  # 3 and 4 differ in width
    with pytest.raises(Exception, match="crosses splits"):
        sequential.verified_chains(spark.createDataFrame(frames, schema), pairs([(3, 2)])).collect()
