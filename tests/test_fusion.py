"""Related pairs and fused contacts: where observations are, without joins of all frames of a survey."""

import random

import pytest
from pyspark.sql import functions as F

from pingloom.operators import sequential as S
from pingloom.plans import registry
from pingloom.plans.fixtures import Views

FIELDS = "detection_id string, frame_id long, tile_id int, raw_class string, inference_mode string, raw_confidence double, x1 double, y1 double, x2 double, y2 double, nx1 double, ny1 double, nx2 double, ny2 double, survey_ref string, ping_start long, ping_end long"


@pytest.fixture(scope="module")
def obs(spark):
    r, rows = random.Random(3), []
    for k in range(700):
        frame, x, y = r.randrange(60), r.randrange(60), r.randrange(30)
        start = None if frame % 5 == 0 else frame % 20 * 20
        end = start and (None if k % 50 == 0 else start + 19 + frame % 2 * 20)
        x2, y2 = x + r.randrange(5, 30), y + r.randrange(5, 20)
        rows.append((f"d{k}", frame, None if k % 40 == 0 else r.randrange(4), r.choice(["PIPELINE", "SHIPWRECK"]), r.choice(["TILED", "TILED", "FULL_FRAME", None]), 0.5, float(x), float(y), float(x2), float(y2), x / 64, y / 12, x2 / 64, y2 / 12, None if k % 90 == 0 else f"s{frame // 20}", start, end))
    return spark.createDataFrame(rows, FIELDS).cache()


@pytest.mark.parametrize(("pairs", "reach"), [(7, 2), (1 << 20, 2), (64, 5)])
def test_related_pairs_are_those_of_all_pairs(spark, obs, monkeypatch, pairs, reach):
    a, b = obs.alias("a"), obs.alias("b")
    both = a.join(b, F.expr(f"a.survey_ref = b.survey_ref and a.raw_class = b.raw_class and abs(a.frame_id - b.frame_id) <= {reach} and a.detection_id < b.detection_id"))
    want = sorted(tuple(r) for r in both.select("a.detection_id", "b.detection_id", S.relation("a.", "b.").alias("r")).filter("r is not null").collect())
    assert {r[2] for r in want} == set(S._RELATIONS)
    monkeypatch.setattr(S, "PAIRS", pairs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9 if pairs < 100 else 10000)  # a frame reaches into the next batches
    try:
        found = S.related_pairs(obs, reach)
        assert sorted(tuple(r) for r in found.collect()) == want
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_relations_are_found_in_one_exchange(spark, sf):
    plan = registry.queries()["G03_association_relation"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    import datetime

    path, day = str(tmp_path_factory.mktemp("sf")), datetime.datetime(2020, 1, 1)
    r = random.Random(5)
    lines = [(r.randrange(900), r.randrange(500), r.randrange(90), 1 + r.randrange(7), float(r.randrange(1, 50)), r.randrange(10**6) / 100, r.choice("RAN"), r.choice("FO"), day) for _ in range(3000)]
    events = [(k, day, k // 3, "view", 1.5 * k, "{}") for k in range(120)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return path


def test_picked_rows_are_those_of_the_sql(spark, sf):
    import duckdb

    from pingloom.plans.fixtures import with_views

    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    v = Views(spark, sf)
    assert sorted(tuple(r) for r in v["v_det"].collect()) == sorted(con.execute(with_views("SELECT * FROM v_det")).fetchall())


def test_contacts_of_blocks_are_those_of_ordered_scans(spark, obs):
    placed = obs.filter("survey_ref is not null and tile_id is not null and (ping_start is null or ping_end is not null)")
    blocks = placed.withColumn("block", F.col("survey_ref")).repartition("block")
    rows = lambda df: sorted((r.key, r.contact_no, r.member_no, r.detection_id) for r in df.collect())
    got = S.fuse_contacts(blocks, "block")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows(got) == rows(S.fuse_contacts(placed))


@pytest.mark.parametrize("name", ["G04_fuse_contacts", "A01_contact_rollup", "A02_look_persistence", "G10_look_groups", "A03_contact_enrich", "J26_contact_views"])
def test_contacts_are_found_in_one_exchange(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() > 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_map_has_no_folder_for_each_survey(spark, sf):
    df = registry.queries()["S17_map_geojson"](spark, sf)
    assert df.select("survey_ref").distinct().count() > 20
    assert {f.rsplit("/", 2)[1] for f in df.inputFiles()} <= {"role=CONTACT", "role=PLATFORM_FIX_NOT_CONTACT_LOCATION"}


def test_the_report_reads_observations_once(spark, sf):
    from pingloom.plans.catalog_contacts import observation_report

    rows = observation_report(Views(spark, sf))
    assert rows._jdf.queryExecution().executedPlan().toString().count("l_extendedprice#") > 0
    scans = [x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and "lineitem" in x]
    assert len(scans) == 1
