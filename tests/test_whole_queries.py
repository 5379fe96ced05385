"""Queries on small tables of their own: no row of the result is left out."""

import datetime

from pingloom.operators import rules
from pingloom.plans import registry


def _tables(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def _customers(rows):
    return [(k, nation, "MACHINERY", 100.0) for k, nation in rows], "c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double"


def test_index_lists_all_surveys(spark, tmp_path):
    orders = [(k, k, "1-URGENT", "F", datetime.date(2020, 1, 1) + datetime.timedelta(k)) for k in range(64)]
    sf = _tables(spark, tmp_path, customer=_customers([(1, 3), (2, 3)]), orders=(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate date"))
    got = registry.queries()["A13_survey_index"](spark, sf).collect()
    assert [r.survey_id for r in got] == [f"s{k}" for k in reversed(range(64))]
    assert {r.survey_id: r.contacts for r in got if r.contacts} == {"s3": 2}


def test_all_frames_that_share_rows_are_paired(spark, tmp_path):
    vector = lambda k: [1.0, 2.0] if k % 100 == 7 else [float(k), 0.5]
    sf = _tables(spark, tmp_path, embeddings=([(k, vector(k)) for k in range(300)], "vec_id long, embedding array<float>"))
    got = {(r.a_id, r.b_id): r.shared for r in registry.queries()["U02_shared_ping_rows"](spark, sf).collect()}
    assert (got[0, 4], got[4, 8], got[0, 8]) == (1, 1, 1)  # one row in all blocks of a hundred, frames that are not neighbours too
    assert (got[0, 1], got[1, 2], got[4, 5]) == (20, 20, 20)
    assert got[3, 8] == 0 and (0, 2) not in got  # neighbours of a channel that share nothing stay


def test_blocks_of_frames_lose_no_pair(spark):
    held = [(f, "blank") for f in range(50)] + [(f, f"p{f % 7}") for f in range(50)] + [(3, "blank"), (9, None), (10, None)]
    rows = spark.createDataFrame(held, "frame_id long, digest string")
    expected = sorted((a, b, 1 + (a % 7 == b % 7)) for a in range(50) for b in range(a + 1, 50))
    for block in (4, 50, 256):
        assert sorted(tuple(r) for r in rules.sharing_frames(rows, block).collect()) == expected
    assert rules.sharing_frames(rows.limit(0)).collect() == []


def test_report_lists_its_strong_contacts(spark, tmp_path):
    # evidence is c_custkey * 7919 % 1000 / 1000, null for multiples of 11
    strong = [k for k in range(1, 2000) if k * 7919 % 1000 >= 900 and k % 11]
    customers = [(k, 1) for k in strong] + [(k, 2) for k in range(2001, 2100) if k * 7919 % 1000 < 900]
    sf = _tables(spark, tmp_path, customer=_customers([*customers, (2902, None)]))
    got = registry.queries()["S21_mission_report_snapshot"](spark, sf).collect()
    listed = sorted((r.place, r.contact_id) for r in got if r.survey_id == "s1")
    assert listed == list(enumerate(sorted(f"c{k}" for k in strong), 1))
    assert {r.strong for r in got if r.survey_id == "s1"} == {len(strong)}
    assert [(r.strong, r.place, r.contact_id) for r in got if r.survey_id is None] == [(1, 1, "c2902")]
    assert [(r.strong, r.place, r.contact_id, r.contacts) for r in got if r.survey_id == "s2"] == [(0, None, None, len(customers) - len(strong))]
