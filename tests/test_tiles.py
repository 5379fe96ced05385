"""Tiles and boxes: every tile that a box meets, made without the tiles that none meets, and without the driver."""

import datetime

import pytest

from pingloom.operators import joins, scalar
from pingloom.plans import registry
from pingloom.sources import files

FRAMES = [(k, w, h) for k, (w, h) in enumerate([(5000, 500), (2500, 500), (640, 640), (512, 512), (513, 100), (256, 1025), (0, 700), (None, 640)])]


def test_annotated_tiles_are_those_of_the_whole_grid(spark):
    ann = [(f"g{k}-{i}", k, float(x), float(y), float(w), float(h)) for k, _, _ in [*FRAMES, (99, 0, 0)] for i, (x, y, w, h) in enumerate([(0, 0, 10, 10), (-30, -5, 20, 3), (255, 255, 2, 2), (500, 400, 700, 300), (4990, 480, 100, 100), (512, 0, 256, 256), (768, 1024, 1, 1), (6000, 9000, 5, 5)])]
    frames = spark.createDataFrame(FRAMES, "frame_id long, width int, height int")
    ann = spark.createDataFrame(ann, "gt_id string, frame_id long, bx double, by double, bw double, bh double")
    rows = lambda df: sorted(df.select("gt_id", "frame_id", "x0", "y0", "bx", "bh").collect())
    want = rows(joins.tile_annotations(scalar.tile_grid(frames).select("frame_id", "x0", "y0"), ann))
    assert len(want) > 30 and rows(joins.annotated_tiles(frames, ann)) == want


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path, day = str(tmp_path_factory.mktemp("sf")), datetime.datetime(2020, 1, 1)
    orders = [(k, k, "1-URGENT", "FOP"[k % 3], day) for k in range(60)]
    lines = [(k, k * 7, k * 3, 1 + k % 2, 5.0 + k % 9, 100.0 + k, "RAN"[k % 3], "FO"[k % 2], day) for k in range(400)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path


@pytest.mark.parametrize("name", ["A43_tile_errors", "J03_tile_annotation_join", "J05_window_coverage_join", "P09_clip_box"])
def test_tiles_are_not_sent_to_the_driver(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert df.count() > 0
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_label_files_are_not_listed_by_the_driver(spark, sf):
    df = registry.queries()["S13_write_yolo_labels"](spark, sf)
    assert df.inputFiles() == [] and df.count() > 10


def test_texts_in_folders_come_back(spark, tmp_path):
    rows = [(f"{k}.txt", "" if k % 5 == 0 else f"a{k}\nb") for k in range(200)]
    path = f"file://{tmp_path}/texts"
    assert files.write_texts(spark.createDataFrame(rows, "name string, text string"), path, 16) == 200
    assert sorted(tuple(r) for r in files.read_texts(spark, path, 16).collect()) == sorted(rows)
    assert len([p for p in (tmp_path / "texts").iterdir() if p.is_dir()]) == 16
