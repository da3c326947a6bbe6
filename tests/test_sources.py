import os
import tempfile

from pitchside import presets
from pitchside.operators.catalog import crop_plan, report_catalog
from pitchside.sources import explode_detections, read_player_matches, write_crop_plan, write_table

from conftest import rows


def test_player_csv_keeps_position_text_and_nan_as_null(spark):
    d = tempfile.mkdtemp(prefix="pitchside-players-")
    metrics = [m for ws in presets.WEIGHTS.values() for m in ws]
    header = ",".join(["year", "player_name", "team", "Position", "Minutes played", *metrics])
    line1 = ",".join(["2024", "A", "T", '"LCB, CB"', "90", *["1"] * len(metrics)])
    line2 = ",".join(["2024", "B", "T", "0", "NaN", *["0"] * len(metrics)])
    with open(os.path.join(d, "players.csv"), "w") as f:
        f.write("\n".join([header, line1, line2]) + "\n")
    df = read_player_matches(spark, d)
    got = rows(df, "player_name", "Position", "Minutes played")
    assert got == [("A", "LCB, CB", 90.0), ("B", "0", None)]


def test_nested_detections_explode_in_order(spark):
    df = spark.createDataFrame(
        [("img", "table", [(1.0, 2.0, "Team A", 0.9), (0.5, 2.0, "45.1", 0.8)])],
        "image_id string, section string, detections array<struct<x double, y double, text string, conf double>>")
    got = rows(explode_detections(df), "seq", "text", "x")
    assert got == [(0, "Team A", 1.0), (1, "45.1", 0.5)]


def test_crop_plan_sink_is_partitioned_by_side_and_kind(spark):
    listing = spark.createDataFrame([("/r/Penn State/Penn State - Iowa 1-0.pdf", 24)], "path string, page_count int")
    plan = crop_plan(report_catalog(listing, "Penn State"))
    out = tempfile.mkdtemp(prefix="pitchside-plan-")
    write_crop_plan(plan, out)
    assert sorted(os.listdir(out + "/side=home_team")) == ["kind=avg_formation", "kind=shooting_map",
                                                          "kind=shooting_side"]
    back = spark.read.parquet(out)
    assert back.count() == 5
    write_table(back.select("out_name"), out + "_names")
    assert spark.read.parquet(out + "_names").count() == 5
