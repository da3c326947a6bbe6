"""Rejects counted in the pass that reads, sinks that replace single partitions, tables laid out by player."""
import hashlib
import os

import pytest

from pitchside import presets
from pitchside.operators.catalog import crop_plan, report_catalogs
from pitchside.plans import standins as si
from pitchside.plans.player import player_matchups, player_table
from pitchside.sources import (
    TEAM_MATCH_SCHEMA, checked_csv, checked_images, csv_rejects, finished_partitions, land_csv, read_team_matches, unfinished, write_crop_plan,
    write_incremental, write_player_table,
)

from conftest import rows
from test_grid import _png as write_png

MEASURES = list(presets.TEAM_MEASURES)
SUMS = [m for m, how in presets.TEAM_MEASURES.items() if how == "sum"]
MEANS = [m for m in MEASURES if m not in SUMS]
SF = "/root/testdata/sf0.001"


def _csv(tmp_path, n=60):
    lines = [",".join(["date", "team", *MEASURES])]
    for i in range(n):
        cells = {m: "1" for m in MEASURES}
        date = "2024-09-01"
        if i % 5 == 0:
            cells[SUMS[0]] = "x7"
        if i % 7 == 0:
            cells[MEANS[0]] = "n/a"
        if i % 11 == 0:
            date = "someday"
        if i % 3 == 0:
            cells[MEANS[1]] = "NaN"
        lines.append(",".join([date, f"T{i}", *cells.values()]))
    for part, chunk in enumerate((lines[1:30], lines[30:])):
        (tmp_path / f"p{part}.csv").write_text("\n".join([lines[0], *chunk]) + "\n")
    return str(tmp_path)


def test_rejects_are_counted_while_reading(spark, tmp_path):
    path = _csv(tmp_path)
    df, seen = checked_csv(spark, path, TEAM_MATCH_SCHEMA, date_col="date")
    got = df.collect()
    want = {r["column"]: r["rejected"] for r in csv_rejects(spark, path, TEAM_MATCH_SCHEMA, date_col="date").collect()}
    counts = seen.get
    assert {k: counts[k] for k in want} == want and want[SUMS[0]] == 12 and want["date"] == 6 and want[MEANS[1]] == 0
    bad = [i for i in range(60) if i % 5 == 0 or i % 7 == 0 or i % 11 == 0]
    assert counts["rows"] == 60 and counts["rows with rejects"] == len(bad)
    assert {r.team for r in got if r.bad} == {f"T{i}" for i in bad}
    assert next(r.bad for r in got if r.team == "T35") == {SUMS[0]: "x7", MEANS[0]: "n/a"}
    plain = read_team_matches(spark, path)
    assert rows(df.drop("bad")) == rows(plain) and df.drop("bad").schema == plain.schema
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan csv") == 1


def test_landing_sets_bad_rows_aside_in_one_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = _csv(tmp_path / "in")
    clean, quarantined, counts = land_csv(spark, path, TEAM_MATCH_SCHEMA, str(tmp_path / "out"), date_col="date")
    assert clean.count() + quarantined.count() == 60 == counts["rows"] and quarantined.count() == counts["rows with rejects"]
    assert clean.columns == TEAM_MATCH_SCHEMA.names and all(r.bad for r in quarantined.collect())
    again = land_csv(spark, path, TEAM_MATCH_SCHEMA, str(tmp_path / "out"), date_col="date")[0]
    assert again.count() == 60 - counts["rows with rejects"]


def test_unreadable_images_are_counted(spark, tmp_path):
    write_png(str(tmp_path / "a.png"), [[(r, c, 9) for c in range(4)] for r in range(3)])
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_bytes(b"other")
    images, bad, seen = checked_images(spark, str(tmp_path))
    assert [r.image.width for r in images.collect()] == [4]
    assert seen.get == {"files": 2, "unreadable": 1} and [os.path.basename(r.origin) for r in bad.collect()] == ["b.png"]


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path): hashlib.sha256(open(os.path.join(d, f), "rb").read()).hexdigest()
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_manifest" not in d}


def test_one_partition_is_replaced_and_the_rest_stays(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"s{i % 3}", f"k{i % 2}") for i in range(60)], "id int, side string, kind string")
    first = write_incremental(df, out, ("side", "kind"))
    before = _files(out)
    part = df.where("side = 's1' AND kind = 'k0'").selectExpr("id + 1000 AS id", "side", "kind")
    second = write_incremental(part, out, ("side", "kind"))
    after = _files(out)
    mine = "side=s1/kind=k0/"
    assert {k: v for k, v in before.items() if mine not in k} == {k: v for k, v in after.items() if mine not in k}
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted([i for i in range(60) if not (i % 3 == 1 and i % 2 == 0)] + [i + 1000 for i in range(60) if i % 3 == 1 and i % 2 == 0])
    done = finished_partitions(spark, out, ("side", "kind"))
    assert {(r.side, r.kind): (r.rows, r.run_id) for r in done.collect()} == {(f"s{a}", f"k{b}"): (10, second if (a, b) == (1, 0) else first) for a in range(3) for b in range(2)}
    write_incremental(df.where("false"), out, ("side", "kind"))
    assert _files(out) == after
    with pytest.raises(ValueError):
        write_incremental(df.withColumnRenamed("id", "run_id"), out, ("side",))


def test_a_run_cut_short_goes_on_with_what_is_missing(spark, tmp_path):
    out = str(tmp_path / "t")
    df = spark.createDataFrame([(i, f"s{i % 4}") for i in range(40)] + [(99, None)], "id int, side string")
    write_incremental(df.where("side IN ('s0', 's2')"), out, ("side",))
    rest = unfinished(df, finished_partitions(spark, out, ("side",)), ("side",))
    assert {r.side for r in rest.select("side").distinct().collect()} == {"s1", "s3", None}
    write_incremental(rest, out, ("side",))
    assert unfinished(df, finished_partitions(spark, out, ("side",)), ("side",)).count() == 0
    assert spark.read.parquet(out).count() == 41


def test_crop_plans_of_several_teams_side_by_side(spark, tmp_path):
    files = spark.createDataFrame([(f"/r/{f}/{a} - {b} 1-0.pdf", 24) for f, a, b in [("Penn", "Penn", "Iowa"), ("Ohio", "Ohio", "Penn"), ("Ohio", "Ohio", "Purdue")]], "path string, page_count int")
    plan = lambda *names: crop_plan(report_catalogs(files, spark.createDataFrame([(n,) for n in names], "team string")))
    out = str(tmp_path / "plan")
    write_crop_plan(plan("Penn", "Ohio"), out, incremental=True)
    before = _files(out)
    write_crop_plan(plan("Ohio"), out, incremental=True)
    after = _files(out)
    assert {k: v for k, v in before.items() if "folder=Penn" in k} == {k: v for k, v in after.items() if "folder=Penn" in k}
    assert spark.read.parquet(out).count() == 15


def test_a_table_by_player_needs_no_shuffle_on_the_player(spark):
    matches = si.player_matches(spark, SF)
    name = "pitchside_test_player_matches"
    try:
        bucketed = write_player_table(matches, name, 8)
        season = bucketed.where(f"year = {si.STANDIN_SEASON}")
        args = dict(position_map=si.STANDIN_POSITION_MAP)
        broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            plan = player_table(season, **args)._jdf.queryExecution().executedPlan().toString()
            other = player_table(matches, **args)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        assert "Exchange" not in plan and "hashpartitioning(player_name" in other
        res = player_matchups(bucketed, None, si.STANDIN_OWN_TEAM, season=si.STANDIN_SEASON, **args)
        assert "hashpartitioning(player_name" not in res.pitch._jdf.queryExecution().executedPlan().toString()
        want = player_matchups(matches, None, si.STANDIN_OWN_TEAM, season=si.STANDIN_SEASON, **args)
        assert rows(res.pitch) == rows(want.pitch) and rows(res.scored) == rows(want.scored)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
