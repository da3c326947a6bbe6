"""Rules that earlier fixtures did not reach: NaN scores, one pitch per rival, sparse grids, image rows in one
pass, formation rejects, the session's checkpoint folder, the report chain."""
import glob
import os
import random
import subprocess
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.functions.text import with_py_str
from pitchside.operators.catalog import crop_plan, report_catalog, with_page_counts
from pitchside.operators.formation import formation_rejects, formation_rows
from pitchside.operators.grid import (
    accumulate, colour_classes, crop_pixels, formation_boxes, grid_occupancy, image_cells, image_colour_classes,
    image_dims, image_sections, scale_grid,
)
from pitchside.operators.lanes import attack_lanes
from pitchside.operators.matchup import pitch_layout
from pitchside.operators.scoring import pct_col, score_col, top_k_by_aspect, weighted_scores
from pitchside.operators.summary import resolve_team
from pitchside.sources.readers import list_reports

from conftest import rows

ASPECTS = list(presets.WEIGHTS)


def test_scores_over_both_infinities_are_missing_and_rank_last(spark):
    metrics = list(dict.fromkeys(m for ws in presets.WEIGHTS.values() for m in ws))
    schema = f"player_name string, team string, `{presets.MINUTES_COL}` double, " + ", ".join(f"`{m}` double" for m in metrics)
    one = [1.0] * len(metrics)
    data = [("weird", "T", 0.0, *one), ("weird", "T", 0.0, *[-x for x in one]), ("plain", "T", 90.0, *one), ("low", "T", 90.0, *[0.0] * len(metrics))]
    scores = weighted_scores(spark.createDataFrame(data, schema))
    got = {r["player_name"]: r for r in scores.collect()}
    assert all(got["weird"][score_col(a)] is None for a in ASPECTS)
    nan = scores.withColumns({score_col(a): F.when(F.col("player_name") == "weird", F.lit(float("nan"))).otherwise(F.col(score_col(a))) for a in ASPECTS})
    for df in (scores, nan):
        last = {r["aspect"]: r["player_name"] for r in top_k_by_aspect(df, 3).filter("aspect_rank = 3").collect()}
        assert set(last.values()) == {"weird"}
    some = top_k_by_aspect(scores, 1, k_of={"T": 2})
    assert some.count() == 2 * len(ASPECTS)


def test_two_rivals_on_one_slot_keep_their_own_pitch(spark):
    pos = next(iter(presets.PITCH_COORDS))
    pct = ", ".join(f"{side}_{pct_col(a)} double" for side in ("rival", "own") for a in ASPECTS)
    schema = f"rival_name string, rival_team string, aspect_rank long, aspect_order int, own_name string, own_team string, own_position string, {pct}"
    data = [(n, t, r, 0, "me", "Own", pos, *[0.5] * (2 * len(ASPECTS))) for n, t, r in (("x", "A", 1), ("y", "A", 2), ("z", "B", 2))]
    got = rows(pitch_layout(spark.createDataFrame(data, schema)), "rival_team", "own_position", "rival_name")
    assert got == [("A", pos, "x"), ("B", pos, "z")]


def test_sparse_pixels_count_absent_cells_as_zero(spark):
    px = spark.createDataFrame([("i", "s", 0, 0, 0), ("i", "s", 3, 3, 0), ("j", "s", 0, 0, 0), ("j", "s", 3, 3, 9)], "image_id string, side string, row int, col int, gray int")
    px = px.filter("NOT (image_id = 'j' AND row = 3)").unionAll(px.filter("image_id = 'j' AND row = 3").withColumn("gray", F.lit(128)))
    g = grid_occupancy(px, cell=(2, 2), fraction=0.0, by=["side"])
    assert rows(g, "cell_row", "cell_col", "hits") == [(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 1)]
    scaled = {(r["cell_row"], r["cell_col"]): r["scaled"] for r in scale_grid(g, "normalize", by=["side"]).collect()}
    assert scaled == {(0, 0): 1.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.5}


def _images(spark):
    r = random.Random(4)
    px, img = [], []
    for k in range(3):
        cells = [[tuple(r.choice([0, 50, 120, 180, 255]) for _ in range(3)) for _ in range(10)] for _ in range(12)]
        img.append((("o%d" % k, 12, 10, 3, 16, bytes(v for row in cells for p in row for v in p)), "s"))
        px += [("o%d" % k, y, x, *p) for y, row in enumerate(cells) for x, p in enumerate(row)]
    images = spark.createDataFrame(img, "image struct<origin string, height int, width int, nChannels int, mode int, data binary>, side string")
    return images, spark.createDataFrame(px, "image_id string, row int, col int, b int, g int, r int")


def test_image_rows_equal_pixel_tables(spark):
    images, px = _images(spark)
    got = rows(image_colour_classes(images, keep=["side"]), "origin", "black_pixels", "blue_pixels")
    assert got == rows(colour_classes(px), "image_id", "black_pixels", "blue_pixels")
    cut = {(r["origin"], r["section"]): r for r in image_sections(images).collect()}
    boxes = crop_pixels(px, formation_boxes(image_dims(px))).orderBy("row", "col").collect()
    for key, r in cut.items():
        want = [p for p in boxes if (p["image_id"], p["section"]) == key]
        assert bytes(v for p in want for v in (p["b"], p["g"], p["r"])) == bytes(r["data"])
        assert len(want) == r["height"] * r["width"]
    assert len(cut) == 6


def test_cells_with_kept_columns_read_the_images_once(spark):
    images, _ = _images(spark)
    d = tempfile.mkdtemp(prefix="pitchside-img-")
    images.unionAll(images.limit(1)).write.mode("overwrite").parquet(d)
    cells = image_cells(spark.read.parquet(d), cell=(5, 5), keep=["side"])
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    hits = accumulate(cells.withColumn("flag", F.lit(1)), by=["side"])
    assert {r["hits"] for r in hits.collect()} == {4}  # an image given twice counts twice


def test_image_functions_run_where_the_package_is_not_installed():
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pitchside.session import get_session\nfrom pitchside.operators.grid import image_cells\n"
            "s = get_session('local[1]', 1)\n"
            "i = s.createDataFrame([(('o', 10, 10, 1, 0, bytes(100)), 1)], 'image struct<origin string, height int, width int, nChannels int, mode int, data binary>, k int')\n"
            "print('CELLS', image_cells(i, keep=['k']).count())\n") % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PITCHSIDE_DRIVER_MEMORY": "1g"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(), env=env, capture_output=True, text=True, timeout=300)
    assert "CELLS 1" in out.stdout, out.stderr[-2000:]


def test_kept_and_rejected_images_are_all_images(spark):
    good = ["Team Alpha", "45.7", "44.2", "47.9", "Team Beta", "50.1", "51.2", "52.3"]
    third = ["Team Beta", "1.1", "1.2", "1.3", "Team Gamma", "2.1", "2.2", "2.3", "Team Alpha", "3.1", "3.2", "3.3"]
    tables = {"ok": good, "none": ["Team Beta", "1.1", "1.2", "1.3"], "third": third, "short": good}
    t = spark.createDataFrame([(i, k, x) for i, texts in tables.items() for k, x in enumerate(texts)], "image_id string, seq int, text string")
    lines = [(i, c, float(k), k, str(k)) for i in tables for c in ("black", "blue") for k in range(5 if i == "short" else 6)]
    lt = spark.createDataFrame(lines, "image_id string, section string, x double, seq int, text string")
    assert rows(formation_rejects(t, lt, team="alpha"), "image_id", "reason") == [
        ("none", "no row"), ("short", "fewer than six line values"), ("third", "row beyond the second")]
    assert rows(formation_rows(t, lt, team="alpha"), "image_id") == [("ok",)]


def test_lanes_neither_join_nor_shuffle_raw_tokens(spark):
    d = tempfile.mkdtemp(prefix="pitchside-tok-")
    spark.createDataFrame([("a", float(i % 7), i, f"{i} / 0.{i % 9}1 XG") for i in range(300)], "image_id string, x double, seq int, text string").write.mode("overwrite").parquet(d)
    plan = attack_lanes(spark.read.parquet(d))._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") <= 2 and "WindowGroupLimit" in plan


def test_prompt_numbers_need_no_large_generated_code(spark):
    values = [0.1, 1e16, -2.5e-5, 3.0, float("nan"), float("inf"), None, 123456789.123, 5e-324, 1 / 3, -0.0]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} double" for i in range(len(values))))
    got = with_py_str(df, {f"s{i}": (f"c{i}", "double") for i in range(len(values))}).collect()[0]
    assert [got[f"s{i}"] for i in range(len(values))] == ["nan" if v is None else repr(v) for v in values]


def test_resolve_team_can_require_a_match(spark):
    m = spark.createDataFrame([("2024-01-02", "Ohio State")], "date string, team string")
    assert rows(resolve_team(m, "ohio", 2024, require=True)) == [("Ohio State",)]
    with pytest.raises(Exception, match="no team contains"):
        resolve_team(m, "iowa", 2024, require=True).collect()


def test_report_listing_to_crop_plan(spark):
    root = tempfile.mkdtemp(prefix="pitchside-reports-")
    os.mkdir(os.path.join(root, "Penn State"))
    for f in ("Penn State - Iowa 1-0.pdf", "Indiana - Penn State 0-0.pdf", "skip.txt"):
        with open(os.path.join(root, "Penn State", f), "w") as h:
            h.write("x")
    listing = list_reports(spark, root)
    pages = spark.createDataFrame([(f"{root}/Penn State/Penn State - Iowa 1-0.pdf", 26)], "path string, page_count int")
    plan = crop_plan(report_catalog(with_page_counts(listing, pages), "Penn State"))
    got = plan.groupBy("file").agg(F.count("*").alias("n"), F.count("page").alias("paged")).orderBy("file").collect()
    # a report without a page count keeps the pages that do not depend on it
    assert [tuple(r) for r in got] == [("Indiana - Penn State 0-0.pdf", 5, got[0]["paged"]), ("Penn State - Iowa 1-0.pdf", 5, 5)]
    assert got[0]["paged"] < 5 and not glob.glob(os.path.join(root, "*.parquet"))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    from pitchside import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="shared folder"):
        session.ensure_checkpoint_dir(Session())


