import os
import tempfile

from pitchside.operators.catalog import crop_plan, find_team_folder, report_catalog, report_catalogs, team_folders
from pitchside.sources.readers import list_reports

from conftest import rows

FILES = [
    ("Penn State", "Penn State - Ohio State 2-1.pdf", 24),
    ("Penn State", "Indiana - Penn State 0-0.pdf", 26),
    ("Penn State", "Northwestern - Penn State.pdf", 24),
    ("Penn State", "Ohio State - Purdue.pdf", 24),
    ("Penn State", "notes.PDF", 24),
    ("Penn State", "nodash.pdf", 24),
    ("Pennsylvania Archive", "Penn State - Iowa.pdf", 24),
]


def _listing(spark):
    return spark.createDataFrame([(f"/r/{d}/{f}", n) for d, f, n in FILES], "path string, page_count int")


def test_catalog_fixture(spark):
    cat = report_catalog(_listing(spark), "Penn State", own_team="northwestern")
    got = rows(cat, "file", "team_1", "team_2", "team_slot", "other_team", "image_index")
    assert got == [("Indiana - Penn State 0-0.pdf", "Indiana", "Penn State 0", 2, "Indiana", 1),
                   ("Penn State - Ohio State 2-1.pdf", "Penn State", "Ohio State 2", 1, "Ohio State 2", 2)]


def test_crop_plan_fixture(spark):
    plan = crop_plan(report_catalog(_listing(spark), "Penn State", own_team="northwestern"))
    by = {(r["image_index"], r["crop_no"]): r for r in plan.collect()}
    assert [by[(2, i)]["page"] for i in (1, 2, 3, 4)] == [10, 4, 11, 4]
    assert [by[(1, i)]["page"] for i in (1, 2, 3, 4)] == [13, 4, 12, 4]     # slot 2, 26 pages
    r = by[(2, 1)]
    assert (r["x0"], r["y0"], r["x1"], r["y1"]) == (41, 1458, 1187, 2354)  # truncated
    f = by[(2, 5)]
    assert (f["x0"], f["y0"], f["x1"], f["y1"], f["page"]) == (21, 2375, 833, 3146, 3)   # rounded
    assert r["out_name"] == "shooting_map_2_Penn State_against_Ohio State 2.png"
    assert by[(2, 4)]["out_name"] == "shooting_side_2_Ohio State 2_against_Penn State.png"
    assert f["out_name"] == "avg_formation_2_Penn State_Ohio State 2.png"
    assert (by[(1, 2)]["x0"], by[(1, 2)]["side"]) == (int(308 * 300 / 72), "home_team")   # slot 2 swaps


def test_catalogs_of_many_teams_equal_one_by_one(spark):
    extra = [("Ohio State", "Ohio State - Iowa.pdf", 24), ("ohio archive", "Ohio State - Purdue 1-1.pdf", 25), ("İstanbul", "İstanbul - Ohio State.pdf", 24)]
    files = _listing(spark).unionAll(spark.createDataFrame([(f"/r/{d}/{f}", n) for d, f, n in extra], "path string, page_count int"))
    names = ["Penn State", "Ohio State", "Iowa", "  penn  State ", "İstanbul", "Zzz", "a", "o", ""]
    teams = spark.createDataFrame([(n,) for n in names + ["Iowa", None]], "team string")
    got = report_catalogs(files, teams, own_team="northwestern")
    cols = ["team", "folder", "file", "team_1", "team_2", "team_slot", "other_team", "image_index", "page_count"]
    want = [r for n in names if n.strip() for r in rows(report_catalog(files, n, own_team="northwestern"), *cols)]
    assert rows(got, *cols) == sorted(want, key=repr) and len(want) > 5
    folders = {r.team: r.folder for r in team_folders(files.selectExpr("split(path, '/')[2] AS folder"), teams).collect()}
    for n in names:
        one = find_team_folder(files.selectExpr("split(path, '/')[2] AS folder"), n).collect() if n.strip() else []
        assert folders.get(n) == (one[0].folder if one else None)


def test_catalog_lists_once(spark):
    """The listing is evaluated once, whatever it costs."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    listing = _listing(spark).mapInArrow(count, "path string, page_count int")
    assert report_catalog(listing, "Penn State", own_team="northwestern").count() == 2
    assert seen.value == len(FILES)
    report_catalogs(listing, spark.createDataFrame([("Penn State",), ("Iowa",)], "team string")).collect()
    assert seen.value == 2 * len(FILES)


def test_no_matching_folder_is_empty(spark):
    assert report_catalog(_listing(spark), "Zzz Team").count() == 0


def test_binary_listing_is_case_sensitive_and_reads_no_content(spark):
    root = tempfile.mkdtemp(prefix="pitchside-reports-")
    for d, f, _ in FILES:
        os.makedirs(os.path.join(root, d), exist_ok=True)
        with open(os.path.join(root, d, f), "wb") as fh:
            fh.write(b"%PDF-1.4 stub")
    listing = list_reports(spark, root)
    names = sorted(os.path.basename(r["path"]) for r in listing.collect())
    assert "notes.PDF" not in names and len(names) == 6
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]
