import os
import random
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from pitchside.functions.pixels import hsv_from_bgr
from pitchside.operators.grid import (
    accumulate, colour_classes, crop_pixels, crop_sections, formation_boxes, grid_occupancy, image_cells, image_dims,
    marked_cells, scale_grid,
)
from pitchside.sources.readers import read_images

from conftest import rows

PX = "image_id string, side string, row int, col int, gray int"


def _image(img, marks, h=5, w=4, fill=128):
    """A 5x4 gray image with the listed (row, col) pixels set to 0 (in band)."""
    return [(img, "s", r, c, 0 if (r, c) in marks else fill) for r in range(h) for c in range(w)]


def _fixture(spark):
    bottom = {(4, c) for c in range(4)}                   # fifth row: dropped partial cells
    one = {(0, 0)}                                         # 1 marked pixel: 1 > 4 * 0.25 is false
    tr = {(0, 2), (0, 3)}                                  # cell (0, 1)
    br = {(2, 2), (3, 3)}                                  # cell (1, 1)
    bl = {(2, 0), (2, 1)}                                  # cell (1, 0)
    px = (_image("i1", bottom | one | tr | br | bl) + _image("i2", bottom | one | tr | br)
          + _image("i3", tr | br))
    return spark.createDataFrame(px, PX)


def test_grid_fixture(spark):
    g = grid_occupancy(_fixture(spark), cell=(2, 2), fraction=0.25, by=["side"])
    assert rows(g, "cell_row", "cell_col", "hits") == [(0, 0, 0), (0, 1, 3), (1, 0, 1), (1, 1, 3)]
    log = {(r["cell_row"], r["cell_col"]): r["scaled"] for r in scale_grid(g, "log").collect()}
    assert log == pytest.approx({(0, 0): 0.0, (0, 1): 1.386294, (1, 0): 0.693147, (1, 1): 1.386294}, abs=1e-6)
    mm = {(r["cell_row"], r["cell_col"]): r["scaled"] for r in scale_grid(g, "normalize").collect()}
    assert mm == pytest.approx({(0, 0): 0.0, (0, 1): 1.0, (1, 0): 1 / 3, (1, 1): 1.0})
    with pytest.raises(ValueError):
        scale_grid(g, "sqrt")


def test_band_bounds_are_inclusive(spark):
    px = spark.createDataFrame([("i", "s", 0, c, v) for c, v in enumerate([70, 71, 254, 255])], PX)
    cells = marked_cells(px, cell=(1, 1), fraction=0.5)
    assert rows(cells, "cell_col", "marked") == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_flat_grid_normalizes_to_null(spark):
    g = spark.createDataFrame([(0, 0, 2), (0, 1, 2)], "cell_row int, cell_col int, hits long")
    assert [r["scaled"] for r in scale_grid(g, "normalize").collect()] == [None, None]


def test_mixed_grid_shapes_fail(spark):
    px = spark.createDataFrame(_image("a", set()) + _image("b", set(), h=7), PX)
    with pytest.raises(Exception, match="different grid shapes"):
        grid_occupancy(px, cell=(2, 2), fraction=0.25, by=["side"]).collect()


def test_hsv_known_colours(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 0, 255), (0, 255, 0), (128, 128, 128), (0, 0, 0)],
                               "b int, g int, r int")
    got = [tuple(r["hsv"]) for r in df.select(hsv_from_bgr("b", "g", "r").alias("hsv")).collect()]
    assert got == [(120, 255, 255), (0, 255, 255), (60, 255, 255), (0, 0, 128), (0, 0, 0)]


def test_colour_classes_counts(spark):
    px = spark.createDataFrame([("i", 0, 0, 0), ("i", 255, 0, 0), ("i", 0, 0, 255), ("i", 200, 200, 200)],
                               "image_id string, b int, g int, r int")
    r = colour_classes(px).collect()[0]
    # black: V <= 100 -> only (0,0,0); "blue": H <= 130, S >= 50, V >= 150 -> pure blue and pure red
    assert (r["black_pixels"], r["blue_pixels"]) == (1, 2)


def test_formation_sections_by_fraction(spark):
    px = spark.createDataFrame([("i", "s", r, c, r * 10 + c) for r in range(10) for c in range(10)], PX)
    cut = crop_pixels(px, formation_boxes(image_dims(px)))
    counts = {r["section"]: r["count"] for r in cut.groupBy("section").count().collect()}
    assert counts == {"table": 3 * 10, "graph": 7 * 8}     # rows [0,3) ; rows [3,10) x cols [1,9)
    first = cut.filter("section = 'graph'").orderBy("row", "col").first()
    assert (first["row"], first["col"], first["gray"]) == (0, 0, 31)


# --- PNG files through the image source and the Arrow adapter ------------------

def _png(path, pixels):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\x00" + bytes(v for px in row for v in px) for row in pixels)

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_png_cells_equal_pixel_table(spark):
    rnd = random.Random(3)
    d = tempfile.mkdtemp(prefix="pitchside-png-")
    pixel_rows = []
    for k in range(6):
        img = [[tuple(rnd.choice([0, 60, 128, 200, 255]) for _ in range(3)) for _ in range(9)] for _ in range(7)]
        _png(os.path.join(d, f"cut_{k}.png"), img)
        for r, row in enumerate(img):
            for c, (red, green, blue) in enumerate(row):
                pixel_rows.append((f"cut_{k}.png", "s", r, c, blue, green, red))
    with open(os.path.join(d, "broken.png"), "wb") as f:
        f.write(b"not an image")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("skip me")
    images = read_images(spark, d).withColumn("side", F.lit("s"))
    cells = image_cells(images, cell=(2, 3), fraction=0.2, keep=["side"])
    from_png = accumulate(cells, by=["side"])
    px = spark.createDataFrame(pixel_rows, "image_id string, side string, row int, col int, b int, g int, r int")
    from pitchside.operators.grid import with_gray
    from_table = grid_occupancy(with_gray(px), cell=(2, 3), fraction=0.2, by=["side"])
    assert images.count() == 6
    assert rows(from_png, "cell_row", "cell_col", "hits") == rows(from_table, "cell_row", "cell_col", "hits")
    assert len(rows(from_table)) == (7 // 2) * (9 // 3)


def test_sections_of_pixels_equal_crops_by_boxes(spark):
    r = random.Random(9)
    px = [(f"i{i}", "s", y, x, r.randrange(256)) for i in range(12) for h, w in [(r.randrange(1, 14), r.randrange(1, 14))] for y in range(h) for x in range(w)]
    df = spark.createDataFrame(px, PX).repartition(5)
    got = crop_sections(df)
    want = crop_pixels(df, formation_boxes(image_dims(df)))
    cols = ("image_id", "section", "row", "col", "gray", "side")
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning") == 1
    assert crop_sections(df.where("false")).count() == 0
