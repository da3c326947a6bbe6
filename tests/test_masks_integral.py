import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchside import presets
from pitchside.operators.grid import accumulate, image_cells, image_colour_classes, image_sections
from pitchside.operators.integral import image_integrals, integral_cells
from pitchside.operators.masks import combined_masks, image_masks, mask_pixels
from pitchside.plans.reports import heatmaps, heatmaps_by_setting
from pitchside.sources.sinks import write_table

from conftest import rows

IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>, side string"


def _images(spark, n=40, seed=1):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w, c = int(r.integers(1, 25)), int(r.integers(1, 25)), (1 if i % 7 == 0 else 3)
        img = r.choice([0, 30, 71, 120, 160, 255], (h, w, c)).astype(np.uint8)
        if i % 3 == 0:
            img[:, :, 0] = 0 if i % 2 else 255
        out.append(((f"i{i}", h, w, c, 0, img.tobytes()), f"s{i % 2}"))
    out.append((("none", None, None, None, None, None), "s0"))
    return spark.createDataFrame(out, IMAGE)


def _arrays(images):
    return {r.image.origin: np.frombuffer(r.image.data, np.uint8).reshape(r.image.height, r.image.width, r.image.nChannels)
            for r in images.collect() if r.image.data is not None}


def _hsv(b, g, r):
    """8-bit hue, saturation, value of one pixel by the fixed-point rule."""
    v, d = max(b, g, r), max(b, g, r) - min(b, g, r)
    s = (d * (int(255 * 4096 / v + 0.5) if v else 0) + 2048) >> 12
    h = g - b if v == r else b - r + 2 * d if v == g else r - g + 4 * d
    h = (h * (int(180 * 4096 / (6 * d) + 0.5) if d else 0) + 2048) >> 12
    return h + 180 if h < 0 else h, s, v


def _pixels_of_class(img, name):
    lo, up = presets.HSV_RANGES[name]
    if img.shape[2] < 3:
        return set()
    return {(y, x) for y in range(img.shape[0]) for x in range(img.shape[1])
            if all(a <= v <= b for a, v, b in zip(lo, _hsv(*(int(k) for k in img[y, x])), up))}


def test_masks_hold_the_pixels_of_their_class(spark):
    images = _images(spark)
    masks = image_masks(images, keep=["side"])
    got = {(r.origin, r["class"]): r for r in masks.collect()}
    arrays = _arrays(images)
    assert len(got) == 2 * len(arrays)
    counts = {r.origin: r for r in image_colour_classes(images).collect()}
    cells = {}
    for r in mask_pixels(masks, keep=["side"]).collect():
        cells.setdefault((r.origin, r["class"]), set()).add((r.row, r.col))
    for o, img in arrays.items():
        for name in presets.HSV_RANGES:
            want, m = _pixels_of_class(img, name), got[o, name]
            assert cells.get((o, name), set()) == want and m.area == len(want) == counts[o][f"{name}_pixels"]
            box = (min(x for _, x in want), min(y for y, _ in want), max(x for _, x in want) + 1, max(y for y, _ in want) + 1) if want else (None,) * 4
            assert (m.x0, m.y0, m.x1, m.y1) == box
            assert all(a + n < b for a, n, b in zip(m.starts, m.lengths, m.starts[1:]))  # maximal runs
            assert m.side == f"s{int(o[1:]) % 2}"


@pytest.mark.parametrize("how, op", [("and", set.__and__), ("or", set.__or__), ("minus", set.__sub__)])
def test_masks_combine_on_their_runs(spark, how, op):
    images = _images(spark, seed=2)
    masks = image_masks(images, {"dark": ((0, 0, 0), (180, 255, 120)), "red": ((0, 50, 20), (60, 255, 255))})
    parts = {}
    for r in mask_pixels(masks).collect():
        parts.setdefault((r.origin, r["class"]), set()).add((r.row, r.col))
    both = combined_masks(masks, "dark", "red", how)
    got = {}
    for r in mask_pixels(both).collect():
        got.setdefault(r.origin, set()).add((r.row, r.col))
    measured = {r.origin: r for r in both.collect()}
    for o in _arrays(images):
        want = op(parts.get((o, "dark"), set()), parts.get((o, "red"), set()))
        assert got.get(o, set()) == want and measured[o].area == len(want) and measured[o]["class"] == f"dark_{how}_red"
    with pytest.raises(ValueError):
        combined_masks(masks, "dark", "red", "xor")


def test_masks_of_sections_and_empty_tables(spark):
    sections = image_sections(_images(spark, 8)).selectExpr("named_struct('origin', origin || '/' || section, 'height', height, 'width', width, 'nChannels', nChannels, 'mode', 0, 'data', data) AS image")
    assert image_masks(sections).count() == 2 * sections.where("image.height > 0 AND image.width > 0").count()
    none = image_masks(_images(spark).where("false"))
    assert none.count() == 0 and combined_masks(none, "black", "blue").count() == 0


SETTINGS = [("a", (1, 1), 0.5), ("b", (3, 2), 0.2), ("c", (10, 10), 0.1), ("d", (2, 5), 0.0)]


def test_integrals_equal_cells_for_every_setting(spark, tmp_path):
    images = _images(spark, seed=3)
    write_table(image_integrals(images, keep=["side"]), str(tmp_path / "integrals"))
    table = spark.read.parquet(str(tmp_path / "integrals"))
    cols = ["origin", "grid_rows", "grid_cols", "cell_row", "cell_col", "marked", "flag", "side"]
    got = integral_cells(table, SETTINGS, keep=["side"])
    for name, cell, fraction in SETTINGS:
        want = image_cells(images, cell, fraction, keep=["side"])
        assert rows(got.where(f"setting = '{name}'"), *cols) == rows(want, *cols)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "image#" not in plan  # the images themselves are not read again


def test_integrals_of_crops(spark):
    images = _images(spark, seed=4)
    crop = (0.1, 0.3, 0.9, 1.0)
    got = {}
    for r in integral_cells(image_integrals(images), [("graph", (2, 3), 0.25, crop)]).collect():
        got[r.origin, r.cell_row, r.cell_col] = (r.marked, r.flag, r.grid_rows, r.grid_cols)
    want = {}
    for o, img in _arrays(images).items():
        b, g, r = (img[:, :, min(k, img.shape[2] - 1)].astype(int) for k in range(3))
        gray = img[:, :, 0].astype(int) if img.shape[2] == 1 else (4899 * r + 9617 * g + 1868 * b + 8192) >> 14
        h, w = gray.shape
        mask = ((gray >= 255) | (gray <= 70))[int(h * 0.3):, int(w * 0.1):int(w * 0.9)]
        for y in range(mask.shape[0] // 2):
            for x in range(mask.shape[1] // 3):
                n = int(mask[2 * y:2 * y + 2, 3 * x:3 * x + 3].sum())
                want[o, y, x] = (n, int(n > 1.5), mask.shape[0] // 2, mask.shape[1] // 3)
    assert got == want


def test_heatmaps_of_settings_equal_one_by_one(spark):
    one = _images(spark, 1, seed=5)
    images = one
    for i in range(5):  # one shape for all
        images = images.unionAll(one.withColumn("side", F.lit(f"s{i % 2}")))
    got = heatmaps_by_setting(images, SETTINGS)
    for name, cell, fraction in SETTINGS:
        want = heatmaps(images, cell=cell, fraction=fraction)
        assert rows(got.where(f"setting = '{name}'"), "side", "cell_row", "cell_col", "hits") == rows(want, "side", "cell_row", "cell_col", "hits")
    assert accumulate(integral_cells(image_integrals(images.where("false"), keep=["side"]), SETTINGS, keep=["side"]), ["side"]).count() == 0
