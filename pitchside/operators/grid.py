"""Pixels -> marked cells -> accumulated heatmap.

Two entry points share the same semantics:

* ``grid_occupancy`` works on a pixel *table* (one row per pixel, e.g. data
  that already is points). Pixels are reduced to (image, cell) counts by a hash
  aggregate with map-side partial aggregation, so the shuffle carries cells,
  not pixels.
* ``image_cells`` works on Spark ``image`` rows. Raw images are never exploded:
  an Arrow batch function reduces each image to its cell counts inside the
  task (NumPy), and only cells are shuffled.

A cell is marked when more than ``fraction`` of its pixels are in the gray
band; partial edge cells are dropped; flags are summed over images per group
(e.g. own team / rivals) into ``hits``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.pixels import (
    B2Y, G2Y, HSV_SHIFT, HUE_RANGE, R2Y, YUV_SHIFT, band_mask_sql, gray_sql, hsv_sql, in_hsv_range_sql,
)
from pitchside.functions.sql import dbl, expr, q, run_sql

SCALE_METHODS = ("log", "normalize")


def with_gray(pixels: DataFrame, b: str = "b", g: str = "g", r: str = "r", out: str = "gray") -> DataFrame:
    """G1: 8-bit gray from BGR channels."""
    return pixels.withColumn(out, expr(gray_sql(q(b), q(g), q(r))))


def image_dims(pixels: DataFrame, image_col: str = "image_id", row_col: str = "row",
               col_col: str = "col") -> DataFrame:
    """Height and width of every image of a complete pixel table."""
    img = q(image_col)
    return run_sql({"px": pixels}, f"SELECT {img}, max({q(row_col)}) + 1 AS height, max({q(col_col)}) + 1 AS width "
                                   f"FROM {{px}} GROUP BY {img}")


def marked_cells(pixels: DataFrame, cell: tuple[int, int] = presets.GRID_CELL,
                 fraction: float = presets.GRID_FRACTION, band: tuple[int, int] = presets.GRAY_BAND,
                 image_col: str = "image_id", by: Sequence[str] = (), gray_col: str = "gray",
                 row_col: str = "row", col_col: str = "col", dims: DataFrame | None = None) -> DataFrame:
    """G2-G4 on a pixel table -> ``image, by..., cell_row, cell_col, marked, grid_rows, grid_cols, flag``.

    ``dims`` (``image_col, height, width``) defaults to the extent of the
    pixels. Cells at or beyond ``height // ch`` / ``width // cw`` are dropped.
    """
    ch, cw = cell
    lo, hi = band
    img = q(image_col)
    grp = "".join(f"{q(b)}, " for b in by)
    sources = {"px": pixels}
    steps = [
        ("cells", f"""SELECT {img}, {grp}cell_row, cell_col, sum(__m) AS marked, max(__r) AS __r, max(__c) AS __c FROM (
  SELECT {img}, {grp}CAST(floor({q(row_col)} / {ch}) AS INT) AS cell_row, {q(row_col)} AS __r, {q(col_col)} AS __c,
         CAST(floor({q(col_col)} / {cw}) AS INT) AS cell_col, {band_mask_sql(q(gray_col), lo, hi)} AS __m
  FROM {{px}})
GROUP BY {img}, {grp}cell_row, cell_col"""),
    ]
    if dims is not None:
        sources["dims"] = dims
        sized = f"""SELECT c.*, CAST(d.height / {ch} AS INT) AS grid_rows, CAST(d.width / {cw} AS INT) AS grid_cols
FROM {{cells}} c JOIN {{dims}} d ON c.{img} = d.{img}"""
    else:
        # the extent of an image from its cells, so the pixels are read once
        sized = f"""SELECT *, CAST((max(__r) OVER (PARTITION BY {img}) + 1) / {ch} AS INT) AS grid_rows,
       CAST((max(__c) OVER (PARTITION BY {img}) + 1) / {cw} AS INT) AS grid_cols FROM {{cells}}"""
    steps.append(("sized", sized))
    sql = f"""SELECT * EXCEPT (__r, __c), CAST(marked > {dbl(ch * cw * fraction)} AS INT) AS flag
FROM {{sized}} WHERE cell_row < grid_rows AND cell_col < grid_cols"""
    return run_sql(sources, sql, steps)


def accumulate(cells: DataFrame, by: Sequence[str] = (), check_shape: bool = True, dense: bool = False) -> DataFrame:
    """``hits`` = number of images whose cell is marked, per group and cell.

    All images of a group must share one grid shape; otherwise evaluation
    fails (the reference silently broadcasts or crashes). Counts are BIGINT
    (exact), not float32. Plain, this is one aggregate (also on streams) over
    the cells there are; ``dense`` adds the cells of the group's shape in which
    no image has pixels, as 0.
    """
    grp = "".join(f"{q(b)}, " for b in by)
    key = f"GROUP BY {grp.rstrip(', ')}" if by else ""
    shape = "named_struct('r', grid_rows, 'c', grid_cols)"
    error = "raise_error('images of one group have different grid shapes')"
    if not dense:
        hits = f"CASE WHEN min({shape}) <> max({shape}) THEN {error} ELSE sum(flag) END" if check_shape else "sum(flag)"
        return run_sql({"cells": cells}, f"SELECT {grp}cell_row, cell_col, CAST({hits} AS BIGINT) AS hits FROM {{cells}} "
                                         f"GROUP BY {grp}cell_row, cell_col")
    checked = f"CASE WHEN min(__lo) <> max(__hi) THEN {error} ELSE max(__hi) END" if check_shape else "max(__hi)"
    steps = [
        ("hits", f"""SELECT {grp}cell_row, cell_col, CAST(sum(flag) AS BIGINT) AS __h, min({shape}) AS __lo, max({shape}) AS __hi
FROM {{cells}} GROUP BY {grp}cell_row, cell_col"""),
        # the cells of a group are bounded by the image size, not by the number of images
        ("shaped", f"""SELECT {grp}{checked} AS __s, collect_list(named_struct('r', CAST(cell_row AS BIGINT), 'c', cell_col, 'h', __h)) AS __l
FROM {{hits}} {key}"""),
        ("filled", f"""SELECT {grp}inline(concat(__l, transform(sequence(0, __s.r * __s.c - 1),
         i -> named_struct('r', i div __s.c, 'c', i % __s.c, 'h', 0L)))) AS (cell_row, cell_col, __h)
FROM {{shaped}} WHERE __s.r * __s.c > 0"""),
    ]
    sql = f"""SELECT {grp}CAST(cell_row AS INT) AS cell_row, cell_col, sum(__h) AS hits FROM {{filled}}
GROUP BY {grp}cell_row, cell_col"""
    return run_sql({"cells": cells}, sql, steps)


def grid_occupancy(pixels: DataFrame, cell: tuple[int, int] = presets.GRID_CELL,
                   fraction: float = presets.GRID_FRACTION, band: tuple[int, int] = presets.GRAY_BAND,
                   image_col: str = "image_id", by: Sequence[str] = (), gray_col: str = "gray",
                   row_col: str = "row", col_col: str = "col", dims: DataFrame | None = None) -> DataFrame:
    """G2-G5 (and G10 with ``by=["side"]``): accumulated grid per group, every cell of its shape."""
    cells = marked_cells(pixels, cell, fraction, band, image_col, by, gray_col, row_col, col_col, dims)
    return accumulate(cells, by, dense=True)


def scale_grid(grid: DataFrame, method: str = "log", by: Sequence[str] = (),
               value: str = "hits", out: str = "scaled") -> DataFrame:
    """``log1p`` or min-max per group (flat grid -> NULL, not NaN)."""
    if method not in SCALE_METHODS:
        raise ValueError("Unsupported scaling method. Use 'log' or 'normalize'.")
    v = f"CAST({q(value)} AS DOUBLE)"
    if method == "log":
        return grid.selectExpr("*", f"log1p({v}) AS {q(out)}")
    # a grid holds at most (height / ch) x (width / cw) cells per group, bounded
    # by the image size and not by the number of images, so a window over a
    # group's cells is small
    w = f"OVER (PARTITION BY {', '.join(q(b) for b in by)})" if by else "OVER ()"
    return grid.selectExpr("*", f"try_divide({v} - min({v}) {w}, max({v}) {w} - min({v}) {w}) AS {q(out)}")


# ---------------------------------------------------------------------------
# Spark `image` rows -> cell counts (Arrow, inside the task)
# ---------------------------------------------------------------------------

CELL_SCHEMA = ("origin string, grid_rows int, grid_cols int, cell_row int, cell_col int, "
               "marked int, flag int")


def per_image(images: DataFrame, image_field: str, keep: Sequence[str], schema: str, names: Sequence[str], reduce) -> DataFrame:
    """One pass over Spark ``image`` rows: ``reduce(origin, array)`` gives columns (lists or arrays of one length)
    per image, each decoded once; ``keep`` columns are repeated beside them. Rows without image data give nothing.

    All functions that run in tasks are nested ones and go there by value: workers need numpy and pyarrow only."""
    types = {f.name: f.dataType.simpleString() for f in images.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            imgs = batch.column(0)
            fields = [imgs.field(x).to_pylist() for x in ("origin", "height", "width", "nChannels", "data")]
            for i, (o, h, w, c, d) in enumerate(zip(*fields)):
                if d is None or h is None or h <= 0 or w <= 0:
                    continue
                cols = reduce(o, np.frombuffer(d, dtype=np.uint8).reshape(h, w, c))
                n = len(cols[0])
                if n:
                    kept = [batch.column(1 + j).take(pa.array([i] * n)) for j in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *kept], [*names, *keep])

    more = "".join(f", {q(k)} {types[k]}" for k in keep)
    return images.select(image_field, *keep).mapInArrow(run, schema + more)


def gray_function():
    """G1 of an image array, as a nested function (see ``per_image``)."""
    r2y, g2y, b2y, shift = R2Y, G2Y, B2Y, YUV_SHIFT

    def gray(img):
        if img.shape[2] == 1:
            return img[:, :, 0].astype(np.int32)
        b, g, r = (img[:, :, k].astype(np.int32) for k in range(3))
        return (r * r2y + g * g2y + b * b2y + (1 << (shift - 1))) >> shift

    return gray


def hsv_function():
    """8-bit hue, saturation and value of an image array of three channels, as a nested function."""
    hue, one, shift = HUE_RANGE, 1 << HSV_SHIFT, HSV_SHIFT

    def hsv(img):
        b, g, r = (img[:, :, k].astype(np.int64) for k in range(3))
        v = np.maximum(np.maximum(r, g), b)
        diff = v - np.minimum(np.minimum(r, g), b)
        sdiv = np.where(v == 0, 0, np.floor(255.0 * one / np.maximum(v, 1) + 0.5)).astype(np.int64)
        s = (diff * sdiv + one // 2) >> shift
        raw = np.where(v == r, g - b, np.where(v == g, b - r + 2 * diff, r - g + 4 * diff))
        hdiv = np.where(diff == 0, 0, np.floor(float(hue * one) / np.maximum(diff * 6, 1) + 0.5)).astype(np.int64)
        h = (raw * hdiv + one // 2) >> shift
        return np.where(h < 0, h + hue, h), s, v

    return hsv


def image_cells(images: DataFrame, cell: tuple[int, int] = presets.GRID_CELL,
                fraction: float = presets.GRID_FRACTION, band: tuple[int, int] = presets.GRAY_BAND,
                image_field: str = "image", keep: Sequence[str] = ()) -> DataFrame:
    """S4, G1-G4 on Spark ``image`` rows -> one row per (image, cell), with the ``keep`` columns
    (e.g. a side derived from the path). An image given twice counts twice."""
    ch, cw = cell
    lo, hi = band
    to_gray = gray_function()

    def cells(origin, img):
        gray = to_gray(img)
        gr, gc = img.shape[0] // ch, img.shape[1] // cw
        mask = ((gray >= hi) | (gray <= lo)).astype(np.int32)
        counts = mask[: gr * ch, : gc * cw].reshape(gr, ch, gc, cw).sum(axis=(1, 3)).ravel().astype(np.int32)
        rr, cc = np.meshgrid(np.arange(gr, dtype=np.int32), np.arange(gc, dtype=np.int32), indexing="ij")
        n = gr * gc
        return ([origin] * n, np.full(n, gr, np.int32), np.full(n, gc, np.int32), rr.ravel(), cc.ravel(), counts,
                (counts > ch * cw * fraction).astype(np.int32))

    return per_image(images, image_field, keep, CELL_SCHEMA, [c.split()[0] for c in CELL_SCHEMA.split(", ")], cells)


def image_colour_classes(images: DataFrame, ranges=presets.HSV_RANGES, image_field: str = "image",
                         keep: Sequence[str] = ()) -> DataFrame:
    """G9 on Spark ``image`` rows: ``origin, <name>_pixels..., keep...``; gray images have no colour classes."""
    limits = list(ranges.items())
    to_hsv = hsv_function()

    def classes(origin, img):
        if img.shape[2] < 3:
            return ([origin], *([0] for _ in limits))
        hsv = to_hsv(img)
        return ([origin], *([int(np.logical_and.reduce([(x >= lo[i]) & (x <= up[i]) for i, x in enumerate(hsv)]).sum())] for _, (lo, up) in limits))

    names = ["origin", *(f"{name}_pixels" for name, _ in limits)]
    return per_image(images, image_field, keep, "origin string, " + ", ".join(f"{n} bigint" for n in names[1:]), names, classes)


def image_sections(images: DataFrame, image_field: str = "image", keep: Sequence[str] = (),
                   top: float = presets.FORMATION_TOP_FRACTION, bottom_from: float = presets.FORMATION_BOTTOM_FROM,
                   x_range: tuple[float, float] = presets.FORMATION_X_RANGE) -> DataFrame:
    """C10 on Spark ``image`` rows: the ``table`` and the ``graph`` section of each formation crop (the boxes of
    ``formation_boxes``) as image rows ``origin, section, height, width, nChannels, data, keep...``."""
    left, right = x_range

    def cut(origin, img):
        h, w = img.shape[:2]
        parts = [img[: int(h * top)], img[int(h * bottom_from):, int(w * left): int(w * right)]]
        return ([origin] * 2, ["table", "graph"], np.array([p.shape[0] for p in parts], np.int32), np.array([p.shape[1] for p in parts], np.int32),
                np.array([img.shape[2]] * 2, np.int32), [p.tobytes() for p in parts])

    schema = "origin string, section string, height int, width int, nChannels int, data binary"
    return per_image(images, image_field, keep, schema, [c.split()[0] for c in schema.split(", ")], cut)


# ---------------------------------------------------------------------------
# colour classes and crops
# ---------------------------------------------------------------------------

def colour_classes(pixels: DataFrame, ranges=presets.HSV_RANGES, image_col: str = "image_id",
                   by: Sequence[str] = (), b: str = "b", g: str = "g", r: str = "r") -> DataFrame:
    """Per image, the number of pixels inside each HSV range (inclusive).

    8-bit hue is 0..179, so the black range's hue and saturation limits do not
    restrict anything, and "blue" (hue <= 130) spans red to blue, as written.
    """
    h, s, v = hsv_sql(q(b), q(g), q(r))
    grp = "".join(f"{q(x)}, " for x in by)
    img = q(image_col)
    flags = ", ".join(f"CAST({in_hsv_range_sql('__h', '__s', '__v', lo, hi)} AS INT) AS __{name}"
                      for name, (lo, hi) in ranges.items())
    sums = ", ".join(f"CAST(sum(__{name}) AS BIGINT) AS {name}_pixels" for name in ranges)
    steps = [("hsv", f"SELECT {img}, {grp}{h} AS __h, {s} AS __s, {v} AS __v FROM {{px}}")]
    return run_sql({"px": pixels}, f"SELECT {img}, {grp}{sums} FROM (SELECT {img}, {grp}{flags} FROM {{hsv}}) "
                                   f"GROUP BY {img}, {grp.rstrip(', ')}" if by else
                   f"SELECT {img}, {sums} FROM (SELECT {img}, {flags} FROM {{hsv}}) GROUP BY {img}", steps)


def crop_pixels(pixels: DataFrame, boxes: DataFrame, image_col: str = "image_id",
                row_col: str = "row", col_col: str = "col") -> DataFrame:
    """Keep pixels inside ``[x0, x1) x [y0, y1)`` per image and re-base them.

    ``boxes``: ``image_col, section, x0, y0, x1, y1`` (one or more boxes per
    image; a pixel inside several boxes appears once per box).
    """
    img, rc, cc = q(image_col), q(row_col), q(col_col)
    other = [c for c in pixels.columns if c not in (image_col, row_col, col_col)]
    bcols = [c for c in boxes.columns if c not in (image_col, "x0", "y0", "x1", "y1")]
    sel = ", ".join([f"p.{img}", *[f"b.{q(c)}" for c in bcols], f"p.{rc} - b.y0 AS {rc}",
                     f"p.{cc} - b.x0 AS {cc}", *[f"p.{q(c)}" for c in other]])
    return run_sql({"px": pixels, "boxes": boxes}, f"""SELECT {sel} FROM {{px}} p JOIN {{boxes}} b ON p.{img} = b.{img}
WHERE p.{cc} >= b.x0 AND p.{cc} < b.x1 AND p.{rc} >= b.y0 AND p.{rc} < b.y1""")


def crop_sections(pixels: DataFrame, image_col: str = "image_id", row_col: str = "row", col_col: str = "col",
                  top: float = presets.FORMATION_TOP_FRACTION, bottom_from: float = presets.FORMATION_BOTTOM_FROM,
                  x_range: tuple[float, float] = presets.FORMATION_X_RANGE) -> DataFrame:
    """C10 on a complete pixel table: the pixels of both sections (``formation_boxes``) of every image, re-based.

    The extent of an image comes from a window over its own pixels, so they are read once, shuffled once by image and joined with
    nothing; ``crop_pixels`` is for boxes from elsewhere."""
    img, rc, cc = q(image_col), q(row_col), q(col_col)
    other = "".join(f", {q(c)}" for c in pixels.columns if c not in (image_col, row_col, col_col))
    h, w = "CAST(__h AS DOUBLE)", "CAST(__w AS DOUBLE)"
    boxes = (f"array(named_struct('section', 'table', 'x0', 0, 'y0', 0, 'x1', CAST(__w AS INT), 'y1', CAST({h} * {dbl(top)} AS INT)), "
             f"named_struct('section', 'graph', 'x0', CAST({w} * {dbl(x_range[0])} AS INT), 'y0', CAST({h} * {dbl(bottom_from)} AS INT), "
             f"'x1', CAST({w} * {dbl(x_range[1])} AS INT), 'y1', CAST(__h AS INT)))")
    steps = [("sized", f"SELECT *, max({rc}) OVER (PARTITION BY {img}) + 1 AS __h, max({cc}) OVER (PARTITION BY {img}) + 1 AS __w FROM {{px}}"),
             ("cut", f"SELECT *, explode(filter({boxes}, b -> {cc} >= b.x0 AND {cc} < b.x1 AND {rc} >= b.y0 AND {rc} < b.y1)) AS __b FROM {{sized}}")]
    return run_sql({"px": pixels}, f"SELECT {img}, __b.section AS section, {rc} - __b.y0 AS {rc}, {cc} - __b.x0 AS {cc}{other} FROM {{cut}}", steps)


def formation_boxes(dims: DataFrame, image_col: str = "image_id",
                    top: float = presets.FORMATION_TOP_FRACTION,
                    bottom_from: float = presets.FORMATION_BOTTOM_FROM,
                    x_range: tuple[float, float] = presets.FORMATION_X_RANGE) -> DataFrame:
    """The two sections of a formation crop by fraction (``int()`` truncates).

    table: rows ``[0, int(h*0.37))``, all columns; graph: rows
    ``[int(h*0.3), h)``, columns ``[int(w*0.1), int(w*0.9))``. They overlap.
    """
    img = q(image_col)
    h, w = "CAST(height AS DOUBLE)", "CAST(width AS DOUBLE)"
    return run_sql({"dims": dims}, f"""SELECT {img}, 'table' AS section, 0 AS x0, 0 AS y0, CAST(width AS INT) AS x1,
       CAST({h} * {dbl(top)} AS INT) AS y1 FROM {{dims}}
UNION ALL
SELECT {img}, 'graph' AS section, CAST({w} * {dbl(x_range[0])} AS INT) AS x0,
       CAST({h} * {dbl(bottom_from)} AS INT) AS y0, CAST({w} * {dbl(x_range[1])} AS INT) AS x1,
       CAST(height AS INT) AS y1 FROM {{dims}}""")
