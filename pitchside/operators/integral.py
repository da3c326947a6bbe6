"""Summed-area tables of images: one decode, any grid afterwards.

``image_integrals`` turns every Spark ``image`` row into the running sums of its
marked pixels (gray band) over rows and columns. Written once as a table, they give the
marks of any rectangle by four look-ups, so ``integral_cells`` answers every cell
size, fraction and crop in one narrow pass over that table; images are not decoded
again. The result equals ``image_cells`` for each setting.

A row holds (height + 1) x (width + 1) whole numbers of four bytes (about 4 MB for
a shot-map cut; runs of equal sums compress well in Parquet).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import q
from pitchside.operators.grid import gray_function, per_image

INTEGRAL_SCHEMA = "origin string, height int, width int, sums binary"
SETTING_SCHEMA = "origin string, setting string, grid_rows int, grid_cols int, cell_row int, cell_col int, marked int, flag int"


def image_integrals(images: DataFrame, band: tuple[int, int] = presets.GRAY_BAND, image_field: str = "image", keep: Sequence[str] = ()) -> DataFrame:
    """``origin, height, width, sums, keep...``: ``sums`` holds little-endian unsigned four-byte numbers, row by row; the number at
    (r, c) counts the marked pixels above row r and left of column c."""
    lo, hi = band
    to_gray = gray_function()

    def integral(origin, img):
        gray = to_gray(img)
        h, w = gray.shape
        sums = np.zeros((h + 1, w + 1), "<u4")
        sums[1:, 1:] = ((gray >= hi) | (gray <= lo)).cumsum(axis=0).cumsum(axis=1)
        return [origin], np.array([h], np.int32), np.array([w], np.int32), [sums.tobytes()]

    return per_image(images, image_field, keep, INTEGRAL_SCHEMA, [c.split()[0] for c in INTEGRAL_SCHEMA.split(", ")], integral)


def integral_cells(integrals: DataFrame, settings: Sequence[tuple], keep: Sequence[str] = ()) -> DataFrame:
    """G3-G4 for several settings at once: ``origin, setting, grid_rows, grid_cols, cell_row, cell_col, marked, flag, keep...``.

    A setting is (name, (cell height, cell width), fraction) or, with a crop as fractions of the image, (name, cell, fraction,
    (left, top, right, bottom)); crop edges are truncated to whole pixels, partial edge cells are dropped."""
    asked = [(s[0], s[1], float(s[2]), s[3] if len(s) > 3 else (0.0, 0.0, 1.0, 1.0)) for s in settings]
    types = {f.name: f.dataType.simpleString() for f in integrals.schema.fields}
    names = [c.split()[0] for c in SETTING_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            origin, height, width, sums = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                h, w = height[i].as_py(), width[i].as_py()
                table = np.frombuffer(sums[i].as_buffer(), "<u4").reshape(h + 1, w + 1)
                for name, (ch, cw), fraction, (left, top, right, bottom) in asked:
                    x0, y0, x1, y1 = int(w * left), int(h * top), int(w * right), int(h * bottom)
                    gr, gc = max(y1 - y0, 0) // ch, max(x1 - x0, 0) // cw
                    n = gr * gc
                    if not n:
                        continue
                    corner = table[y0:y0 + gr * ch + 1:ch, x0:x0 + gc * cw + 1:cw].astype(np.int64)
                    marked = (corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]).ravel().astype(np.int32)
                    rows, cols = np.divmod(np.arange(n, dtype=np.int32), np.int32(gc))
                    same = pa.array(np.full(n, i))
                    yield pa.RecordBatch.from_arrays(
                        [origin.take(same), pa.array([name] * n, pa.string()), pa.array(np.full(n, gr, np.int32)), pa.array(np.full(n, gc, np.int32)), pa.array(rows), pa.array(cols),
                         pa.array(marked), pa.array((marked > ch * cw * fraction).astype(np.int32)), *(batch.column(4 + j).take(same) for j in range(len(keep)))], names=[*names, *keep])

    more = "".join(f", {q(k)} {types[k]}" for k in keep)
    return integrals.select("origin", "height", "width", "sums", *keep).mapInArrow(run, SETTING_SCHEMA + more)
