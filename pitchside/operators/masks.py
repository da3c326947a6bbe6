"""Line masks of formation crops as run-length coded bitmaps.

``image_masks`` keeps, for every image and colour class, which pixels are in the
class: runs of pixels in row-major order (a line of a figure is a few hundred runs,
however large the crop is), with area and bounding box. Masks are combined on
their runs (``combined_masks``); no pixel is read or made again. Rows grow with
images x classes, and a mask is bounded by its image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pitchside import presets
from pitchside.functions.sql import q, run_sql
from pitchside.operators.grid import hsv_function, per_image

MASK_SCHEMA = ("origin string, class string, height int, width int, area bigint, x0 int, y0 int, x1 int, y1 int, "
               "starts array<bigint>, lengths array<bigint>")
_NAMES = [c.split()[0] for c in MASK_SCHEMA.split(", ")]


def _measure():
    """Area and bounding box (x0, y0, x1, y1; ends exclusive, None when empty) of runs, as a nested function for tasks."""
    def measure(starts, lengths, width):
        if not len(starts):
            return 0, None, None, None, None
        last = starts + lengths - 1
        top, bottom = int(starts[0] // width), int(last[-1] // width) + 1
        wraps = starts // width != last // width  # a run over the end of a row reaches both sides
        left = 0 if wraps.any() else int((starts % width).min())
        right = width if wraps.any() else int((last % width).max()) + 1
        return int(lengths.sum()), left, top, right, bottom

    return measure


def image_masks(images: DataFrame, ranges=presets.HSV_RANGES, image_field: str = "image", keep: Sequence[str] = ()) -> DataFrame:
    """G9 on Spark ``image`` rows: one row per image and class with the mask of the class and the ``keep`` columns.

    Gray images have empty masks; an image given twice has its masks twice."""
    limits = list(ranges.items())
    to_hsv, measure = hsv_function(), _measure()

    def masks(origin, img):
        height, width = img.shape[:2]
        cols = [[] for _ in range(11)]
        hsv = to_hsv(img) if img.shape[2] >= 3 else None
        for name, (lo, up) in limits:
            inside = np.zeros(height * width + 2, np.int8)
            if hsv is not None:
                inside[1:-1] = np.logical_and.reduce([(x >= lo[i]) & (x <= up[i]) for i, x in enumerate(hsv)]).ravel()
            edge = np.diff(inside)
            starts = np.flatnonzero(edge == 1)
            lengths = np.flatnonzero(edge == -1) - starts
            for col, x in zip(cols, (origin, name, height, width, *measure(starts, lengths, width), starts, lengths)):
                col.append(x)
        ints = {2, 3, 5, 6, 7, 8}
        return [pa.array(c, pa.int32()) if i in ints else pa.array(c, pa.list_(pa.int64())) if i > 8 else c for i, c in enumerate(cols)]

    return per_image(images, image_field, keep, MASK_SCHEMA, _NAMES, masks)


def combined_masks(masks: DataFrame, one: str, other: str, how: str = "and", name: str | None = None, keep: Sequence[str] = (),
                   key: Sequence[str] = ("origin",)) -> DataFrame:
    """Masks of class ``one`` and ``other`` of each image combined on their runs: ``and``, ``or`` or ``minus``.

    An equality join on the image (``key``), then one merge of two run lists per row. Masks of different sizes do not meet;
    ``name`` (default ``one_how_other``) is the class of the result, ``keep`` columns are taken from ``one``."""
    if how not in ("and", "or", "minus"):
        raise ValueError("how must be 'and', 'or' or 'minus'")
    label = name or f"{one}_{how}_{other}"
    measure = _measure()
    kept = "".join(f", a.{q(k)}" for k in keep)
    on = " AND ".join(f"a.{q(k)} <=> b.{q(k)}" for k in key)
    pairs = run_sql({"m": masks}, f"""SELECT a.origin, a.height, a.width, a.starts AS s1, a.lengths AS l1, b.starts AS s2, b.lengths AS l2{kept}
FROM (SELECT * FROM {{m}} WHERE class = '{one}') a JOIN (SELECT * FROM {{m}} WHERE class = '{other}') b
  ON {on} AND a.height = b.height AND a.width = b.width""")
    types = {f.name: f.dataType.simpleString() for f in masks.schema.fields}

    def covered(points, starts, lengths):
        # whether the stretch behind each point lies in a run
        return np.searchsorted(starts, points, "right") > np.searchsorted(starts + lengths, points, "right")

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(11)]
            origin, height, width = (batch.column(i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                s1, l1, s2, l2 = (np.array(batch.column(c)[i].as_py(), np.int64) for c in ("s1", "l1", "s2", "l2"))
                points = np.unique(np.concatenate([s1, s1 + l1, s2, s2 + l2]))
                a, b = covered(points, s1, l1), covered(points, s2, l2)
                inside = np.r_[False, a & b if how == "and" else a | b if how == "or" else a & ~b, False].astype(np.int8)
                edge = np.diff(inside)
                starts = points[np.flatnonzero(edge == 1)]
                lengths = points[np.flatnonzero(edge == -1)] - starts
                for col, x in zip(cols, (origin[i], label, height[i], width[i], *measure(starts, lengths, width[i]), starts, lengths)):
                    col.append(x)
            arrays = [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.int32()] * 2 + [pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.int64())] * 2)]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(k) for k in keep)], names=[*_NAMES, *keep])

    return pairs.mapInArrow(run, MASK_SCHEMA + "".join(f", {q(k)} {types[k]}" for k in keep))


def mask_pixels(masks: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The pixels of masks again, one row each: ``origin, class, row, col, keep...``."""
    more = "".join(f", {q(k)}" for k in keep)
    return run_sql({"m": masks}, f"""SELECT origin, class, CAST(i div width AS INT) AS row, CAST(i % width AS INT) AS col{more} FROM (
  SELECT *, explode(sequence(run.starts, run.starts + run.lengths - 1)) AS i FROM (SELECT *, explode(arrays_zip(starts, lengths)) AS run FROM {{m}}))""")
