"""Boxes, sizes and layout as column expressions. Boxes are structs x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Joints of the 17-point body layout by level, lowest first.
LEVELS = [("full_body", [15, 16]), ("upper_body", [13, 14]), ("torso", [11, 12]), ("chest", [5, 6]), ("head", [0, 1, 2, 3, 4])]


def center_inside(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["x1"], box["x2"]) & y.between(box["y1"], box["y2"])


def rect_area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return F.coalesce(F.try_divide(w * h, rect_area(a) + rect_area(b) - w * h), F.lit(0.0))


def person_box_from_face(face: Column, width: Column, height: Column) -> Column:
    """Person-sized box around a face box, clamped to the frame; null where a side is below 8."""
    fw, fh = face["x2"] - face["x1"], face["y2"] - face["y1"]
    h = fh / 0.8 * F.greatest(F.lit(1.0), fh / F.greatest(fw, F.lit(1e-9)))
    w = F.greatest(1.6 * fw, 0.35 * h)
    cx, top = (face["x1"] + face["x2"]) / 2, face["y1"] - 0.25 * fh
    box = F.struct(F.greatest(F.lit(0.0), cx - w / 2).alias("x1"), F.greatest(F.lit(0.0), top).alias("y1"), F.least(width, cx + w / 2).alias("x2"), F.least(height, top + h).alias("y2"))
    return F.when((box["x2"] - box["x1"] >= 8) & (box["y2"] - box["y1"] >= 8), box)


def croppable(box: Column, width: int = 32, height: int = 64) -> Column:
    """Whether a box is there and large enough to cut out."""
    return F.coalesce((box["x2"] - box["x1"] >= width) & (box["y2"] - box["y1"] >= height), F.lit(False))


def crop_rect(box: Column, keypoints: Column, confidence: float, margin: float, width: Column, height: Column) -> Column:
    """Union of the box and visible keypoints, widened by margin, rounded half to even, clamped; null below one pixel."""
    seen = F.filter(keypoints, lambda k: k["conf"] >= confidence)
    xs, ys = F.transform(seen, lambda k: k["x"]), F.transform(seen, lambda k: k["y"])
    x1, y1 = F.least(box["x1"], F.array_min(xs)), F.least(box["y1"], F.array_min(ys))
    x2, y2 = F.greatest(box["x2"], F.array_max(xs)), F.greatest(box["y2"], F.array_max(ys))
    mx, my = (x2 - x1) * margin, (y2 - y1) * margin
    out = F.struct(
        F.greatest(F.lit(0), F.bround(x1 - mx).cast("long")).alias("x1"),
        F.greatest(F.lit(0), F.bround(y1 - my).cast("long")).alias("y1"),
        F.least(width, F.bround(x2 + mx).cast("long")).alias("x2"),
        F.least(height, F.bround(y2 + my).cast("long")).alias("y2"),
    )
    return F.when((out["x2"] - out["x1"] >= 1) & (out["y2"] - out["y1"] >= 1), out)


def pose_level(keypoints: Column, confidence: float) -> Column:
    """The level of the lowest joint seen."""
    out = F.lit("unknown")
    for level, joints in reversed(LEVELS):
        seen = F.exists(F.array(*map(F.lit, joints)), lambda j: F.coalesce(F.get(keypoints, j)["conf"] >= confidence, F.lit(False)))
        out = F.when(seen, F.lit(level)).otherwise(out)
    return out


def scaled_long_side(width: Column, height: Column, most: int) -> Column:
    """Size with a long side of at most `most`, never enlarged, each side at least 1."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.bround(width * scale).cast("long")).alias("width"), F.greatest(F.lit(1), F.bround(height * scale).cast("long")).alias("height"))


def fitted_frame(width: Column, height: Column, most: int) -> Column:
    """Size inside a most x most * 9/16 frame of either orientation, even, at least 2, never enlarged."""
    w, h = F.greatest(F.lit(2), width.cast("long")), F.greatest(F.lit(2), height.cast("long"))
    short = int(round(most * 9 / 16))
    wide = w >= h
    scale = F.least(F.lit(1.0), F.when(wide, F.lit(float(most))).otherwise(F.lit(float(short))) / w, F.when(wide, F.lit(float(short))).otherwise(F.lit(float(most))) / h)
    w, h = (F.when(scale < 1, F.bround(x * scale).cast("long")).otherwise(x) for x in (w, h))
    return F.struct(F.greatest(F.lit(2), w - w % 2).alias("width"), F.greatest(F.lit(2), h - h % 2).alias("height"))


def grid_cell(width: Column, height: Column, index: Column, cols: int, rows: int, most: int, gap: int, margin: int) -> Column:
    """Place and size of image number index in a grid of equal cells of that size, shrunk to `most`."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(cols * width + (cols - 1) * gap + 2 * margin, rows * height + (rows - 1) * gap + 2 * margin))
    cw, ch = (F.greatest(F.lit(1), F.bround(x * scale).cast("long")) for x in (width, height))
    g, m = (F.greatest(F.lit(0), F.bround(F.lit(float(x)) * scale).cast("long")) for x in (gap, margin))
    return F.struct((m + (index % cols) * (cw + g)).alias("x"), (m + F.floor(index / cols) * (ch + g)).alias("y"), cw.alias("width"), ch.alias("height"), (cols * cw + (cols - 1) * g + 2 * m).alias("canvas_width"), (rows * ch + (rows - 1) * g + 2 * m).alias("canvas_height"))
