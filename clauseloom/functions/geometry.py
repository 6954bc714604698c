"""Box arithmetic on position structs (page_idx, x0, y0, x1, y1) and on 4-number arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page sizes in points (portrait) and the scale of normalised boxes.
A4_WIDTH, A4_HEIGHT = 595.0, 842.0
PAGE_SIZES = {"A4": (595.0, 842.0), "A3": (842.0, 1191.0), "Letter": (612.0, 792.0), "Legal": (612.0, 1008.0)}
SIZE_TOLERANCE = 5.0
NORMALISED = 1000.0


def to_points(position: Column, width: Column, height: Column) -> Column:
    """Scale a 0-1000 position to points; the origin stays at the top left."""
    def scaled(value: Column, size: Column) -> Column:
        return value / F.lit(NORMALISED) * size

    return F.struct(position["page_idx"].alias("page_idx"), scaled(position["x0"], width).alias("x0"),
                    scaled(position["y0"], height).alias("y0"), scaled(position["x1"], width).alias("x1"),
                    scaled(position["y1"], height).alias("y1"))


def flip_bbox(bbox: Column, page_height: Column) -> Column:
    """Bottom-left box to top-left integers, rounded half to even; a malformed box gives zeros."""
    def whole(value: Column) -> Column:
        return F.bround(value, 0).cast("long")

    return F.when(F.size(bbox) == 4, F.array(whole(bbox[0]), whole(page_height - bbox[3]), whole(bbox[2]),
                                             whole(page_height - bbox[1]))).otherwise(
        F.array(*[F.lit(0).cast("long")] * 4))


def page_size_name(width: Column, height: Column) -> Column:
    out = None
    for name, (w, h) in PAGE_SIZES.items():
        near = (F.abs(width - w) < SIZE_TOLERANCE) & (F.abs(height - h) < SIZE_TOLERANCE)
        out = F.when(near, name) if out is None else out.when(near, name)
    return out.otherwise("Custom")


def scale_boxes(positions: Column, scale: Column | float) -> Column:
    """Positions at a viewport scale."""
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return F.transform(positions, lambda p: F.struct(
        p["page_idx"].alias("page_idx"), (p["x0"] * s).alias("x0"), (p["y0"] * s).alias("y0"),
        (p["x1"] * s).alias("x1"), (p["y1"] * s).alias("y1")))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap over union of two boxes; 0 on different pages or without area."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    inter = w * h

    def area(p: Column) -> Column:
        return (p["x1"] - p["x0"]) * (p["y1"] - p["y0"])

    union = area(a) + area(b) - inter
    return F.when((a["page_idx"] == b["page_idx"]) & (union > 0), inter / union).otherwise(0.0)


def bbox_of_position(position: Column) -> Column:
    return F.array(position["x0"], position["y0"], position["x1"], position["y1"])
