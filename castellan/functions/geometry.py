"""Boxes in page points, origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def _c(b: Column | str) -> Column:
    return F.col(b) if isinstance(b, str) else b


def filler() -> Column:
    """The box of characters that were not printed."""
    zero = F.lit(0.0)
    return box(zero, zero, zero, zero)


def flipped(x0: Column, y0: Column, x1: Column, y1: Column, page_height: Column) -> Column:
    """From corners measured from the top."""
    return box(x0, page_height - y1, x1 - x0, y1 - y0)


def union(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return box(x, y, F.greatest(a.x + a.w, b.x + b.w) - x, F.greatest(a.y + a.h, b.y + b.h) - y)


def union_agg(b: Column | str) -> Column:
    """Union of a group's boxes, degenerate ones aside; null if none is left."""
    b = _c(b)
    proper = (b.w > 0) & (b.h > 0)
    keep = lambda v: F.when(proper, v)
    x, y = F.min(keep(b.x)), F.min(keep(b.y))
    return F.when(x.isNotNull(), box(x, y, F.max(keep(b.x + b.w)) - x, F.max(keep(b.y + b.h)) - y))


def of_slice(chars: Column | str, start: Column, end: Column) -> Column:
    """Union of the boxes of characters start to end (exclusive) of an array."""
    part = F.filter(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), lambda c: (c.bbox.w > 0) & (c.bbox.h > 0))
    at = lambda f: F.transform(part, f)
    x, y = F.array_min(at(lambda c: c.bbox.x)), F.array_min(at(lambda c: c.bbox.y))
    return F.when(F.size(part) > 0, box(x, y, F.array_max(at(lambda c: c.bbox.x + c.bbox.w)) - x, F.array_max(at(lambda c: c.bbox.y + c.bbox.h)) - y))


def crop_to_page(clip: Column | str, scale: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """From pixels of a crop, origin at its top left."""
    clip = _c(clip)
    return box(clip.x + x / scale, clip.y + clip.h - (y + h) / scale, w / scale, h / scale)


def page_rect(b: Column | str, page_width: Column, page_height: Column, shown_width: Column, shown_height: Column) -> Column:
    """Rectangle (left, top, width, height) on a page shown at another size."""
    b = _c(b)
    sx, sy = shown_width / page_width, shown_height / page_height
    return F.struct((b.x * sx).alias("left"), ((page_height - b.y - b.h) * sy).alias("top"), (b.w * sx).alias("width"), (b.h * sy).alias("height"))


def inflated(b: Column | str, points: float) -> Column:
    b = _c(b)
    return box(b.x - points, b.y - points, b.w + 2 * points, b.h + 2 * points)


def rows_overlap(a: Column | str, b: Column | str, share: float = 0.5) -> Column:
    """Vertical overlap of at least a share of the lower box; degenerate boxes never overlap."""
    a, b = _c(a), _c(b)
    shared = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return (a.h > 0) & (a.w > 0) & (shared >= share * F.least(a.h, b.h))


def mostly_inside(inner: Column | str, outer: Column | str, share: float = 0.8) -> Column:
    inner, outer = _c(inner), _c(outer)
    return F.least(inner.x + inner.w, outer.x + outer.w) - F.greatest(inner.x, outer.x) >= share * inner.w
