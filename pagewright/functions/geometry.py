"""Bounding boxes as four DOUBLE columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def largest(box: list[Column]) -> Column:
    return F.greatest(*[F.abs(v) for v in box])


def clamped(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def to_unit(box: list[Column], width: Column, height: Column, assumed: float | None = None) -> list[Column]:
    """Into 0..1 by an assumed scale or the page size; as it is if neither is known."""
    small = largest(box) <= 1.5
    if assumed and assumed > 0:
        return [F.when(small, clamped(v)).otherwise(clamped(v / F.lit(float(assumed)))) for v in box]
    sized = (F.coalesce(width, F.lit(0.0)) > 0) & (F.coalesce(height, F.lit(0.0)) > 0)
    return [F.when(small, clamped(v)).when(sized, clamped(v / F.when(sized, d))).otherwise(v) for v, d in zip(box, (width, height, width, height), strict=True)]


def convert(box: list[Column], width: Column, height: Column, scale: str) -> list[Column]:
    """``source``: unchanged; ``relative``: by the page size; ``thousand``: in thousandths."""
    if scale not in ("source", "relative", "thousand"):
        raise ValueError(f"unknown scale: {scale}")
    if scale == "source":
        return box
    small = largest(box) <= 1.5
    sized = (F.coalesce(width, F.lit(0.0)) > 0) & (F.coalesce(height, F.lit(0.0)) > 0)
    out = []
    for v, d in zip(box, (width, height, width, height), strict=True):
        d = F.when(sized, d)
        if scale == "relative":
            out.append(F.when(sized & ~small, v / d).otherwise(v))
        else:
            out.append(F.when(small, v * 1000.0).when(sized, v * 1000.0 / d).otherwise(v))
    return out


def prompt_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """``y1 x1 y2 x2`` in thousandths, cut toward zero."""
    return F.concat_ws(" ", *[(v * 1000).cast("int").cast("string") for v in (y1, x1, y2, x2)])


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def intersection(a: list[Column], b: list[Column]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: list[Column], b: list[Column]) -> Column:
    i = intersection(a, b)
    u = area(*a) + area(*b) - i
    return F.when(u > 0, i / F.when(u > 0, u)).otherwise(F.lit(0.0))


def overlap_of_smaller(a: list[Column], b: list[Column]) -> Column:
    s = F.least(area(*a), area(*b))
    return F.when(s > 0, intersection(a, b) / F.when(s > 0, s)).otherwise(F.lit(0.0))
