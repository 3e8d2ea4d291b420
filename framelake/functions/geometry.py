"""Boxes as Column expressions. A box is four columns x1, y1, x2, y2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, alias: str = "") -> Box:
        """The columns x1 .. y2, of the DataFrame with this alias."""
        return cls(*(F.col(f"{alias}.{c}" if alias else c) for c in ("x1", "y1", "x2", "y2")))

    @classmethod
    def of_array(cls, a: Column) -> Box:
        return cls(*(F.get(a, F.lit(i)) for i in range(4)))


def round_coord(x: Column) -> Column:
    """To the nearest whole number, halves to even."""
    return F.rint(x).cast("long")


def coerced_box(a: Column) -> Column:
    """An array of four castable numbers with positive extent as longs, else null.

    Fractions are cut towards zero; text that isn't a number makes it null.
    """
    whole = F.transform(a, lambda v: v.try_cast("double").try_cast("long"))
    ok = (F.size(a) == 4) & ~F.exists(whole, lambda v: v.isNull())
    grows = (F.get(whole, F.lit(2)) > F.get(whole, F.lit(0))) & (F.get(whole, F.lit(3)) > F.get(whole, F.lit(1)))
    return F.when(ok & grows, whole)


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b.x2 - b.x1) * F.greatest(F.lit(0), b.y2 - b.y1)


def intersection(a: Box, b: Box) -> Column:
    return area(Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for disjoint or empty boxes."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both.cast("double") / union).otherwise(F.lit(0.0))


def center_inside(inner: Box, outer: Box) -> Column:
    """Whether the centre lies in the other box, edges included."""
    x, y = (inner.x1 + inner.x2) / 2.0, (inner.y1 + inner.y2) / 2.0
    return x.between(outer.x1, outer.x2) & y.between(outer.y1, outer.y2)


def affinity(face: Box, person: Box) -> Column:
    """How well a face fits a person: 0.55 overlap share, 0.35 centre inside, 0.10 IoU."""
    share = intersection(face, person).cast("double") / area(face)
    inside = F.when(center_inside(face, person), 1.0).otherwise(0.0)
    return F.when(area(face) > 0, 0.55 * share + 0.35 * inside + 0.10 * iou(face, person)).otherwise(F.lit(0.0))


#: Colours of our own for drawing, as red, green, blue.
PALETTE = ((230, 57, 70), (29, 53, 87), (69, 123, 157), (42, 157, 143), (233, 196, 106), (244, 162, 97), (131, 56, 236), (58, 134, 255))


def palette(index: Column) -> Column:
    """The colour of an index, repeating."""
    colours = F.array(*(F.array(*map(F.lit, c)) for c in PALETTE))
    return F.get(colours, F.pmod(index, F.lit(len(PALETTE))).cast("int"))


def bgr(rgb: Column) -> Column:
    return F.reverse(rgb)
