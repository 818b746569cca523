"""Geometry of boxes (x0, y0, x1, y1; y grows downwards) as column expressions over four columns each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """The four columns of a box."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        """The columns prefix + x0, y0, x1, y1."""
        return Box(*[F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")])

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def area(self) -> Column:
        """Area, 0 for a box turned inside out."""
        return F.greatest(F.lit(0.0), self.x1 - self.x0) * F.greatest(F.lit(0.0), self.y1 - self.y0)

    def shared(self, other: Box) -> Column:
        """Area of the intersection."""
        dx = F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0)
        dy = F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0)
        return F.greatest(F.lit(0.0), dx) * F.greatest(F.lit(0.0), dy)

    def overlap_ratio(self, other: Box) -> Column:
        """Share of this box that the other covers (asymmetric)."""
        return self.shared(other) / F.greatest(F.lit(1e-6), (self.x1 - self.x0) * (self.y1 - self.y0))

    def x_overlap(self, other: Box) -> Column:
        """Common width over the smaller width."""
        inter = F.greatest(F.lit(0.0), F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0))
        return inter / F.greatest(F.lit(1e-6), F.least(self.width, other.width))

    def column(self, page_width: float) -> Column:
        """'full', 'left' or 'right': wide boxes and boxes over the middle are full, others go by their centre."""
        mid = page_width / 2
        wide = (self.width >= page_width * 0.68) | ((self.x0 < mid) & (self.x1 > mid) & (self.width >= page_width * 0.42))
        return F.when(wide, "full").when((self.x0 + self.x1) / 2 < mid, "left").otherwise("right")


def landscape(width: Column, height: Column) -> Column:
    """Pages wider than high, both known."""
    return F.coalesce((width > height) & (width != 0) & (height != 0), F.lit(False))
