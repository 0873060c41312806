"""Decoding and quantising of point coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decoded(raw: DataFrame, scale: tuple[float, ...], offset: tuple[float, ...]) -> DataFrame:
    """x, y, z of survey integers X, Y, Z with the scene's y up: x = X, y = Z, z = -Y; the offset of z isn't negated."""
    sx, sy, sz = scale
    ox, oy, oz = offset
    return raw.withColumns({"x": F.col("X") * sx + ox, "z": -F.col("Y") * sy + oy, "y": F.col("Z") * sz + oz})


def box(points: DataFrame) -> DataFrame:
    """One row: x0, x1, y0, y1, z0, z1."""
    return points.agg(*[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))])


def recentred(points: DataFrame) -> DataFrame:
    """Points moved so that x and z are centred in the box and y starts at 0."""
    b = F.broadcast(box(points))  # one row
    moved = {"x": F.col("x") - (F.col("x0") + F.col("x1")) / 2, "y": F.col("y") - F.col("y0"), "z": F.col("z") - (F.col("z0") + F.col("z1")) / 2}
    return points.crossJoin(b).withColumns(moved).select(*points.columns)


def up_axis(b: DataFrame) -> DataFrame:
    """The axis of least extent: z, then y, else x, at ties."""
    ex, ey, ez = (F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz")
    return b.select(F.when((ez <= ey) & (ez <= ex), "z").when(ey <= ex, "y").otherwise("x").alias("up"), F.greatest(ex, ey, ez).alias("extent"))


def to_mm(c: Column, low: Column) -> Column:
    """Whole thousandths above ``low``, half to even, in single precision."""
    return F.rint(((c - low) * 1000).cast("float")).cast("int")


def from_mm(c: Column, origin: Column, scale: float = 1000.0) -> Column:
    return c / scale + origin


def count_for(n: Column, percent: float | None = None, keep: int | None = None, remove: int | None = None) -> Column:
    """How many of n to keep: a percentage (half to even, 1 at least), a count, or all but a count."""
    if percent is not None:
        return F.greatest(F.lit(1), F.bround(n * percent / 100.0).cast("long"))
    if keep is not None:
        return F.least(n, F.lit(keep))
    return F.greatest(F.lit(0), n - F.lit(remove or 0))


def equirectangular(view: list[Column], far: Column) -> list[Column]:
    """(u, v, depth) of a view-space point on a sphere around the eye: longitude / pi, latitude / half pi, clamped distance / far.

    A negative zero counts as zero, so straight behind the eye is +1; the eye's own place is (0, 0, 0).
    """
    x, y, z = view
    d = F.sqrt(x * x + y * y + z * z)
    lat = F.when(d > 0, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / d)))).otherwise(0.0)
    lon = F.when(d > 0, F.atan2(x + 0.0, 0.0 - z)).otherwise(0.0)
    return [lon / math.pi, lat / (math.pi / 2), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d / far))]


def unwrapped(lon: Column, centre: Column) -> Column:
    """A longitude within half a turn of ``centre``."""
    d = lon - centre
    return centre + d - 2 * math.pi * F.rint(d / (2 * math.pi))


def swizzled_normal(nx: Column, ny: Column, nz: Column) -> list[Column]:
    """A survey normal in the scene's axes, with y up: (x, z, -y)."""
    return [nx, nz, -ny]
