"""Images as rows of pixels: backgrounds, stretching, channel order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stretched(raster: DataFrame, size: tuple[int, int], width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """The raster of ``size`` (width, height) as width x height pixels, bilinear between pixel centres, edges repeated.

    Every new pixel names its four sources and their weights; one equi-join finds
    them.  A source that isn't there counts as 0.
    """
    grid = raster.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"))
    taps = []
    for axis, old, new in (("px", size[0], width), ("py", size[1], height)):
        at = F.least(F.greatest((F.col(axis) + 0.5) * (old / new) - 0.5, F.lit(0.0)), F.lit(float(old - 1)))
        low = F.floor(at).cast("int")
        share = at - low
        taps.append([(low, 1.0 - share), (F.least(low + 1, F.lit(old - 1)), share)])
    four = F.array(*[F.struct(x.alias("sx"), y.alias("sy"), (u * v).alias("w")) for x, u in taps[0] for y, v in taps[1]])
    asked = grid.withColumn("t", F.explode(four)).select("px", "py", "t.*")
    source = raster.select(F.col("px").alias("sx"), F.col("py").alias("sy"), *channels)
    sums = asked.join(source, ["sx", "sy"], "left").groupBy("px", "py")
    return sums.agg(*(F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in channels))


def resampled(raster: DataFrame, size: tuple[int, int], width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b", "a"), lobes: int = 3, alpha: str | None = None) -> DataFrame:
    """The raster of ``size`` (width, height) as width x height pixels by a windowed sinc of so many lobes, wider by as much as an axis shrinks.

    Columns, then rows: each pass is an equi-join with a table of weights, a few for
    each new pixel, and a sum.  Weights of a new pixel add up to 1, with what lies over
    the edge left out; results may lie a little outside the channels' range.
    With ``alpha`` the other channels count by that one.  A source pixel that isn't
    there, or a null channel, counts as 0.
    """
    colours = [c for c in channels if c != alpha]
    out = raster.select("px", "py", *channels)
    if alpha is not None:
        out = out.withColumns({c: F.col(c) * F.col(alpha) for c in colours})
    for axis, other, old, new in (("px", "py", size[0], width), ("py", "px", size[1], height)):
        sums = out.join(sinc_weights(raster.sparkSession, old, new, lobes).withColumnRenamed("old", axis), axis).groupBy("new", other)
        out = sums.agg(*(F.sum(F.col("w") * F.coalesce(c, F.lit(0.0))).alias(c) for c in channels)).withColumnRenamed("new", axis)
    if alpha is not None:
        out = out.withColumns({c: F.when(F.col(alpha) > 0, F.col(c) / F.col(alpha)).otherwise(0.0) for c in colours})
    return out.select("px", "py", *channels)


def sinc_weights(spark: SparkSession, old: int, new: int, lobes: int = 3) -> DataFrame:
    """(new, old, w): which pixels of a line of ``old`` make up each of ``new`` pixels, and their weights."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (F.col("new") + 0.5) * scale
    first, last = F.greatest(F.floor(centre - lobes * wide + 0.5), F.lit(0)), F.least(F.floor(centre + lobes * wide + 0.5), F.lit(old)) - 1
    rows = spark.range(new).select(F.col("id").cast("int").alias("new")).withColumn("old", F.explode(F.sequence(first, last)))
    x = (F.col("old") + 0.5 - centre) / wide
    sinc = lambda v: F.when(v == 0, 1.0).otherwise(F.sin(v * math.pi) / (v * math.pi))
    raw = rows.withColumn("w", F.when(F.abs(x) < lobes, sinc(x) * sinc(x / lobes)).otherwise(0.0))
    return raw.select("new", F.col("old").cast("int").alias("old"), (F.col("w") / F.sum("w").over(Window.partitionBy("new"))).alias("w"))


def swizzled(raster: DataFrame) -> DataFrame:
    """Red and blue change places."""
    return raster.withColumns({"r": F.col("b"), "b": F.col("r")})


def plain(spark: SparkSession, width: int, height: int, value: float, alpha: float = 1.0) -> DataFrame:
    """A raster of one colour; alpha 0 is the clear one that layers are laid over."""
    grid = spark.range(width * height)
    return grid.select((F.col("id") % width).cast("int").alias("px"), F.floor(F.col("id") / width).cast("int").alias("py"), *(F.lit(float(value)).alias(c) for c in "rgb"), F.lit(float(alpha)).alias("a"))


def background(spark: SparkSession, image: DataFrame | None, size: tuple[int, int], width: int, height: int, grey: float = 0.5) -> DataFrame:
    """(px, py, r, g, b, a): an image stretched over the raster, or, without one, opaque grey."""
    return plain(spark, width, height, grey) if image is None else stretched(image, size, width, height)
