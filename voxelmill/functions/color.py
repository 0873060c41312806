"""Colours: packed words, hues, the class palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = 0.618033988749895


def pack(r: Column, g: Column, b: Column) -> Column:
    """0xAABBGGRR of channels 0 to 1, alpha 255."""
    byte = [F.floor(c * 255 + 0.5).cast("long").bitwiseAND(F.lit(255)) for c in (r, g, b)]
    return byte[0] + byte[1] * 256 + byte[2] * 65536 + F.lit(255 << 24)


def pack_bytes(r: Column, g: Column, b: Column) -> Column:
    return r.cast("long") + g.cast("long") * 256 + b.cast("long") * 65536 + F.lit(255 << 24)


def unpack(rgba: Column) -> list[Column]:
    """r, g, b, a, 0 to 1."""
    return [F.shiftright(rgba, 8 * k).bitwiseAND(F.lit(255)) / 255.0 for k in range(4)]


def to_8bit(c: Column) -> Column:
    return F.shiftright(c, 8)


def to_16bit(c: Column) -> Column:
    return c * 257


def las_color(c: Column) -> Column:
    """A 16-bit channel as 0 to 1; white where a cloud has no colour."""
    return F.coalesce(c / 65535.0, F.lit(1.0))


def hsl(h: Column, s: Column, lightness: Column) -> list[Column]:
    """r, g, b of 0 to 255, rounded half up."""
    c = (1 - F.abs(2 * lightness - 1)) * s
    x = c * (1 - F.abs((h * 6) % 2 - 1))
    m = lightness - c / 2
    sector = F.floor(h * 6) % 6
    zero = F.lit(0.0)
    table = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]
    out = []
    for k in range(3):
        v = table[5][k]
        for i in range(4, -1, -1):
            v = F.when(sector == i, table[i][k]).otherwise(v)
        out.append(F.floor((v + m) * 255 + 0.5).cast("int"))
    return out


#: Saturation and lightness, in turn by class.
VARIANTS = [(0.88, 0.52), (0.95, 0.36), (0.72, 0.66)]


def palette(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """(class_id, r, g, b, rgba) of 256 classes: hues a golden step apart for 0 to 200, magenta above, overrides (class_id, r, g, b) first."""
    i = F.col("id")

    def variant(k: int) -> Column:
        return F.when(i % 3 == 0, VARIANTS[0][k]).when(i % 3 == 1, VARIANTS[1][k]).otherwise(VARIANTS[2][k])

    rgb = hsl((i * F.lit(GOLDEN)) % 1.0, variant(0), variant(1))
    base = spark.range(256).select(i.cast("int").alias("class_id"), *(F.when(i <= 200, c).otherwise(v).alias(n) for n, c, v in zip("rgb", rgb, (255, 0, 255))))
    if overrides is not None:
        own = F.broadcast(overrides.select("class_id", *(F.col(c).alias(f"o{c}") for c in "rgb")))  # one row for each class at most
        base = base.join(own, "class_id", "left").select("class_id", *(F.coalesce(f"o{c}", c).alias(c) for c in "rgb"))
    return base.withColumn("rgba", pack_bytes(*(F.col(c) for c in "rgb")))


def shown(mode: Column, rgba: Column, segment: Column, survey: Column) -> Column:
    """The word to draw: own colour, segmentation colour or survey colour by mode 0, 1, 2."""
    return F.when(mode == 1, segment).when(mode == 2, survey).otherwise(rgba)
