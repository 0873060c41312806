"""Depth histograms of a view, their smoothing and peaks, and overlapping depth bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, BACK, AHEAD, BINS = 500, 8, 7, 12


def valid(samples: DataFrame, near: float, far: float) -> DataFrame:
    """Samples with a finite depth above 0 within [near, far]."""
    d = F.col("d")
    return samples.where((d > 0) & ~F.isnan(d) & d.between(near, far))


def depth_range(samples: DataFrame, near: float, far: float, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each key of ``by``: the valid depths' range, 5 % wider, within near and far (n, f), and their number."""
    ok = valid(samples, near, far)
    return (ok.groupBy(*by) if by else ok).agg(F.greatest(F.lit(near), F.min("d") * 0.95).alias("n"), F.least(F.lit(far), F.max("d") * 1.05).alias("f"), F.count("*").alias("in_view"))


def histogram(samples: DataFrame, near: float, far: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, c, n, f): counts of the 500 buckets, empty ones too; a key of ``by`` without a valid sample has none."""
    span = depth_range(samples, near, far, by)
    own = valid(samples, near, far)
    own = own.join(F.broadcast(span), list(by)) if by else own.crossJoin(F.broadcast(span))  # one row, or one for each view
    counted = own.select(*by, F.floor((F.col("d") - F.col("n")) / (F.col("f") - F.col("n")) * (BUCKETS - 1)).cast("int").alias("i")).groupBy(*by, "i").agg(F.count("*").alias("c"))
    buckets = span.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    return buckets.join(counted, [*by, "i"], "left").select(*by, "i", F.coalesce("c", F.lit(0)).alias("c"), "n", "f")


def smoothed(hist: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a: the mean of the buckets i - 8 to i + 7, clipped at the ends (500 rows of a key)."""
    frame = Window.partitionBy(*by).orderBy("i").rowsBetween(-BACK, AHEAD)
    return hist.withColumn("a", F.sum("c").over(frame).cast("double") / F.count("*").over(frame).cast("double"))


def peaks(smooth: DataFrame, most: int = BINS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, a, depth): the strict interior maxima of the smoothed histogram, the ``most`` highest of them."""
    w = Window.partitionBy(*by).orderBy("i")
    top = smooth.withColumns({"before": F.lag("a").over(w), "after": F.lead("a").over(w)}).where("a > before AND a > after")
    depth = F.col("n") + F.col("i").cast("double") / BUCKETS * (F.col("f") - F.col("n"))
    high = Window.partitionBy(*by).orderBy(F.col("a").desc(), "i")
    return top.withColumn("k", F.row_number().over(high)).where(F.col("k") <= most).select(*by, "i", "a", depth.alias("depth"))


def bins(found: DataFrame, near: float, far: float, by: tuple[str, ...] = (), views: DataFrame | None = None) -> DataFrame:
    """(by, bin_id, start, end): cells between neighbouring peaks, the ends widened, then overlapped by a tenth of the narrower cell.

    The overlap is a left-to-right recurrence over at most 12 bins: a fold over one
    array.  Without a peak there is one bin, near to far; with ``by`` such a key
    must be named by a row of ``views``.
    """
    every = F.sort_array(F.collect_list("depth")).alias("p")
    depths = found.groupBy(*by).agg(every) if by else found.agg(every)
    if views is not None:
        depths = views.select(*by).distinct().join(depths, list(by), "left").select(*by, F.coalesce("p", F.array().cast("array<double>")).alias("p"))
    n = F.size("p")

    def cell(p: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(max(0.0, near * 0.5))).otherwise((F.get("p", i - 1) + p) / 2)
        end = F.when(i == n - 1, F.lit(far * 1.5)).otherwise((p + F.get("p", i + 1)) / 2)
        return F.struct(start.alias("start"), end.alias("end"))

    kind = "array<struct<start: double, end: double>>"
    cells = depths.select(*by, F.when(n == 0, F.array(F.struct(F.lit(near).alias("start"), F.lit(far).alias("end")))).otherwise(F.transform("p", cell)).cast(kind).alias("b"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        mid = (last["end"] + b["start"]) / 2
        overlap = F.least(b["end"] - b["start"], last["end"] - last["start"]) * 0.1
        moved = F.array(F.struct(last["start"].alias("start"), (mid + overlap).alias("end")), F.struct((mid - overlap).alias("start"), b["end"].alias("end")))
        return F.when(F.size(done) == 0, F.array(b)).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), moved))

    folded = cells.select(*by, F.aggregate("b", F.array().cast(kind), step).alias("b"))
    return folded.select(*by, F.posexplode("b").alias("bin_id", "x")).select(*by, "bin_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def sliced(samples: DataFrame, found: DataFrame) -> DataFrame:
    """Samples with each bin_id whose closed range holds their depth; the bins are a dozen rows."""
    return samples.join(F.broadcast(found), F.col("d").between(F.col("start"), F.col("end"))).drop("start", "end")
