"""The whole reconstruction of a view: depth slices, hole filling, and layers over each other.

Slices of all views are rows of one DataFrame keyed by (view, layer); an iterative
kernel sees one raster of a view and layer at a time, so views and layers spread
over the cluster and nothing depends on how many points a slice has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import depth as D
from . import projection as P
from . import raster as R
from . import tiles as T
from .cameras import camera_of_row
from .tables import cut

CHANNELS = ("r", "g", "b")
#: Over-relaxation steps that fill a layer's holes.
STEPS = 5000
#: Radius and deviation of the Gaussians over the distances and over the mask.
SDF_BLUR, DENSITY_BLUR = (4, 2.0), (30, 15.0)


def view_bins(points: DataFrame, cameras: DataFrame, near: float, far: float) -> DataFrame:
    """(view, bin_id, start, end): each view's depth bins, from the depths of the points in its frustum."""
    seen = P.clipped(P.seen_by(points.select(*"xyz"), cameras), camera_of_row()).where(P.in_frustum()).select("view", "d")
    by = ("view",)
    return cut(D.bins(D.peaks(D.smoothed(D.histogram(seen, near, far, by), by), by=by), near, far, by, cameras))


def slices(points: DataFrame, cameras: DataFrame, bins: DataFrame, width: int, height: int) -> DataFrame:
    """(view, layer, depth, px, py, r, g, b): the captured pixels of every depth bin of every view, the farthest bin first.

    Points carry r, g, b.  Bins (view, bin_id, start, end) may overlap: a point in two is drawn in both.
    """
    seen = P.pixels(P.seen_by(points.select("point_id", *"xyz", *CHANNELS), cameras), camera_of_row(), width, height)
    drawn = seen.join(F.broadcast(bins), "view").where(F.col("d").between(F.col("start"), F.col("end")))  # a dozen bins of each camera
    near = P.z_buffer(drawn, *CHANNELS, by=("view", "bin_id", "px", "py"))
    place = bins.select("view", "bin_id", (-F.col("bin_id")).alias("layer"), ((F.col("start") + F.col("end")) / 2).alias("depth"))
    return near.join(F.broadcast(place), ["view", "bin_id"]).select("view", "layer", "depth", "px", "py", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in CHANNELS))


def filled(captured: DataFrame, width: int, height: int, steps: int = STEPS, method: str = "sor", tasks: int | None = None) -> DataFrame:
    """(view, layer, depth, px, py, r, g, b, al, sdf, density): every pixel of each layer that has a captured one.

    One kernel call for each (view, layer) makes all of it on dense arrays: the
    holes' colours, solved from the captured pixels' (al = 1), sdf, the blurred
    distance to these, and density, their blurred mask.

    Captured pixels are few bytes of much work, so Spark would put many layers into one
    task; they are dealt to ``tasks`` of them instead, if given.
    """
    kernel = R.METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf.py.to_numpy(), pdf.px.to_numpy()
        al, colours = np.zeros((height, width)), np.zeros((len(CHANNELS), height, width))
        al[at] = 1.0
        for plane, c in zip(colours, CHANNELS):
            plane[at] = pdf[c]
        colours = kernel(colours, al, steps) if method == "sor" else np.stack([kernel(plane, al, steps) for plane in colours])
        py, px = np.indices(al.shape)
        planes = {**dict(zip(CHANNELS, colours)), "al": al, "sdf": R.smoothed(R.jump_flood(al), *SDF_BLUR), "density": R.smoothed(al, *DENSITY_BLUR)}
        return pd.DataFrame({"view": pdf["view"].iloc[0], "layer": pdf["layer"].iloc[0], "depth": pdf["depth"].iloc[0], "px": px.ravel().astype(np.int32), "py": py.ravel().astype(np.int32), **{k: v.ravel() for k, v in planes.items()}})

    dealt = captured if tasks is None else captured.repartition(tasks, "view", "layer")
    return dealt.groupBy("view", "layer").applyInPandas(run, "view int, layer int, depth double, px int, py int, r double, g double, b double, al double, sdf double, density double")


def reconstructed(points: DataFrame, cameras: DataFrame, bins: DataFrame, width: int, height: int, steps: int = STEPS) -> DataFrame:
    """(view, px, py, r, g, b, a) of each view, whose holes between points are filled.

    All views of ``cameras`` (CAMERA_SCHEMA) are one plan; layers are written once.
    A layer without a point shows nothing; a view without any has no row.  Null
    colours count as 0.
    """
    tasks = max(1, min(2 * bins.count(), 100_000))  # a dozen bins of each view
    layers = cut(filled(slices(points, cameras, bins, width, height), width, height, steps, tasks=tasks))
    depth = (F.col("start") + F.col("end")) / 2
    span = bins.groupBy("view").agg(F.min(depth).alias("d0"), F.max(depth).alias("d1"))
    return R.composited(layers, width, height, ("view",), span)


def compared(holed: DataFrame, truth: DataFrame, width: int, height: int, methods: dict[str, int], tile: int = T.TILE) -> DataFrame:
    """(method, mse, psnr) of filling a raster's holes by each method with so many steps, on tiles, against the true raster (px, py, v from 0 to 255)."""
    out = None
    for method, steps in methods.items():
        done = T.solved(holed.withColumn("view", F.lit(0)), method, steps, width, height, tile, ("view",)).select("px", "py", "v")
        score = R.psnr(truth.select("px", "py", "v"), done, ("v",)).select(F.lit(method).alias("method"), "mse", "psnr")
        out = score if out is None else out.unionByName(score)
    return out
