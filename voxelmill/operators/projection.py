"""Projecting points and turning them into rasters.

A raster is rows (px, py, ...).  Splats expand a point into the pixels it covers,
bounded by a radius, and a z-buffer is a minimum by pixel, which Spark reduces
before the shuffle; nothing is ever collected by pixel but for the ordered blend.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import matrix as M
from ..functions.color import unpack
from ..functions.geometry import equirectangular, unwrapped
from .cameras import camera_of_row
from .tables import Tables, cut

#: Cameras that one pass over the points ships to all tasks.
VIEWS = 256
#: Cells along a cloud's longest side when views are culled, and (cell, view) pairs that are broadcast at most.
CELLS, FEW_PAIRS = 48, 200_000
#: Pixels of patches that a task works on at once.
PIXELS = 1 << 20


def _xyz() -> list[Column]:
    return [F.col(c) for c in "xyz"]


def clipped(points: DataFrame, camera: dict) -> DataFrame:
    """Adds clip coordinates cx, cy, cz, cw and the linear depth d = -view z.

    View coordinates come first and are projected then, as written in formulas: points on
    a pixel's edge, or equally deep, are told apart by last bits, which a product of both matrices changes.
    """
    df, at = M.once(points, "__at", M.transform(camera["view"], _xyz())[:3])
    df, clip = M.once(df, "__clip", M.transform(camera["projection"], at))
    return df.withColumns({**{f"c{n}": v for n, v in zip("xyzw", clip)}, "d": -at[2]}).drop(*(f"__at{i}" for i in range(3)), *(f"__clip{i}" for i in range(4)))


def seen_by(points: DataFrame, cameras: DataFrame, cells: int = CELLS) -> DataFrame:
    """points once for each row of ``cameras`` (CAMERA_SCHEMA) that may see them: what camera_of_row() needs to project them in all views at once.

    Points share a grid cell, so many along the cloud's longest side; cells meet
    cameras, and a point follows only where its cell's box touches a frustum.
    The test is one of planes: it may let a point through that no pixel shows, but
    keeps back none that one does.  Points with a null or infinite coordinate, which
    no frustum holds, are left out.  Cameras are a stated set of queries against all
    points; they are broadcast, in passes of about VIEWS cameras each.
    """
    tables = Tables(points.sparkSession)
    celled = _celled(points, cells)
    boxes = celled.groupBy("__cell").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low_", F.min), ("high_", F.max))))
    passes = max(1, -(-cameras.count() // VIEWS))
    boxes = boxes if passes == 1 else tables.cut("boxes", boxes)  # at most cells ** 3 rows
    found = []
    for k in range(passes):
        part = F.broadcast(cameras.where(F.pmod(F.xxhash64("view"), F.lit(passes)) == k))
        planes = F.broadcast(part.select("view", frustum_planes(camera_of_row()).alias("planes")))
        touching = tables.cut(f"touching{k}", boxes.crossJoin(planes).where(may_touch(F.col("planes"))).select("__cell", "view"))
        few = touching.count() <= FEW_PAIRS
        found.append(celled.join(F.broadcast(touching) if few else touching, "__cell").join(part, "view").drop("__cell"))
    return reduce(DataFrame.unionByName, found).select(*points.columns, *cameras.columns)


def _celled(points: DataFrame, cells: int) -> DataFrame:
    """points with finite coordinates, with the number of their cell of a cubic grid over them."""
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in "xyz"])
    held = points.where(finite)
    box = F.broadcast(held.agg(*(F.min(c).alias(f"__{c}0") for c in "xyz"), F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("__side")))  # one row
    step = F.greatest(F.col("__side") / cells, F.lit(1e-300))
    at = [F.least(F.floor((F.col(c) - F.col(f"__{c}0")) / step), F.lit(cells - 1)) for c in "xyz"]
    return held.crossJoin(box).withColumn("__cell", (at[0] * cells + at[1]) * cells + at[2]).drop("__x0", "__y0", "__z0", "__side")


def frustum_planes(camera: dict) -> Column:
    """The planes of a camera's frustum: arrays of a, b, c, d with a x + b y + c z + d >= 0 within."""
    row = [[camera["both"][4 * c + r] for c in range(4)] for r in range(4)]  # matrices are stored column by column
    both = [(row[3], row[k], sign) for k in (0, 1) for sign in (-1, 1)] + [(row[3], row[2], -1)]
    planes = [row[3], row[2], *([x + y * sign for x, y in zip(a, b)] for a, b, sign in both)]
    return F.array(*[F.array(*plane) for plane in planes])


def may_touch(planes: Column) -> Column:
    """Whether a box (low_x .. high_z) is not wholly beyond one of the planes, with some room for rounding."""
    ends = [(F.col(f"low_{c}"), F.col(f"high_{c}")) for c in "xyz"]

    def reached(plane: Column) -> Column:
        most, size = plane[3], F.abs(plane[3])
        for i, (low, high) in enumerate(ends):
            most = most + F.greatest(plane[i] * low, plane[i] * high)
            size = size + F.abs(plane[i]) * F.greatest(F.abs(low), F.abs(high))
        return most >= size * -1e-9

    return F.forall(planes, reached)


def in_frustum() -> Column:
    return F.expr("cw > 0 AND abs(cx) <= cw AND abs(cy) <= cw AND cz >= 0 AND cz <= cw")


def view_depth(points: DataFrame, camera: dict) -> DataFrame:
    """(point_id, d): the linear depth, or -1 outside the frustum."""
    return clipped(points, camera).select("point_id", F.when(in_frustum(), F.col("d")).otherwise(-1.0).alias("d"))


def pixels(points: DataFrame, camera: dict, width: int, height: int, near: float | None = None, far: float | None = None) -> DataFrame:
    """Points in the frustum (and the closed depth range) with their pixel px, py and depth z = clip z / w."""
    seen = clipped(points, camera).where(in_frustum())
    if near is not None:
        seen = seen.where(F.col("d").between(near, far))
    px = F.least(F.floor((F.col("cx") / F.col("cw") + 1.0) * (width / 2)), F.lit(width - 1)).cast("int")
    py = F.least(F.floor((1.0 - F.col("cy") / F.col("cw")) * (height / 2)), F.lit(height - 1)).cast("int")
    return seen.withColumns({"px": px, "py": py, "z": F.col("cz") / F.col("cw")})


def z_buffer(fragments: DataFrame, *carried: str, by: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """The nearest fragment of each pixel, the lowest point_id at ties."""
    first = F.min(F.struct("z", "point_id", *carried))
    return fragments.groupBy(*by).agg(first.alias("f")).select(*by, "f.*")


def density(points: DataFrame, camera: dict, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each key of ``by``: points in view, and how many of them each pixel has on average."""
    seen = clipped(points, camera)
    return (seen.groupBy(*by) if by else seen).agg(F.count_if(in_frustum()).alias("in_view")).withColumn("density", F.col("in_view") / float(width * height))


def view_results(cameras: DataFrame, points: DataFrame, width: int, height: int, fov: float) -> DataFrame:
    """A row for each view: file name, pose (q0 .. q3, t0 .. t2), intrinsics, points in view and their density; where there are no points at all both are null."""
    from .cameras import colmap_pose_rows

    counted = density(seen_by(points, cameras), camera_of_row(), width, height, ("view",))
    k = M.intrinsics(F.lit(float(width)), F.lit(float(height)), F.lit(math.radians(fov)))
    some = F.broadcast(points.agg((F.count("*") > 0).alias("some")))  # one row
    named = colmap_pose_rows(cameras).join(counted, "view", "left").crossJoin(some)
    named = named.withColumns({c: F.when(F.col("some"), F.coalesce(c, F.lit(0))) for c in ("in_view", "density")}).drop("some")
    return named.withColumns({"filename": F.format_string("image_%d.png", F.col("view") + 1), **k})


def mean_density(results: DataFrame) -> DataFrame:
    """One row: the mean of the densities that are known, and how many views have one."""
    return results.agg(F.avg("density").alias("mean_density"), F.count("density").alias("views"))


def completed(results: DataFrame, key: str = "image_id") -> DataFrame:
    """One row of each id, the first by its ``seq``, and not if it failed (failed is true): images that were delivered twice count once."""
    return results.where(~F.coalesce(F.col("failed"), F.lit(False))).groupBy(key).agg(F.min("seq").alias("seq"))


def sort_key(points: DataFrame, camera: dict, spherical: bool = False) -> DataFrame:
    """(point_id, key): clip depth z / w, or the distance from the eye on a sphere."""
    v = M.transform(camera["view"], _xyz())
    key = F.sqrt(M.dot(v, v)) if spherical else F.col("cz") / F.col("cw")
    return clipped(points, camera).select("point_id", key.alias("key")) if not spherical else points.select("point_id", key.alias("key"))


def back_to_front(points: DataFrame, camera: dict, spherical: bool = False) -> DataFrame:
    """Sort keys from far to near; ids break ties, so the order is total."""
    return sort_key(points, camera, spherical).orderBy(F.col("key").desc(), "point_id")


def splats(placed: DataFrame, radius: int) -> DataFrame:
    """Every pixel within ``radius`` of a point's pixel centre, with the squared distance r2 in radii."""
    o = placed.withColumn("dx", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("dy", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    o = o.withColumn("r2", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / float(radius * radius))
    return o.withColumns({"px": F.col("px") + F.col("dx"), "py": F.col("py") + F.col("dy")}).drop("dx", "dy")


def on_raster(fragments: DataFrame, width: int, height: int) -> DataFrame:
    return fragments.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def disks(placed: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Fragments of discs: corners of the square (r2 > 1) are cut, and what falls off the raster."""
    return on_raster(splats(placed, radius).where("r2 <= 1"), width, height)


def index_raster(placed: DataFrame, width: int, height: int, radius: int = 4) -> DataFrame:
    """(px, py, point_id): which point's disc is nearest at each pixel, each disc at its centre's depth."""
    return z_buffer(disks(placed, radius, width, height)).select("px", "py", "point_id")


def gaussians(placed: DataFrame, radius: int, width: int, height: int, sigma: float = 0.4, cut: float = 0.01) -> DataFrame:
    """Fragments with weight exp(-r2 / (2 sigma^2)); those below ``cut`` are left out."""
    weight = F.exp(-F.col("r2") / (2 * sigma * sigma))
    return on_raster(splats(placed, radius).withColumn("weight", weight).where(F.col("weight") >= cut), width, height)


def blended(fragments: DataFrame, by: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """(by, r, g, b, a): fragments (r, g, b, weight, z, point_id) laid over each other from far to near, the lower point_id first at equal depths.

    Over isn't commutative but associative on (colour times alpha, alpha).  So the
    fragments are dealt by ranges of (pixel, depth), each range of a pixel is folded
    by itself, and then the few ranges of a pixel in their order: a hot pixel is
    many tasks' work, and no task holds more than its range.
    """
    far_first = [*by, (-F.col("z")).alias("o"), "point_id"]
    ranged = fragments.select(*far_first, "r", "g", "b", "weight").repartitionByRange(*by, "o", "point_id").withColumn("slab", F.spark_partition_id())
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))

    def over(below: Column, f: Column) -> Column:
        return F.struct(*((f[c] + below[c] * (1 - f["a"])).alias(c) for c in "rgb"), (f["a"] + below["a"] * (1 - f["a"])).alias("a"))

    light = F.struct("o", "point_id", *((F.col(c) * F.col("weight")).alias(c) for c in "rgb"), F.col("weight").alias("a"))
    parts = ranged.groupBy(*by, "slab").agg(F.aggregate(F.sort_array(F.collect_list(light)), zero, over).alias("p"))
    ordered = F.sort_array(F.collect_list(F.struct("slab", "p")))
    return parts.groupBy(*by).agg(F.aggregate(ordered, zero, lambda below, f: over(below, f["p"])).alias("p")).select(*by, "p.*")


def facing_basis(df: DataFrame, position: list[Column], eye: list[Column]) -> tuple[DataFrame, list[Column], list[Column]]:
    """df with the columns of (right, up) of a quad that faces the eye, and those; +x stands in for up where the ray is nearly vertical."""
    df, ahead = M.held(df, "__ahead", M.normalize(M.minus(eye, position)))
    steep = F.abs(ahead[1]) > 0.99
    return _spanned(df, ahead, [F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0), F.lit(0.0)])


def _spanned(df: DataFrame, ahead: list[Column], up: list[Column]) -> tuple[DataFrame, list[Column], list[Column]]:
    df, right = M.held(df, "__right", M.normalize(M.cross(up, ahead)))
    df, over = M.held(df, "__over", M.cross(ahead, right))
    return df, right, over


def normal_basis(df: DataFrame, normal: list[Column], position: list[Column], eye: list[Column]) -> tuple[DataFrame, list[Column], list[Column]]:
    """The same of a quad across its normal turned to the eye; without a normal (length under 0.001) it faces the eye."""
    df, ahead = M.held(df, "__ahead", M.normalize(M.minus(eye, position)))
    df, unit = M.held(df, "__unit", M.normalize(normal))
    known = F.sqrt(M.dot(normal, normal)) >= 0.001
    side = F.when(M.dot(unit, ahead) < 0, -1.0).otherwise(1.0)
    df, n = M.held(df, "__n", [F.when(known, u * side).otherwise(a) for u, a in zip(unit, ahead)])
    steep = F.abs(n[1]) > 0.99
    return _spanned(df, n, [F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)])


#: The two triangles of a quad.
CORNERS = [(-1, -1), (1, -1), (-1, 1), (-1, 1), (1, -1), (1, 1)]


def quads(points: DataFrame, right: list[Column], up: list[Column], size: float) -> DataFrame:
    """Six corner rows (corner, qx, qy, qz) for each point."""
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(float(x)).alias("u"), F.lit(float(y)).alias("v")) for k, (x, y) in enumerate(CORNERS)])
    rows = points.withColumns({**{f"r{c}": v for c, v in zip("xyz", right)}, **{f"u{c}": v for c, v in zip("xyz", up)}}).withColumn("k", F.explode(corners))
    spread = {f"q{c}": F.col(c) + (F.col(f"r{c}") * F.col("k.u") + F.col(f"u{c}") * F.col("k.v")) * size for c in "xyz"}
    return _plain(rows.withColumns({"corner": F.col("k.corner"), **spread}).drop("k", *(f"{a}{c}" for a in "ru" for c in "xyz")))


def _plain(df: DataFrame) -> DataFrame:
    """Without the columns that were held for intermediate values."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def facing_patch(df: DataFrame, camera: dict, basis: str = "facing") -> tuple[DataFrame, list[Column], list[Column]]:
    """df and (right, up) of each point's patch: ``facing`` the eye, across its ``normal``, or across it where it has one (``guarded``)."""
    if basis == "facing":
        return facing_basis(df, _xyz(), camera["eye"])
    return normal_basis(df, [F.col(f"n{c}") for c in "xyz"], _xyz(), camera["eye"])


def _covered(pdf: pd.DataFrame, boxes, width: int, solve) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, px, py, z, r2) of all pixels that a batch's patches cover.  ``boxes`` gives the first column (which may run over the right edge, to go on at the left) and row and the extents that each patch may cover, ``solve`` whether, where and how deep given pixels lie on given patches.  A bounded number of pixels is worked on at a time."""
    x0, y0, wide, high = boxes(pdf)
    count = wide * high
    ends = np.cumsum(count)
    at = 0
    while at < len(pdf):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PIXELS, "right")))
        row = np.repeat(np.arange(at, to), count[at:to])
        k = np.arange(len(row)) - np.repeat(ends[at:to] - count[at:to] - done, count[at:to])
        px, py = (x0[row] + k % np.maximum(wide[row], 1)) % width, y0[row] + k // np.maximum(wide[row], 1)
        u, v, z, on = solve(pdf, row, px, py)
        on = np.flatnonzero(on & (np.abs(u) <= 1) & (np.abs(v) <= 1))
        yield row[on], px[on], py[on], z[on], (u * u + v * v)[on]
        at = to


def _spread(placed: DataFrame, own: list[str], boxes, width: int, height: int, solve, steps: float | None = None) -> DataFrame:
    """Fragments (own, z, px, py, r2) of patches; with ``steps`` the nearest discs (px, py, z, point_id) of each task's pixels."""
    if steps is not None:
        return _nearest(placed, boxes, width, height, solve, steps)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, px, py, z, r2 in _covered(pdf, boxes, width, solve):
                out = pdf[own].iloc[row].copy()
                out["z"], out["px"], out["py"], out["r2"] = z, px.astype(np.int32), py.astype(np.int32), r2
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.select(*own).schema)
    return placed.mapInPandas(spread, f"{kinds}, z double, px int, py int, r2 double")


def _nearest(placed: DataFrame, boxes, width: int, height: int, solve, steps: float) -> DataFrame:
    """(px, py, z, point_id): of each pixel the nearest disc that a task's points draw there, the lowest id at equal depths; z counts whole steps, rounded.

    A task keeps one depth and one id a pixel over all its batches, so what leaves it
    is a raster at most, however many fragments its discs have.
    """
    none, no_id = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # a null id comes first, as in z_buffer()

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        depth, first = np.full(width * height, none), np.full(width * height, none)
        drawn = np.zeros(width * height, bool)
        for pdf in batches:
            ids = pdf["__id"].to_numpy(np.int64)
            for row, px, py, z, r2 in _covered(pdf, boxes, width, solve):
                pixel, z = py * width + px, np.floor(z * steps + 0.5).astype(np.int64)
                near = np.flatnonzero((r2 <= 1) & (z <= depth[pixel]))
                row, pixel, z, before = row[near], pixel[near], z[near], depth.copy()
                np.minimum.at(depth, pixel, z)
                first[depth < before] = none
                best = np.flatnonzero(z == depth[pixel])
                np.minimum.at(first, pixel[best], ids[row[best]])
                drawn[pixel] = True
        at = np.flatnonzero(drawn)
        yield pd.DataFrame({"px": (at % width).astype(np.int32), "py": (at // width).astype(np.int32), "z": depth[at], "id": first[at]})

    named = placed.select(F.coalesce(F.col("point_id").cast("long"), F.lit(int(no_id))).alias("__id"), *[c for c in placed.columns if c.startswith("__")])
    found = named.mapInPandas(nearest, "px int, py int, z long, id long")
    return found.select("px", "py", "z", F.nullif("id", F.lit(int(no_id))).alias("point_id"))


def _numbers(pdf: pd.DataFrame, name: str, n: int) -> np.ndarray:
    """Held columns of a batch as n rows of numbers."""
    return np.stack([pdf[f"{name}{i}"].to_numpy(float, na_value=np.nan) for i in range(n)])


def _whole(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First pixel and number of pixels whose centre lies in [low, high], cut to the raster; none for NaN."""
    ok = low <= high
    first = np.clip(np.ceil(np.where(ok, low, size) - 0.5), 0, size).astype(np.int64)
    last = np.clip(np.floor(np.where(ok, high, -1) - 0.5), -1, size - 1).astype(np.int64)
    return first, np.maximum(last - first + 1, 0)


def _turned(matrix: list[Column], v: list[Column]) -> list[Column]:
    """A direction (not a place) by a matrix."""
    return [sum((matrix[4 * c + r] * v[c] for c in range(1, 3)), matrix[r] * v[0]) for r in range(4)]


def patches(points: DataFrame, camera: dict, size: float, width: int, height: int, basis: str = "facing", near: float | None = None, far: float | None = None, steps: float | None = None) -> DataFrame:
    """Fragments (px, py, z, r2) of square patches of half-width ``size`` in the world, at each point: pixels whose centre sees the patch, with the depth z = clip z / w there and the squared distance r2 from the patch's centre in half-widths.

    Exact in perspective: a place on the patch, centre + u right + v up, has the clip
    coordinates C + u A + v B, and a pixel at x, y of the screen sees the one with
    (C + u A + v B).x = x (C + u A + v B).w and the same for y; depth follows from u and v.
    A patch counts as a whole if its point's linear depth lies in the closed range
    ``near`` to ``far``, if given; apart from that only what lies before the near plane,
    beyond the far one or off the raster is cut off, wherever the centre is.  One
    seen edge-on has no fragment, nor has one with a null coordinate.  With ``steps``
    only the nearest discs' fragments (px, py, z, point_id), see _nearest().
    """
    df = clipped(points, camera)
    df = df if near is None else df.where(F.col("d").between(near, far))
    df, right, up = facing_patch(df, camera, basis)
    sized = [[a * size for a in axis] for axis in (right, up)]
    for name, values in (("__C", [F.col(f"c{c}") for c in "xyzw"]), ("__A", _turned(camera["both"], sized[0])), ("__B", _turned(camera["both"], sized[1]))):
        df, _ = M.held(df, name, values)
    own = [c for c in df.columns if not c.startswith("__") and c not in ("px", "py", "r2", "z")]
    placed = df.select(*own, *(f"__{k}{i}" for k in "CAB" for i in range(4)))

    def boxes(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        c, a, b = (_numbers(pdf, f"__{k}", 4) for k in "CAB")
        corners = np.stack([c + u * a + v * b for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))])  # corner, x y z w, row
        following = np.roll(corners, -1, axis=0)
        with np.errstate(all="ignore"):
            t = corners[:, 2] / (corners[:, 2] - following[:, 2])
            cut_ = corners + t[:, None] * (following - corners)  # where an edge meets the near plane
            tips = np.concatenate([corners, cut_])
            seen = np.concatenate([corners[:, 2] >= 0, (corners[:, 2] < 0) != (following[:, 2] < 0)]) & (tips[:, 3] > 0)
            sx, sy = (tips[:, 0] / tips[:, 3] + 1) * (width / 2), (1 - tips[:, 1] / tips[:, 3]) * (height / 2)
            ends = [(np.where(seen, v, np.inf).min(0) - 1e-6, np.where(seen, v, -np.inf).max(0) + 1e-6) for v in (sx, sy)]
        (x0, wide), (y0, high) = _whole(*ends[0], width), _whole(*ends[1], height)
        return x0, y0, wide, high

    def solve(pdf: pd.DataFrame, row: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, ...]:
        c, a, b = (_numbers(pdf, f"__{k}", 4)[:, row] for k in "CAB")
        x, y = (px + 0.5) / (width / 2) - 1, 1 - (py + 0.5) / (height / 2)
        a0, b0, c0 = a[0] - x * a[3], b[0] - x * b[3], x * c[3] - c[0]
        a1, b1, c1 = a[1] - y * a[3], b[1] - y * b[3], y * c[3] - c[1]
        det = a0 * b1 - a1 * b0
        with np.errstate(all="ignore"):
            u, v = (c0 * b1 - c1 * b0) / det, (a0 * c1 - a1 * c0) / det
            w = c[3] + u * a[3] + v * b[3]
            z = (c[2] + u * a[2] + v * b[2]) / w
        return u, v, z, (np.abs(det) > 1e-12) & (w > 0) & (z >= 0) & (z <= 1)

    return _spread(placed, own, boxes, width, height, solve, steps)


def spherical_patches(points: DataFrame, camera: dict, size: float, far: float, width: int, height: int, basis: str = "facing", steps: float | None = None) -> DataFrame:
    """The same on an equirectangular raster around the eye, with z = distance / far; what is farther than ``far`` isn't drawn.

    A pixel is a direction, so a patch over the seam shows on both sides, and one over
    a pole in every column; no patch is bent.  Rows that a patch may cover follow
    from its angle as seen from the eye, columns from that and its latitude.
    """
    df, right, up = facing_patch(points, camera, basis)
    for name, values in (("__C", M.transform(camera["view"], _xyz())[:3]), ("__A", _turned(camera["view"], right)[:3]), ("__B", _turned(camera["view"], up)[:3])):
        df, _ = M.held(df, name, values)
    own = [c for c in df.columns if not c.startswith("__") and c not in ("px", "py", "r2") and c != "depth"]
    placed = df.select(*own, *(f"__{k}{i}" for k in "CAB" for i in range(3)))
    own = [c for c in own if c != "z"]

    def boxes(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        x, y, z = _numbers(pdf, "__C", 3)
        with np.errstate(all="ignore"):
            away = np.sqrt(x * x + y * y + z * z)
            angle = np.where(away > size * math.sqrt(2), np.arcsin(np.minimum(1, size * math.sqrt(2) / away)), math.pi) + 1e-9
            lat = np.where(away > 0, np.arcsin(np.clip(y / away, -1, 1)), 0.0)
            over_pole = np.abs(lat) + angle >= math.pi / 2
            reach = np.where(over_pole, math.pi, np.arcsin(np.minimum(1, np.sin(angle) / np.maximum(np.cos(lat), 1e-300))))
            lon = np.arctan2(x, -z)
            known = np.isfinite(away)
            top, bottom = (1 - (lat + angle) / (math.pi / 2)) * (height / 2), (1 - (lat - angle) / (math.pi / 2)) * (height / 2)
            y0, high = _whole(np.where(known, top, np.nan), bottom, height)
            left = np.where(known, np.ceil(((lon - reach) / math.pi + 1) * (width / 2) - 0.5), 0)
            last = np.where(known, np.floor(((lon + reach) / math.pi + 1) * (width / 2) - 0.5), -1)
        wide = np.where(over_pole, width, np.clip(last - left + 1, 0, width)).astype(np.int64)
        return np.where(over_pole, 0, left).astype(np.int64), y0, np.where(known, wide, 0), high

    def solve(pdf: pd.DataFrame, row: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, ...]:
        c, a, b = (_numbers(pdf, f"__{k}", 3)[:, row] for k in "CAB")
        lon, lat = ((px + 0.5) / (width / 2) - 1) * math.pi, (1 - (py + 0.5) / (height / 2)) * (math.pi / 2)
        ray = np.stack([np.cos(lat) * np.sin(lon), np.sin(lat), -np.cos(lat) * np.cos(lon)])
        across = np.cross(a, b, axis=0)
        slope = (ray * across).sum(0)
        with np.errstate(all="ignore"):
            t = (c * across).sum(0) / slope
            place = t * ray - c
            u, v = (place * a).sum(0) / size, (place * b).sum(0) / size
        return u, v, t / far, (np.abs(slope) > 1e-12) & (t > 0) & (t <= far)

    return _spread(placed, own, boxes, width, height, solve, steps)


def world_disks(points: DataFrame, camera: dict, size: float, width: int, height: int, basis: str = "facing", **depths) -> DataFrame:
    """Fragments of discs of a radius in the world, ``facing`` the eye, or billboards across the ``guarded`` normal."""
    return patches(points, camera, size, width, height, basis, **depths).where("r2 <= 1")


def panorama_disks(points: DataFrame, camera: dict, size: float, far: float, width: int, height: int, basis: str = "facing") -> DataFrame:
    """Fragments of discs on an equirectangular raster."""
    return spherical_patches(points, camera, size, far, width, height, basis).where("r2 <= 1")


def nearest_disks(points: DataFrame, camera: dict, size: float, width: int, height: int, steps: float, basis: str = "facing", far: float | None = None) -> DataFrame:
    """(px, py, z, point_id): the nearest disc of each pixel, by depths in so many steps a unit; on an equirectangular raster if ``far`` is given."""
    if far is None:
        return z_buffer(patches(points, camera, size, width, height, basis, steps=steps))
    return z_buffer(spherical_patches(points, camera, size, far, width, height, basis, steps))


def panorama_gaussians(points: DataFrame, camera: dict, size: float, far: float, width: int, height: int, sigma: float = 0.4, cut_: float = 0.01) -> DataFrame:
    """Fragments of Gaussians across the points' normals on an equirectangular raster, with their weight."""
    weight = F.exp(-F.col("r2") / (2 * sigma * sigma))
    return spherical_patches(points, camera, size, far, width, height, "normal").withColumn("weight", weight).where(F.col("weight") >= cut_)


def world_gaussians(points: DataFrame, camera: dict, size: float, width: int, height: int, sigma: float = 0.4, cut_: float = 0.01, **depths) -> DataFrame:
    """Fragments of Gaussians across the points' normals, with their weight."""
    weight = F.exp(-F.col("r2") / (2 * sigma * sigma))
    return patches(points, camera, size, width, height, "normal", **depths).withColumn("weight", weight).where(F.col("weight") >= cut_)


def spherical_pixels(points: DataFrame, camera: dict, far: float | Column, width: int, height: int) -> DataFrame:
    """Points no farther than ``far`` with their pixel on an equirectangular raster and the depth z."""
    df, view = M.held(points, "__v", M.transform(camera["view"], _xyz())[:3])
    far = far if isinstance(far, Column) else F.lit(float(far))
    df = df.where(M.dot(view, view) <= far * far)
    u, v, depth = equirectangular(view, far)
    px = F.least(F.floor((u + 1) * (width / 2)), F.lit(width - 1)).cast("int")
    py = F.least(F.floor((1 - v) * (height / 2)), F.lit(height - 1)).cast("int")
    return df.withColumns({"px": px, "py": py, "z": depth}).drop("__v0", "__v1", "__v2")


def spherical_corners(corners: DataFrame, camera: dict) -> DataFrame:
    """Corner rows of quads() with their longitude, within half a turn of their point's, and latitude, in radians."""
    df, at = M.held(corners, "__p", M.transform(camera["view"], _xyz())[:3])
    df, q = M.held(df, "__q", M.transform(camera["view"], [F.col(f"q{c}") for c in "xyz"])[:3])
    one = F.lit(1.0)
    lon = [equirectangular(v, one)[0] * math.pi for v in (at, q)]
    lat = equirectangular(q, one)[1] * (math.pi / 2)
    return df.withColumns({"lon": unwrapped(lon[1], lon[0]), "lat": lat}).drop(*(f"__{a}{i}" for a in "pq" for i in range(3)))


def near_target(points: DataFrame, target: tuple[float, float, float], within: float = 0.02) -> DataFrame:
    """Adds is_target: closer to the target than ``within``."""
    v = [F.col(c) - t for c, t in zip("xyz", target)]
    return points.withColumn("is_target", F.sqrt(M.dot(v, v)) < within)


def coloured(points: DataFrame, word: Column) -> DataFrame:
    """Adds r, g, b of a packed colour."""
    return points.withColumns(dict(zip("rgb", unpack(word)[:3])))


def chunks(points: DataFrame, cell: str = "cell_id") -> DataFrame:
    """(cell, n, cx, cy, cz, global_start): cells with centroids, and how many points the cells before have, by a two-level sum."""
    cells = points.groupBy(cell).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"))
    ranged = cut(cells.repartitionByRange(cell).withColumn("__part", F.spark_partition_id()))
    parts = ranged.groupBy("__part").agg(F.sum("n").alias("m"))
    before = parts.select("__part", (F.sum("m").over(Window.orderBy("__part")) - F.col("m")).alias("before"))  # one row for each range
    own = F.coalesce(F.sum("n").over(Window.partitionBy("__part").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(before, "__part").select(*cells.columns, (F.col("before") + own).alias("global_start"))


def chunk_order(cells: DataFrame, camera: dict, spherical: bool = False) -> DataFrame:
    """Cells from far to near, by their centroid's sort key."""
    at = cells.select(F.col("cell_id").alias("point_id"), *(F.col(f"c{c}").alias(c) for c in "xyz"))
    return back_to_front(at, camera, spherical).withColumnRenamed("point_id", "cell_id")
