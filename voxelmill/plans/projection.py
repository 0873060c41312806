"""Queries of cameras, projections and rasters of points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import color, geometry
from ..functions import matrix as M
from ..operators import cameras as C
from ..operators import projection as P
from ..operators.cloud import numbered
from .views import POINTS, micro, micros, points, table

W, H, FOV, NEAR, FAR = 64, 48, 60.0, 0.1, 50.0
EYE, TARGET = (9.0, 6.0, 11.0), (3.0, 2.5, 2.5)
#: An eye within the cloud; half-width of patches, and how far a panorama reaches.
INNER_EYE, SIZE, REACH = (0.3, 2.2, 3.0), 0.4, 2.0


EYES = {0: EYE, 1: (-4.0, 5.0, 9.0)}


def _fixed_camera(spark) -> dict:
    """A camera with constant matrices."""
    return C.fixed_camera(EYE, TARGET, W, H, FOV, NEAR, FAR)


def two_cameras(spark):
    return C.camera_rows(spark, EYES, TARGET, W, H, FOV, NEAR, FAR)


def _constants(eye=EYE) -> tuple[list, float, float, float, float]:
    """The same camera's view rows and projection terms, for the SQL."""
    e, t = np.array(eye), np.array(TARGET)
    z = (e - t) / math.sqrt(((e - t) ** 2).sum())
    x = np.cross([0.0, 1.0, 0.0], z)
    x /= math.sqrt((x**2).sum())
    y = np.cross(z, x)
    f = 1 / math.tan(math.radians(FOV) / 2)
    return [[*map(float, r), -float(r @ e)] for r in (x, y, z)], f / (W / H), f, FAR / (NEAR - FAR), FAR * NEAR / (NEAR - FAR)


def sql_view(eye=EYE, at="xyz") -> list[str]:
    """The three view coordinates as SQL."""
    rows = _constants(eye)[0]
    return [" + ".join(f"({r[i]!r}e0) * {c}" for i, c in enumerate(at)) + f" + ({r[3]!r}e0)" for r in rows]


def sql_clip(table="points", name="clip", eye=EYE) -> str:
    _, fx, fy, a, b = _constants(eye)
    v = sql_view(eye)
    return f"""v_{name} AS (SELECT *, {v[0]} AS vx, {v[1]} AS vy, {v[2]} AS vz FROM {table}),
    {name} AS (SELECT *, ({fx!r}e0) * vx AS cx, ({fy!r}e0) * vy AS cy, ({a!r}e0) * vz + ({b!r}e0) AS cz, -vz AS cw, -vz AS d FROM v_{name})"""


SEEN = "cw > 0 AND ABS(cx) <= cw AND ABS(cy) <= cw AND cz >= 0 AND cz <= cw"
PIXEL = f"LEAST(CAST(FLOOR((cx / cw + 1e0) * {W / 2}e0) AS INT), {W - 1}) AS px, LEAST(CAST(FLOOR((1e0 - cy / cw) * {H / 2}e0) AS INT), {H - 1}) AS py"


def _sql_clip() -> str:
    return f"""{POINTS}, {sql_clip()},
    seen AS (SELECT point_id, las_class, {PIXEL}, {micro('cz / cw')} AS z, d FROM clip WHERE {SEEN})"""


def _placed(spark, d):
    """Pixels with the depth in millionths, so that engines agree on ties."""
    return P.pixels(points(spark, d), _fixed_camera(spark), W, H).withColumn("z", micros(F.col("z")))


def cloud_bbox(spark, d):
    return geometry.box(points(spark, d))


def cloud_recentred(spark, d):
    return geometry.recentred(points(spark, d)).select("point_id", *(micros(F.col(c)).alias(c) for c in "xyz"))


def cloud_up_axis(spark, d):
    return geometry.up_axis(geometry.box(points(spark, d)))


def cloud_pack_color(spark, d):
    rgb = [F.col("x") / 6.0, F.col("y") / 5.0, F.col("z") / 5.0]
    return points(spark, d).select("point_id", color.pack(*rgb).alias("rgba"))


def cloud_unpack_color(spark, d):
    word = color.pack(F.col("x") / 6.0, F.col("y") / 5.0, F.col("z") / 5.0)
    return points(spark, d).select("point_id", *(micros(c).alias(n) for n, c in zip("rgba", color.unpack(word))))


def cloud_quantised(spark, d):
    """Thousandths above the box's lower corner, and the coordinates read back from them."""
    p = points(spark, d).crossJoin(F.broadcast(geometry.box(points(spark, d))))
    q = p.select("point_id", *(geometry.to_mm(F.col(c), F.col(f"{c}0")).alias(f"q{c}") for c in "xyz"), "x0", "y0", "z0")
    return q.select("point_id", "qx", "qy", "qz", *(micros(geometry.from_mm(F.col(f"q{c}"), F.col(f"{c}0"))).alias(c) for c in "xyz"))


def _targets(spark, d):
    """A target for each supplier, how many poses it asks for and how far away."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.cast("int").alias("target_id"), (k % 7 * 0.5).alias("tx"), (k % 3 * 1.0).alias("ty"), (k % 11 * 0.25).alias("tz"), (k % 40 + 1).cast("int").alias("n"), (k % 3 + 1.0).alias("radius"))


def camera_fibonacci(spark, d):
    """Poses around each supplier's target."""
    return C.hemispheres(_targets(spark, d)).select("target_id", "i", *(micros(F.col(c)).alias(c) for c in "xyz"))


def camera_tasks(spark, d):
    """Five poses around each target, numbered."""
    return C.tasks(spark, _targets(spark, d), 5, 2.0).select("task_id", "target_id", "i", *(micros(F.col(f"e{c}")).alias(f"e{c}") for c in "xyz"))


def _poses(spark, d):
    return C.fibonacci(spark, 64, 8.0, TARGET).crossJoin(F.broadcast(geometry.box(points(spark, d))))


def camera_tight_range(spark, d):
    near, far = C.tight_range([F.col(c) for c in "xyz"], M.lit(*TARGET))
    return _poses(spark, d).select("i", micros(near).alias("near"), micros(far).alias("far"))


def camera_spherical_far(spark, d):
    return _poses(spark, d).select("i", micros(C.spherical_camera([F.col(c) for c in "xyz"])["far"]).alias("far"))


def camera_poses(spark, d):
    """The rotation's nine entries, translation and centre of each pose: a quaternion's sign is free."""
    eye = [F.col(c) for c in "xyz"]
    df, camera = C.perspective_camera(_poses(spark, d), eye, M.lit(*TARGET), W, H, FOV)
    df, q, t = M.colmap_pose(df, camera["view"], eye)
    entries = {f"r{i}{j}": v for i, row in enumerate(M.rotation_of(q)) for j, v in enumerate(row)}
    return df.select("i", *(micros(c).alias(n) for n, c in entries.items()), *(micros(c).alias(f"t{n}") for n, c in zip("xyz", t)), *(micros(c).alias(n) for n, c in zip("xyz", M.camera_center(q, t))))


def camera_poses_to_target(spark, d):
    """The same from eye and target alone, of the poses that aren't straight above."""
    eye = [F.col(c) for c in "xyz"]
    df, q, t = M.colmap_pose_to_target(_poses(spark, d).where("i > 0"), eye, M.lit(*TARGET))
    entries = {f"r{i}{j}": v for i, row in enumerate(M.rotation_of(q)) for j, v in enumerate(row)}
    return df.select("i", *(micros(c).alias(n) for n, c in entries.items()), *(micros(c).alias(f"t{n}") for n, c in zip("xyz", t)))


def view_results(spark, d):
    """Results of two views at once: pose, intrinsics, points in view, density."""
    out = P.view_results(two_cameras(spark), points(spark, d), W, H, FOV)
    return out.select("view", "filename", "in_view", *(micros(F.col(c)).alias(c) for c in ("density", "fx", "fy", "cx", "cy")), *(micros(F.abs(c)).alias(c) for c in ("q0", "q1", "q2", "q3")), *(micros(F.col(c)).alias(c) for c in ("t0", "t1", "t2")))


#: Ten eyes within the cloud, so that each sees a part of it.
INNER_EYES = {k: (3.0 + 0.3 * k - 1.5, 2.0 + 0.1 * (k * 7 % 10), 2.5 + (1.0 if k % 2 else -1.0) * (0.4 + 0.15 * k)) for k in range(10)}


def culled_views(spark, d):
    """How many points ten views within the cloud have in their frusta, and the nearest and farthest of them."""
    seen = P.clipped(P.seen_by(points(spark, d), C.camera_rows(spark, INNER_EYES, TARGET, W, H, FOV, NEAR, FAR)), C.camera_of_row()).where(P.in_frustum())
    return seen.groupBy("view").agg(F.count("*").alias("n"), F.sum("point_id").alias("ids"), micros(F.min("d")).alias("nearest"), micros(F.max("d")).alias("farthest"))


def mean_density(spark, d):
    out = P.mean_density(P.view_results(two_cameras(spark), points(spark, d), W, H, FOV))
    return out.select(micros(F.col("mean_density")).alias("mean_density"), "views")


def camera_intrinsics(spark, d):
    """Intrinsics of each customer's camera."""
    size, fov = F.col("c_custkey") % 7 * 128.0 + 256, F.radians(F.col("c_custkey") % 90 + 20.0)
    return table(spark, d, "customer").select("c_custkey", *(micros(v).alias(n) for n, v in M.intrinsics(2 * size, size, fov).items()))


def frustum_pixels(spark, d):
    return P.z_buffer(_placed(spark, d)).select("px", "py", "point_id", "z")


def frustum_density(spark, d):
    return P.density(points(spark, d), _fixed_camera(spark), W, H).select("in_view", micros(F.col("density")).alias("density"))


def frustum_depths(spark, d):
    return P.view_depth(points(spark, d), _fixed_camera(spark)).select("point_id", micros(F.col("d")).alias("d"))


def sort_keys(spark, d):
    return P.back_to_front(points(spark, d), _fixed_camera(spark)).select("point_id", micros(F.col("key")).alias("key"))


def sort_keys_spherical(spark, d):
    return P.back_to_front(points(spark, d), _fixed_camera(spark), True).select("point_id", micros(F.col("key")).alias("key"))


def equirectangular(spark, d):
    v = [F.col(c) - e for c, e in zip("xyz", TARGET)]
    return points(spark, d).select("point_id", *(micros(c).alias(n) for n, c in zip(("u", "v", "depth"), geometry.equirectangular(v, F.lit(8.0)))))


def depth_range_pixels(spark, d):
    """Pixels of the points in a closed range of linear depths."""
    return P.z_buffer(P.pixels(points(spark, d), _fixed_camera(spark), W, H, 10.0, 13.0).withColumn("z", micros(F.col("z")))).select("px", "py", "point_id", "z")


def spherical_raster(spark, d):
    """Nearest point of each pixel of a panorama; what is farther than 9 isn't drawn."""
    out = P.spherical_pixels(points(spark, d), _fixed_camera(spark), 12.0, W, H).withColumn("z", micros(F.col("z")))
    return P.z_buffer(out).select("px", "py", "point_id", "z")


def gaussian_blend(spark, d):
    """Gaussian splats of two pixels' radius laid over each other from far to near."""
    lit = _placed(spark, d).withColumns({"r": F.col("x") / 6.0, "g": F.col("y") / 5.0, "b": F.col("z").cast("double") / 1e6})
    return P.blended(P.gaussians(lit, 2, W, H)).select("px", "py", *(micros(F.col(c)).alias(c) for c in "rgba"))


def _with_normals(spark, d):
    """Points with a normal that follows from their id; every fifth has none."""
    k = F.col("point_id")
    n = [F.when(k % 5 == 0, 0.0).otherwise(((k * m) % 41 - 20) / 20.0) for m in (7, 13, 29)]
    return points(spark, d).withColumns(dict(zip(("nx", "ny", "nz"), n)))


def _world(spark, d, basis=None, draw=P.world_disks):
    out = draw(_with_normals(spark, d), _fixed_camera(spark), SIZE, W, H, *[basis] * bool(basis))
    return out.withColumn("z", micros(F.col("z")))


def world_disk_raster(spark, d):
    """Discs of a radius of 0.4 in the world that face the eye."""
    return P.nearest_disks(_with_normals(spark, d), _fixed_camera(spark), SIZE, W, H, 1e6, "facing").select("px", "py", "point_id")


def billboard_raster(spark, d):
    """Discs across the points' normals; those without one face the eye."""
    return P.nearest_disks(_with_normals(spark, d), _fixed_camera(spark), SIZE, W, H, 1e6, "guarded").select("px", "py", "point_id")


def world_gaussian_weights(spark, d):
    """How many Gaussian fragments across normals each pixel has, and their weights' sum."""
    return _world(spark, d, draw=P.world_gaussians).groupBy("px", "py").agg(F.count("*").alias("n"), micros(F.sum("weight")).alias("weight"))


def _inner_camera():
    """A camera within the cloud, so that some patches cross its near plane, the seam behind it, and its poles."""
    return C.fixed_camera(INNER_EYE, TARGET, W, H, FOV, NEAR, FAR)


def inner_disk_raster(spark, d):
    """Discs of a radius of 0.4 that face an eye among them."""
    return P.nearest_disks(points(spark, d), _inner_camera(), SIZE, W, H, 1e6).select("px", "py", "point_id", "z")


def panorama_disk_raster(spark, d):
    """The same discs on a panorama around that eye, up to a distance of 2."""
    return P.nearest_disks(points(spark, d), _inner_camera(), SIZE, W, H, 1e6, far=REACH).select("px", "py", "point_id", "z")


def panorama_gaussian_weights(spark, d):
    """How many Gaussian fragments across normals each pixel of that panorama has, and their weights' sum."""
    out = P.panorama_gaussians(_with_normals(spark, d), _inner_camera(), SIZE, REACH, W, H)
    return out.groupBy("px", "py").agg(F.count("*").alias("n"), micros(F.sum("weight")).alias("weight"))


def quad_corners(spark, d):
    """Six corners of each point's quad: facing the eye, and across its normal."""
    p, eye = _with_normals(spark, d), M.lit(*EYE)
    at, normal = [F.col(c) for c in "xyz"], [F.col(f"n{c}") for c in "xyz"]
    kinds = [P.quads(*basis, 0.1).withColumn("kind", F.lit(k)) for k, basis in (("facing", P.facing_basis(p, at, eye)), ("normal", P.normal_basis(p, normal, at, eye)))]
    return kinds[0].unionByName(kinds[1]).select("kind", "point_id", "corner", *(micros(F.col(f"q{c}")).alias(f"q{c}") for c in "xyz"))


def spherical_corners(spark, d):
    """Longitude, unwrapped about the point's, and latitude of the corners of quads that face the eye."""
    quads = P.quads(*P.facing_basis(points(spark, d), [F.col(c) for c in "xyz"], M.lit(*EYE)), 0.1)
    return P.spherical_corners(quads, _fixed_camera(spark)).select("point_id", "corner", micros(F.col("lon")).alias("lon"), micros(F.col("lat")).alias("lat"))


def index_raster(spark, d):
    return P.index_raster(_placed(spark, d), W, H, 2)


def disk_raster(spark, d):
    near = P.z_buffer(P.disks(_placed(spark, d), 2, W, H), "las_class")
    return near.select("px", "py", "point_id", "las_class")


def chunk_table(spark, d):
    cells = points(spark, d).withColumn("cell_id", (F.floor(F.col("x") / 2) * 3 + F.floor(F.col("z") / 2)).cast("long"))
    return P.chunks(cells).select("cell_id", "n", *(micros(F.col(f"c{c}")).alias(f"c{c}") for c in "xyz"), "global_start")


def chunk_order(spark, d):
    """Cells from far to near by their centroids, with their place in that order."""
    cells = points(spark, d).withColumn("cell_id", (F.floor(F.col("x") / 2) * 3 + F.floor(F.col("z") / 2)).cast("long"))
    ordered = P.chunk_order(P.chunks(cells), _fixed_camera(spark))
    return numbered(ordered.withColumn("far_first", -F.col("key")), "place", "far_first", "cell_id").select("cell_id", micros(F.col("key")).alias("key"), "place")


def class_palette(spark, d):
    """How many points each colour of the palette shows, of which each nation sets one of its own."""
    k = F.col("n_nationkey")
    own = table(spark, d, "nation").select((k * 9).cast("int").alias("class_id"), *(((k * m) % 256).cast("int").alias(c) for c, m in zip("rgb", (11, 23, 37))))
    n = points(spark, d).groupBy((F.col("point_id") % 256).cast("int").alias("class_id")).agg(F.count("*").alias("n"))
    return color.palette(spark, own).join(n, "class_id").select("class_id", "r", "g", "b", "rgba", "n")


_BOX = f"{POINTS}, b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, MIN(z) AS z0, MAX(z) AS z1 FROM points)"
_PACK = " + ".join(f"(CAST(FLOOR({c} / {m}e0 * 255 + 0.5e0) AS BIGINT) & 255) * {k}" for c, m, k in (("x", 6.0, 1), ("y", 5.0, 256), ("z", 5.0, 65536))) + f" + {255 << 24}"
_FIB = "SELECT range AS i, sqrt(1e0 - yy * yy) * cos(range * th) AS ux, yy AS uy, sqrt(1e0 - yy * yy) * sin(range * th) AS uz FROM (SELECT range, 1e0 - CAST(range AS DOUBLE) / ({n} - 1) * 2e0 AS yy, pi() * (3e0 - sqrt(5e0)) AS th FROM range({n})) s WHERE yy >= 0"
_TARGETS = "(SELECT CAST(s_suppkey AS INT) AS target_id, s_suppkey % 7 * 0.5e0 AS tx, s_suppkey % 3 * 1e0 AS ty, s_suppkey % 11 * 0.25e0 AS tz, s_suppkey % 40 + 1 AS n, s_suppkey % 3 + 1e0 AS radius FROM supplier)"
_POSES = f"{_BOX}, f AS ({_FIB.format(n=64)}), e AS (SELECT i, {TARGET[0]}e0 + 8e0 * ux AS ex, {TARGET[1]}e0 + 8e0 * uy AS ey, {TARGET[2]}e0 + 8e0 * uz AS ez FROM f)"
_CORNERS = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
_RAY = f"r AS (SELECT *, ({TARGET[0]}e0 - ex) / n AS dx, ({TARGET[1]}e0 - ey) / n AS dy, ({TARGET[2]}e0 - ez) / n AS dz FROM (SELECT *, sqrt(({TARGET[0]}e0 - ex) ** 2 + ({TARGET[1]}e0 - ey) ** 2 + ({TARGET[2]}e0 - ez) ** 2) AS n FROM e) s)"
_ALONG = ", ".join(f"(x{i} - ex) * dx + (y{j} - ey) * dy + (z{k} - ez) * dz" for i, j, k in _CORNERS)
_REACH = ", ".join(f"sqrt((x{i} - ex) ** 2 + (y{j} - ey) ** 2 + (z{k} - ez) ** 2)" for i, j, k in _CORNERS)


def _hue() -> str:
    sector = [("c", "xx", "0e0"), ("xx", "c", "0e0"), ("0e0", "c", "xx"), ("0e0", "xx", "c"), ("xx", "0e0", "c"), ("c", "0e0", "xx")]
    rgb = [f"CAST(CASE WHEN i > 200 THEN {far} ELSE FLOOR((CASE CAST(FLOOR(h * 6) AS INT) % 6 {' '.join(f'WHEN {s} THEN {t[k]}' for s, t in enumerate(sector))} END + m) * 255 + 0.5e0) END AS INT) AS {n}" for k, (n, far) in enumerate(zip("rgb", (255, 0, 255)))]
    return f"""WITH s AS (SELECT range AS i, (range * {color.GOLDEN}e0) % 1e0 AS h, [0.88e0, 0.95e0, 0.72e0][range % 3 + 1] AS s, [0.52e0, 0.36e0, 0.66e0][range % 3 + 1] AS l FROM range(256)),
    t AS (SELECT *, (1 - ABS(2 * l - 1)) * s AS c FROM s), u AS (SELECT *, c * (1 - ABS((h * 6) % 2 - 1)) AS xx, l - c / 2 AS m FROM t), p AS (SELECT i, {", ".join(rgb)} FROM u)
    SELECT CAST(i AS INT) AS class_id, r, g, b, CAST(r AS BIGINT) + CAST(g AS BIGINT) * 256 + CAST(b AS BIGINT) * 65536 + {255 << 24} AS rgba FROM p"""


#: SQL of the class palette.
PALETTE = _hue()
QUERIES = {
    f.__name__: f
    for f in (
        cloud_bbox, cloud_recentred, cloud_up_axis, cloud_pack_color, cloud_unpack_color, cloud_quantised, camera_fibonacci, camera_tasks, camera_tight_range, camera_spherical_far, camera_poses, camera_poses_to_target, camera_intrinsics,
        view_results, culled_views, mean_density, frustum_pixels, frustum_density, frustum_depths, depth_range_pixels, sort_keys, sort_keys_spherical, equirectangular, spherical_raster, index_raster, disk_raster, gaussian_blend,
        world_disk_raster, billboard_raster, world_gaussian_weights, inner_disk_raster, panorama_disk_raster, panorama_gaussian_weights, quad_corners, spherical_corners, chunk_table, chunk_order, class_palette,
    )
}
_SPLAT = f"""{_sql_clip()}, o AS (SELECT a.range - 2 AS dx, b.range - 2 AS dy FROM range(5) a, range(5) b WHERE (a.range - 2) ** 2 + (b.range - 2) ** 2 <= 4),
    fr AS (SELECT CAST(px + dx AS INT) AS px, CAST(py + dy AS INT) AS py, z, point_id, las_class FROM seen, o WHERE px + dx BETWEEN 0 AND {W - 1} AND py + dy BETWEEN 0 AND {H - 1}),
    zb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM fr)"""
_ROT = f"""ah AS (SELECT *, dx AS a0, dy AS a1, dz AS a2, CASE WHEN ABS(dy) > 0.99e0 THEN 0e0 ELSE 1e0 END AS u1, CASE WHEN ABS(dy) > 0.99e0 THEN 1e0 ELSE 0e0 END AS u2 FROM (SELECT * FROM ({{ray}}) q) q2),
    rt AS (SELECT *, (a1 * u2 - a2 * u1) AS s0, (0e0 - a0 * u2) AS s1, (a0 * u1) AS s2 FROM ah),
    ru AS (SELECT *, s0 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS r00, s1 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS r01, s2 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS r02 FROM rt),
    rot AS (SELECT *, a1 * r02 - a2 * r01 AS r10, a2 * r00 - a0 * r02 AS r11, a0 * r01 - a1 * r00 AS r12, a0 AS r20, a1 AS r21, a2 AS r22 FROM ru)""".replace("{ray}", "SELECT *, (%s - ex) / n AS dx, (%s - ey) / n AS dy, (%s - ez) / n AS dz FROM (SELECT *, sqrt((%s - ex) ** 2 + (%s - ey) ** 2 + (%s - ez) ** 2) AS n FROM e) s" % tuple(f"{t}e0" for t in (*TARGET, *TARGET)))
_ENTRIES = ", ".join(micro(f"r{i}{j}") + f" AS r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(micro(f"-(r{i}0 * ex + r{i}1 * ey + r{i}2 * ez)") + f" AS t{n}" for i, n in enumerate("xyz"))


def _result_sql(view, eye) -> str:
    """One view's result: the quaternion's entries without their signs follow from the diagonal."""
    rows = _constants(eye)[0]
    r = [rows[0][:3], [-v for v in rows[1][:3]], [-v for v in rows[2][:3]]]
    q = [f"sqrt(GREATEST(0e0, 1e0 + ({a * r[0][0]!r}e0) + ({b * r[1][1]!r}e0) + ({c * r[2][2]!r}e0))) / 2" for a, b, c in ((1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1))]
    t = [f"-(({row[0]!r}e0) * ({eye[0]}e0) + ({row[1]!r}e0) * ({eye[1]}e0) + ({row[2]!r}e0) * ({eye[2]}e0))" for row in r]
    focal = f"{H / 2}e0 / tan(radians({FOV}e0) / 2)"
    return f"""SELECT * FROM (WITH {POINTS}, {sql_clip(eye=eye)} SELECT {view} AS view, 'image_{view + 1}.png' AS filename, COUNT(*) AS in_view, {micro(f'COUNT(*) / {float(W * H)}e0')} AS density, {micro(focal)} AS fx, {micro(focal)} AS fy, {micro(f'{W / 2}e0')} AS cx, {micro(f'{H / 2}e0')} AS cy,
        {', '.join(micro(e) + f' AS q{k}' for k, e in enumerate(q))}, {', '.join(micro(e) + f' AS t{k}' for k, e in enumerate(t))} FROM clip WHERE {SEEN}) s{view}"""


def _ahead(eye=EYE) -> str:
    return f"e0 AS (SELECT *, {', '.join(f'({eye[k]}e0 - {c}) AS g{c}' for k, c in enumerate('xyz'))} FROM points), e1 AS (SELECT *, {', '.join(f'g{c} / sqrt(gx * gx + gy * gy + gz * gz) AS a{c}' for c in 'xyz')} FROM e0)"


def _basis(ahead: str, up: str, eye=EYE) -> str:
    """right = up x ahead, made a unit vector, and ahead x right, of a table e2 with ahead m and up w."""
    return f"""{_ahead(eye)}, e2 AS (SELECT *, {ahead}, {up} FROM (SELECT *, {', '.join(f'CASE WHEN point_id % 5 = 0 THEN 0e0 ELSE ((point_id * {m}) % 41 - 20) / 20e0 END AS n{c}' for c, m in zip('xyz', (7, 13, 29)))} FROM e1) q),
    e3 AS (SELECT *, wy * mz - wz * my AS sx, wz * mx - wx * mz AS sy, wx * my - wy * mx AS sz FROM e2),
    e4 AS (SELECT *, {', '.join(f's{c} / sqrt(sx * sx + sy * sy + sz * sz) AS r{c}' for c in 'xyz')} FROM e3),
    based AS (SELECT *, my * rz - mz * ry AS ux, mz * rx - mx * rz AS uy, mx * ry - my * rx AS uz FROM e4)"""


def _facing(eye=EYE) -> str:
    return _basis("ax AS mx, ay AS my, az AS mz", "CASE WHEN ABS(ay) > 0.99e0 THEN 1e0 ELSE 0e0 END AS wx, CASE WHEN ABS(ay) > 0.99e0 THEN 0e0 ELSE 1e0 END AS wy, 0e0 AS wz", eye)


_FACING = _facing()
_LEN = "sqrt(nx * nx + ny * ny + nz * nz)"
_TURNED = {c: f"CASE WHEN {_LEN} >= 0.001e0 THEN n{c} / {_LEN} * CASE WHEN nx / {_LEN} * ax + ny / {_LEN} * ay + nz / {_LEN} * az < 0 THEN -1e0 ELSE 1e0 END ELSE a{c} END" for c in "xyz"}


def _guarded(eye=EYE) -> str:
    return _basis(", ".join(f"{e} AS m{c}" for c, e in _TURNED.items()), f"0e0 AS wx, CASE WHEN ABS({_TURNED['y']}) > 0.99e0 THEN 0e0 ELSE 1e0 END AS wy, CASE WHEN ABS({_TURNED['y']}) > 0.99e0 THEN 1e0 ELSE 0e0 END AS wz", eye)


_GUARDED = _guarded()
_CORNER_ROWS = "(VALUES (0, -1, -1), (1, 1, -1), (2, -1, 1), (3, -1, 1), (4, 1, -1), (5, 1, 1)) c(k, u, v)"


def _patches(basis: str, eye=EYE, panorama: bool = False) -> str:
    """Fragments fr (point_id, px, py, z, u, v) of patches with a half-width of SIZE: a pixel's ray meets the patch's plane."""
    view, fx, fy, a, b = _constants(eye)
    turned = lambda k: ", ".join(" + ".join(f"({row[i]!r}e0) * {k}{c}" for i, c in enumerate("xyz")) + f" AS {k}{n}" for n, row in enumerate(view))
    reach = SIZE * math.sqrt(2) * 1.000001
    x, y = f"((gx.range + 0.5e0) / {W / 2}e0 - 1e0)", f"(1e0 - (gy.range + 0.5e0) / {H / 2}e0)"
    if panorama:
        rays = f"cos({y} * pi() / 2) * sin({x} * pi()) AS d0, sin({y} * pi() / 2) AS d1, -cos({y} * pi() / 2) * cos({x} * pi()) AS d2"
        depth, shown = f"t / {REACH}e0", f"t <= {REACH}e0"
    else:
        rays = f"{x} / ({fx!r}e0) AS d0, {y} / ({fy!r}e0) AS d1, -1e0 AS d2"
        depth, shown = f"(({a!r}e0) * (-t) + ({b!r}e0)) / t", f"({a!r}e0) * (-t) + ({b!r}e0) BETWEEN 0 AND t"
    dot = lambda p, q: " + ".join(f"{p}{i} * {q}{i}" for i in range(3))
    return f"""{POINTS}, {basis}, vw AS (SELECT point_id, las_class, {', '.join(f'{v} AS c{k}' for k, v in enumerate(sql_view(eye)))}, {turned('r')}, {turned('u')} FROM based),
    pl AS (SELECT *, r1 * u2 - r2 * u1 AS n0, r2 * u0 - r0 * u2 AS n1, r0 * u1 - r1 * u0 AS n2 FROM vw), py_ AS (SELECT gx.range AS px, gy.range AS py, {rays} FROM range({W}) gx, range({H}) gy),
    near AS (SELECT * FROM pl JOIN py_ ON {dot('c', 'c')} <= {reach * reach!r}e0 OR {dot('c', 'c')} - ({dot('c', 'd')}) * ABS({dot('c', 'd')}) / ({dot('d', 'd')}) <= {reach * reach!r}e0),
    hit AS (SELECT *, ({dot('c', 'n')}) / ({dot('d', 'n')}) AS t FROM near WHERE ABS({dot('d', 'n')}) > 1e-12),
    uv AS (SELECT *, ((t * d0 - c0) * r0 + (t * d1 - c1) * r1 + (t * d2 - c2) * r2) / {SIZE}e0 AS u, ((t * d0 - c0) * u0 + (t * d1 - c1) * u1 + (t * d2 - c2) * u2) / {SIZE}e0 AS v FROM hit WHERE t > 0 AND {shown}),
    fr AS (SELECT point_id, px, py, {micro(depth)} AS z, u, v FROM uv WHERE ABS(u) <= 1 AND ABS(v) <= 1)"""


def _patch_sql(patches: str, *more: str) -> str:
    return f"WITH {patches} SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, point_id{''.join(', ' + c for c in more)} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM fr WHERE u * u + v * v <= 1) s WHERE k = 1"


def _weight_sql(patches: str) -> str:
    return f"WITH {patches} SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, COUNT(*) AS n, {micro('SUM(exp(-(u * u + v * v) / 0.32e0))')} AS weight FROM fr WHERE exp(-(u * u + v * v) / 0.32e0) >= 0.01 GROUP BY px, py"


ORACLE_SQL = {
    "cloud_bbox": f"WITH {_BOX} SELECT * FROM b",
    "cloud_recentred": f"WITH {_BOX} SELECT point_id, {micro('x - (x0 + x1) / 2')} AS x, {micro('y - y0')} AS y, {micro('z - (z0 + z1) / 2')} AS z FROM points, b",
    "cloud_up_axis": f"WITH {_BOX} SELECT CASE WHEN z1 - z0 <= y1 - y0 AND z1 - z0 <= x1 - x0 THEN 'z' WHEN y1 - y0 <= x1 - x0 THEN 'y' ELSE 'x' END AS up, GREATEST(x1 - x0, y1 - y0, z1 - z0) AS extent FROM b",
    "cloud_pack_color": f"WITH {POINTS} SELECT point_id, {_PACK} AS rgba FROM points",
    "cloud_unpack_color": f"WITH {POINTS}, w AS (SELECT point_id, {_PACK} AS v FROM points) SELECT point_id, {', '.join(micro(f'((v >> {8 * k}) & 255) / 255e0') + f' AS {n}' for k, n in enumerate('rgba'))} FROM w",
    "cloud_quantised": f"WITH {_BOX} SELECT point_id, {', '.join(f'{q} AS q{c}, {micro(f"{q} / 1000e0 + {c}0")} AS {c}' for c, q in ((c, f"CAST(round_even(CAST(({c} - {c}0) * 1000 AS FLOAT), 0) AS INT)") for c in "xyz"))} FROM points, b",
    "camera_fibonacci": f"""WITH p AS (SELECT *, 1e0 - i * 2e0 / (n - 1) AS yy, i * pi() * (3e0 - sqrt(5e0)) AS th FROM (SELECT *, unnest(range(n)) AS i FROM {_TARGETS} t WHERE n > 1) s)
        SELECT target_id, CAST(i AS INT) AS i, {micro('tx + radius * sqrt(1e0 - yy * yy) * cos(th)')} AS x, {micro('ty + radius * yy')} AS y, {micro('tz + radius * sqrt(1e0 - yy * yy) * sin(th)')} AS z FROM p WHERE yy >= 0""",
    "camera_tasks": f"""WITH f AS ({_FIB.format(n=10)}), t AS (SELECT * FROM {_TARGETS} s)
        SELECT CAST(ROW_NUMBER() OVER (ORDER BY target_id, i) - 1 AS INT) AS task_id, target_id, i, {micro('tx + 2e0 * ux')} AS ex, {micro('ty + 2e0 * uy')} AS ey, {micro('tz + 2e0 * uz')} AS ez FROM t, f WHERE i < 5""",
    "camera_tight_range": f"WITH {_POSES}, {_RAY}, m AS (SELECT i, GREATEST(LEAST({_ALONG}) / 1.1e0, 0.001e0) AS nr, GREATEST({_ALONG}) * 1.1e0 AS fr FROM r, b) SELECT i, {micro('nr')} AS near, {micro('GREATEST(fr, nr + 0.01e0)')} AS far FROM m",
    "camera_spherical_far": f"WITH {_POSES} SELECT i, {micro(f'GREATEST(GREATEST({_REACH}) * 1.05e0, 0.01e0)')} AS far FROM e, b",
    "camera_poses": f"WITH {_POSES}, {_ROT} SELECT i, {_ENTRIES}, {micro('ex')} AS x, {micro('ey')} AS y, {micro('ez')} AS z FROM rot",
    "camera_poses_to_target": f"WITH {_POSES}, {_ROT} SELECT i, {_ENTRIES} FROM rot WHERE i > 0",
    "view_results": " UNION ALL ".join(_result_sql(k, e) for k, e in EYES.items()),
    "culled_views": " UNION ALL ".join(f"SELECT * FROM (WITH {POINTS}, {sql_clip(eye=e)} SELECT {k} AS view, COUNT(*) AS n, CAST(SUM(point_id) AS BIGINT) AS ids, {micro('MIN(d)')} AS nearest, {micro('MAX(d)')} AS farthest FROM clip WHERE {SEEN} HAVING COUNT(*) > 0) s{k}" for k, e in INNER_EYES.items()),
    "mean_density": f"SELECT {micro('AVG(density)')} AS mean_density, COUNT(density) AS views FROM ({' UNION ALL '.join(f'(WITH {POINTS}, {sql_clip(eye=e)} SELECT COUNT(*) / {float(W * H)}e0 AS density FROM clip WHERE {SEEN} HAVING COUNT(*) > 0)' for e in EYES.values())}) s",
    "camera_intrinsics": f"SELECT c_custkey, {micro('s / 2 / tan(radians(f) / 2)')} AS fx, {micro('s / 2 / tan(radians(f) / 2)')} AS fy, {micro('s')} AS cx, {micro('s / 2')} AS cy FROM (SELECT c_custkey, c_custkey % 7 * 128e0 + 256 AS s, c_custkey % 90 + 20e0 AS f FROM customer) c",
    "frustum_pixels": f"WITH {_sql_clip()} SELECT px, py, point_id, z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM seen) s WHERE k = 1",
    "frustum_density": f"WITH {_sql_clip()} SELECT COUNT(*) AS in_view, {micro(f'COUNT(*) / {float(W * H)}e0')} AS density FROM seen",
    "frustum_depths": f"WITH {_sql_clip()} SELECT point_id, {micro('CASE WHEN cw > 0 AND ABS(cx) <= cw AND ABS(cy) <= cw AND cz >= 0 AND cz <= cw THEN d ELSE -1e0 END')} AS d FROM clip",
    "sort_keys": f"WITH {_sql_clip()} SELECT point_id, {micro('cz / cw')} AS key FROM clip",
    "sort_keys_spherical": f"WITH {_sql_clip()} SELECT point_id, {micro('sqrt(vx * vx + vy * vy + vz * vz)')} AS key FROM clip",
    "equirectangular": f"""WITH {POINTS}, v AS (SELECT point_id, x - {TARGET[0]}e0 AS a, y - {TARGET[1]}e0 AS b, z - {TARGET[2]}e0 AS c FROM points), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS d FROM v)
        SELECT point_id, {micro('CASE WHEN d > 0 THEN atan2(a + 0e0, 0e0 - c) / pi() ELSE 0e0 END')} AS u, {micro('CASE WHEN d > 0 THEN asin(GREATEST(-1e0, LEAST(1e0, b / d))) / (pi() / 2) ELSE 0e0 END')} AS v, {micro('GREATEST(0e0, LEAST(1e0, d / 8e0))')} AS depth FROM n""",
    "depth_range_pixels": f"WITH {_sql_clip()} SELECT px, py, point_id, z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM seen WHERE d BETWEEN 10e0 AND 13e0) s WHERE k = 1",
    "spherical_raster": f"""WITH {POINTS}, {sql_clip()}, s AS (SELECT point_id, sqrt(vx * vx + vy * vy + vz * vz) AS dist, vx, vy, vz FROM clip),
        p AS (SELECT point_id, LEAST(CAST(FLOOR((atan2(vx + 0e0, 0e0 - vz) / pi() + 1e0) * {W / 2}e0) AS INT), {W - 1}) AS px, LEAST(CAST(FLOOR((1e0 - asin(GREATEST(-1e0, LEAST(1e0, vy / dist))) / (pi() / 2)) * {H / 2}e0) AS INT), {H - 1}) AS py, {micro('dist / 12e0')} AS z FROM s WHERE dist <= 12)
        SELECT px, py, point_id, z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM p) s WHERE k = 1""",
    "gaussian_blend": f"""WITH RECURSIVE {_sql_clip()}, o AS (SELECT a.range - 2 AS dx, b.range - 2 AS dy, exp(-(((a.range - 2) ** 2 + (b.range - 2) ** 2) / 4e0) / 0.32e0) AS w FROM range(5) a, range(5) b),
        lit AS (SELECT s.px, s.py, s.z, s.point_id, p.x / 6e0 AS r, p.y / 5e0 AS g, s.z / 1e6 AS b FROM seen s JOIN points p USING (point_id)),
        fr AS (SELECT px + dx AS px, py + dy AS py, r, g, b, w, ROW_NUMBER() OVER (PARTITION BY px + dx, py + dy ORDER BY z DESC, point_id) AS k FROM lit, o WHERE w >= 0.01 AND px + dx BETWEEN 0 AND {W - 1} AND py + dy BETWEEN 0 AND {H - 1}),
        acc AS (SELECT px, py, k, r * w AS r, g * w AS g, b * w AS b, w AS a FROM fr WHERE k = 1
            UNION ALL SELECT f.px, f.py, f.k, f.r * f.w + c.r * (1 - f.w), f.g * f.w + c.g * (1 - f.w), f.b * f.w + c.b * (1 - f.w), f.w + c.a * (1 - f.w) FROM acc c JOIN fr f ON f.px = c.px AND f.py = c.py AND f.k = c.k + 1)
        SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, {micro('r')} AS r, {micro('g')} AS g, {micro('b')} AS b, {micro('a')} AS a FROM (SELECT *, MAX(k) OVER (PARTITION BY px, py) AS top FROM acc) s WHERE k = top""",
    "world_disk_raster": _patch_sql(_patches(_FACING)),
    "billboard_raster": _patch_sql(_patches(_GUARDED)),
    "world_gaussian_weights": _weight_sql(_patches(_GUARDED)),
    "inner_disk_raster": _patch_sql(_patches(_facing(INNER_EYE), INNER_EYE), "z"),
    "panorama_disk_raster": _patch_sql(_patches(_facing(INNER_EYE), INNER_EYE, True), "z"),
    "panorama_gaussian_weights": _weight_sql(_patches(_guarded(INNER_EYE), INNER_EYE, True)),
    "quad_corners": " UNION ALL ".join(
        f"SELECT * FROM (WITH {POINTS}, {basis} SELECT '{kind}' AS kind, point_id, CAST(c.k AS INT) AS corner, {', '.join(micro(f'{a} + (r{a} * c.u + u{a} * c.v) * 0.1e0') + f' AS q{a}' for a in 'xyz')} FROM based, {_CORNER_ROWS}) s" for kind, basis in (("facing", _FACING), ("normal", _GUARDED))
    ),
    "spherical_corners": f"""WITH {POINTS}, {_FACING}, q AS (SELECT point_id, CAST(c.k AS INT) AS corner, x, y, z, {', '.join(f'{a} + (r{a} * c.u + u{a} * c.v) * 0.1e0 AS q{a}' for a in 'xyz')} FROM based, {_CORNER_ROWS}),
        v AS (SELECT *, {', '.join(f'{e} AS a{n}' for n, e in zip('xyz', sql_view()))}, {', '.join(f'{e} AS k{n}' for n, e in zip('xyz', sql_view(at=('qx', 'qy', 'qz'))))} FROM q),
        l AS (SELECT *, atan2(ax + 0e0, 0e0 - az) AS la, atan2(kx + 0e0, 0e0 - kz) - atan2(ax + 0e0, 0e0 - az) AS d, asin(GREATEST(-1e0, LEAST(1e0, ky / sqrt(kx * kx + ky * ky + kz * kz)))) AS lat FROM v)
        SELECT point_id, corner, {micro('la + d - 2 * pi() * round_even(d / (2 * pi()), 0)')} AS lon, {micro('lat')} AS lat FROM l""",
    "index_raster": f"WITH {_SPLAT} SELECT px, py, point_id FROM zb WHERE k = 1",
    "disk_raster": f"WITH {_SPLAT} SELECT px, py, point_id, las_class FROM zb WHERE k = 1",
    "chunk_table": f"""WITH {POINTS}, c AS (SELECT CAST(FLOOR(x / 2) * 3 + FLOOR(z / 2) AS BIGINT) AS cell_id, COUNT(*) AS n, AVG(x) AS cx, AVG(y) AS cy, AVG(z) AS cz FROM points GROUP BY 1)
        SELECT cell_id, n, {micro('cx')} AS cx, {micro('cy')} AS cy, {micro('cz')} AS cz, CAST(COALESCE(SUM(n) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS global_start FROM c""",
    "chunk_order": f"""WITH {POINTS}, c AS (SELECT CAST(FLOOR(x / 2) * 3 + FLOOR(z / 2) AS BIGINT) AS cell_id, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM points GROUP BY 1), {sql_clip("c")}
        SELECT cell_id, {micro('cz / cw')} AS key, ROW_NUMBER() OVER (ORDER BY cz / cw DESC, cell_id) - 1 AS place FROM clip""",
    "class_palette": f"""WITH {POINTS}, o AS (SELECT n_nationkey * 9 AS class_id, {', '.join(f'n_nationkey * {m} % 256 AS {c}' for c, m in zip('rgb', (11, 23, 37)))} FROM nation), p AS ({PALETTE}),
        c AS (SELECT p.class_id, {', '.join(f'CAST(COALESCE(o.{c}, p.{c}) AS INT) AS {c}' for c in 'rgb')} FROM p LEFT JOIN o USING (class_id)), n AS (SELECT point_id % 256 AS class_id, COUNT(*) AS n FROM points GROUP BY 1)
        SELECT class_id, r, g, b, r + CAST(g AS BIGINT) * 256 + CAST(b AS BIGINT) * 65536 + {255 << 24} AS rgba, n FROM c JOIN n USING (class_id)""",
}
