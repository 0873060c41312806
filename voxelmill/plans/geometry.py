"""Queries of column functions: coordinates, colours, matrices, quaternions, poses."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import color, geometry
from ..functions import matrix as M
from ..operators import cameras as C
from ..operators import projection as P
from .projection import EYE, FAR, FOV, H, NEAR, PIXEL, SEEN, TARGET, W, sql_clip, sql_view
from .views import POINTS, micro, micros, points, table

def _xyz():
    return [F.col(c) for c in "xyz"]


def _named(df, *groups):
    """Key columns as they are, and values in millionths."""
    return df.select(*groups[0], *(micros(c).alias(n) for names, values in groups[1:] for n, c in zip(names, values)))


def survey_decoded(spark, d):
    """Scene coordinates of survey integers."""
    raw = table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), (F.col("o_custkey") % 5000).cast("int").alias("X"), (F.col("o_orderkey") % 3000).cast("int").alias("Y"), (F.col("o_orderkey") % 700).cast("int").alias("Z"))
    return _named(geometry.decoded(raw, (0.01, 0.02, 0.05), (10.0, -20.0, 30.0)), ["point_id"], ("xyz", _xyz()))


def swizzled_normals(spark, d):
    n = geometry.swizzled_normal(F.col("x") - 3, F.col("y") - 2, F.col("z") - 1)
    return _named(points(spark, d), ["point_id"], (("nx", "ny", "nz"), n))


def color_depths(spark, d):
    """16-bit channels as 0 to 1, white where there is none; as 8 bits and back."""
    c = F.when(F.col("point_id") % 4 > 0, F.col("point_id") * 97 % 65536)
    return points(spark, d).select("point_id", micros(color.las_color(c)).alias("unit"), color.to_8bit(c.cast("int")).alias("low"), color.to_16bit(color.to_8bit(c.cast("int"))).alias("high"))


def drawn_color(spark, d):
    """The word that is drawn by mode, and its red, green and blue."""
    k = F.col("point_id")
    word = color.shown(k % 3, color.pack(F.col("x") / 6, F.col("y") / 5, F.col("z") / 5), color.pack_bytes(k % 256, k % 100, k % 7), color.pack_bytes(F.lit(9), k % 50, F.lit(200)))
    return _named(P.coloured(points(spark, d).withColumn("word", word), F.col("word")), ["point_id", "word"], ("rgb", [F.col(c) for c in "rgb"]))


def near_target(spark, d):
    return P.near_target(points(spark, d), TARGET, 0.7).groupBy("is_target").agg(F.count("*").alias("n"))


def counts_to_keep(spark, d):
    """How many of each customer's orders some ways of thinning keep."""
    n = F.col("n")
    ways = {"half": geometry.count_for(n, percent=50), "quarter": geometry.count_for(n, percent=25), "few": geometry.count_for(n, keep=7), "less": geometry.count_for(n, remove=12)}
    clouds = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return clouds.select("o_custkey", "n", *(c.cast("long").alias(k) for k, c in ways.items()))


def file_names(spark, d):
    """Names of captured images and of classified clouds."""
    from ..sources import colmap as S

    p = points(spark, d)
    return p.select("point_id", S.image_name(F.col("point_id"), F.array("x", "y", "z")).alias("image"), S.classified_name(F.concat(F.lit("cloud"), F.col("point_id"), F.lit(".las"))).alias("cloud"))


def matrix_products(spark, d):
    """Points moved, scaled and turned about all three axes by one product of matrices."""
    m = M.multiply(M.translation(*M.lit(1, 2, 3)), M.scaling(*M.lit(2, 0.5, 4)), M.rotation("x", F.lit(0.3)), M.rotation("y", F.lit(-0.4)), M.rotation("z", F.lit(0.5)), M.identity())
    return _named(points(spark, d), ["point_id"], ("xyz", M.transform(m, _xyz())))


def quaternion_turns(spark, d):
    """Points turned by a product of two unit quaternions that depend on the point, and the product recovered from its rotation, up to its sign."""
    k = F.col("point_id")
    half = [(k % 628) / 100.0 / 2, (k * 7 % 628) / 100.0 / 2]
    a = [F.cos(half[0]), F.sin(half[0]) * 0.6, F.lit(0.0) * half[0], F.sin(half[0]) * 0.8]
    b = [F.cos(half[1]), F.lit(0.0) * half[1], F.sin(half[1]), F.lit(0.0) * half[1]]
    df, q = M.held(points(spark, d), "q", M.quaternion_product(a, b))
    df, back = M.held(df, "p", M.quaternion_of(M.rotation_of(q)))
    same = F.abs(sum((u * v for u, v in zip(q[1:], back[1:])), q[0] * back[0]))
    turned = [M.dot(row, _xyz()) for row in M.rotation_of(q)]
    return _named(df, ["point_id"], ("xyz", turned), (["same"], [same]))


def inverse_projections(spark, d):
    """Clip coordinates taken back to view space by the inverse projection."""
    args = [F.lit(math.radians(FOV)), F.lit(W / H), F.lit(NEAR), F.lit(FAR)]
    camera = C.fixed_camera(EYE, TARGET, W, H, FOV, NEAR, FAR)
    df, v = M.held(points(spark, d), "v", M.transform(camera["view"], _xyz())[:3])
    df, c = M.held(df, "c", M.transform(M.perspective(*args), v))
    inverse = M.inverse_perspective(*args)
    df, u = M.held(df, "u", [sum((inverse[4 * k + r] * c[k] for k in range(1, 4)), inverse[r] * c[0]) for r in range(4)])
    return _named(df, ["point_id"], ("xyz", [u[i] / u[3] for i in range(3)]))


def ortho_pixels(spark, d):
    """Nearest point of each pixel of a map: a camera straight above, with z up."""
    p = points(spark, d).crossJoin(F.broadcast(geometry.box(points(spark, d))))
    camera = C.ortho_camera(F.lit(20.0), F.lit(3.0013), F.lit(2.5037), F.lit(3.0), W, H)
    return P.z_buffer(P.pixels(p, camera, W, H).withColumn("z", micros(F.col("z")))).select("px", "py", "point_id", "z")


def perspective_cameras(spark, d):
    """Near, far, and where each camera sees the box's lower corner."""
    eye = _xyz()
    poses = C.fibonacci(spark, 64, 8.0, TARGET).crossJoin(F.broadcast(geometry.box(points(spark, d))))
    df, camera = C.perspective_camera(poses, eye, M.lit(*TARGET), W, H, FOV)
    clip = M.transform(camera["both"], [F.col("x0"), F.col("y0"), F.col("z0")])
    return _named(df, ["i"], (("near", "far"), [camera["near"], camera["far"]]), (("cx", "cy", "cz", "cw"), clip))


def _eyes(spark, d):
    """Each point with an eye of its own, not above the target."""
    k = F.col("point_id")
    eye = {"x": TARGET[0] + 4.0 + k % 5, "y": TARGET[1] + k % 9 * 0.5, "z": TARGET[2] + k % 7 - 3.0}
    return points(spark, d).withColumnsRenamed({c: f"p{c}" for c in "xyz"}).withColumns(eye)


def pose_projections(spark, d):
    """Clip coordinates of points by a pose and intrinsics in the convention with y down, built from each point's own camera."""
    df, q, t = M.colmap_pose_to_target(_eyes(spark, d), _xyz(), M.lit(*TARGET))
    k = M.intrinsics(F.lit(float(W)), F.lit(float(H)), F.lit(math.radians(FOV)))
    projection = M.projection_of_colmap(k["fx"], k["fy"], k["cx"], k["cy"], F.lit(float(W)), F.lit(float(H)), F.lit(NEAR), F.lit(FAR))
    clip = M.transform(M.multiply(projection, M.view_of_colmap(q, t)), [F.col(f"p{c}") for c in "xyz"])
    return _named(df, ["point_id"], (("cx", "cy", "cz", "cw"), clip))


def frustum_corners(spark, d):
    """Five vertices of the pyramid of each of those cameras."""
    df, q, t = M.colmap_pose_to_target(_eyes(spark, d), _xyz(), M.lit(*TARGET))
    return _named(df, ["point_id"], *[([f"{c}{k}" for c in "xyz"], v) for k, v in enumerate(C.frustum_mesh(q, t, 0.5))])


def overhead_poses(spark, d):
    """Poses above each supplier's target, for trials."""
    k = F.col("s_suppkey")
    targets = table(spark, d, "supplier").select(k.alias("target_id"), (k % 7 * 0.5).alias("tx"), F.lit(1.5).alias("ty"), (k % 11 * 0.25).alias("tz"), (k % 4).cast("int").alias("n"), (k % 3 + 1.0).alias("radius"))
    return _named(C.overhead(targets), ["target_id", "i"], ("xyz", _xyz()))


def orbit_eyes(spark, d):
    """Eyes around each point, by its id's turns."""
    k = (F.col("point_id") % 628).cast("double")
    return _named(points(spark, d), ["point_id"], ("xyz", C.orbit(_xyz(), F.lit(4.0) + k / 10, k / 7, k / 100)))


QUERIES = {f.__name__: f for f in (survey_decoded, swizzled_normals, color_depths, drawn_color, near_target, counts_to_keep, file_names, matrix_products, quaternion_turns, inverse_projections, ortho_pixels, perspective_cameras, pose_projections, frustum_corners, overhead_poses, orbit_eyes)}


def _millionths(**values: str) -> str:
    return ", ".join(f"{micro(v)} AS {k}" for k, v in values.items())


def _fibonacci(n: int) -> str:
    return f"""f AS (SELECT range AS i, sqrt(1e0 - yy * yy) * cos(range * th) AS ux, yy AS uy, sqrt(1e0 - yy * yy) * sin(range * th) AS uz FROM (SELECT range, 1e0 - CAST(range AS DOUBLE) / ({n} - 1) * 2e0 AS yy, pi() * (3e0 - sqrt(5e0)) AS th FROM range({n})) s WHERE yy >= 0),
    e AS (SELECT i, {TARGET[0]}e0 + 8e0 * ux AS ex, {TARGET[1]}e0 + 8e0 * uy AS ey, {TARGET[2]}e0 + 8e0 * uz AS ez FROM f)"""


def _axes(source: str, steep: bool) -> str:
    """right (s), down (w) and ahead (a) of cameras at (ex, ey, ez) that look at the target; near the vertical z is up if ``steep``."""
    t = [f"{v}e0" for v in TARGET]
    turn = "ABS(ay) > 0.99e0" if steep else "FALSE"
    return f"""a0 AS (SELECT *, sqrt(({t[0]} - ex) ** 2 + ({t[1]} - ey) ** 2 + ({t[2]} - ez) ** 2) AS n FROM {source}), a1 AS (SELECT *, ({t[0]} - ex) / n AS ax, ({t[1]} - ey) / n AS ay, ({t[2]} - ez) / n AS az FROM a0),
    a2 AS (SELECT *, CASE WHEN {turn} THEN ay ELSE -az END AS s0, CASE WHEN {turn} THEN -ax ELSE 0e0 END AS s1, CASE WHEN {turn} THEN 0e0 ELSE ax END AS s2 FROM a1),
    a3 AS (SELECT *, s0 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS sx, s1 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS sy, s2 / sqrt(s0 * s0 + s1 * s1 + s2 * s2) AS sz FROM a2),
    axes AS (SELECT *, ay * sz - az * sy AS wx, az * sx - ax * sz AS wy, ax * sy - ay * sx AS wz FROM a3)"""


_EYES = f"{POINTS}, e AS (SELECT *, {TARGET[0]}e0 + 4 + point_id % 5 AS ex, {TARGET[1]}e0 + point_id % 9 * 0.5e0 AS ey, {TARGET[2]}e0 + point_id % 7 - 3 AS ez FROM points)"
_F = 1 / math.tan(math.radians(FOV) / 2)
_PACK = " + ".join(f"(CAST(FLOOR({c} / {m}e0 * 255 + 0.5e0) AS BIGINT) & 255) * {k}" for c, m, k in (("x", 6.0, 1), ("y", 5.0, 256), ("z", 5.0, 65536))) + f" + {255 << 24}"
_ALONG = [f"((x{i} - ex) * ax + (y{j} - ey) * ay + (z{k} - ez) * az)" for i in (0, 1) for j in (0, 1) for k in (0, 1)]
_BOX = "b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1, MIN(z) AS z0, MAX(z) AS z1 FROM points)"
_RX = {c: e for c, e in zip("xyz", ("2e0 * x2 + 1e0", "0.5e0 * y2 + 2e0", "4e0 * z2 + 3e0"))}
ORACLE_SQL = {
    "survey_decoded": f"SELECT o_orderkey AS point_id, {_millionths(x='(o_custkey % 5000) * 0.01e0 + 10', y='(o_orderkey % 700) * 0.05e0 + 30', z='-(o_orderkey % 3000) * 0.02e0 - 20')} FROM orders",
    "swizzled_normals": f"WITH {POINTS} SELECT point_id, {_millionths(nx='x - 3', ny='z - 1', nz='2 - y')} FROM points",
    "color_depths": f"WITH {POINTS}, c AS (SELECT point_id, CASE WHEN point_id % 4 > 0 THEN point_id * 97 % 65536 END AS c FROM points) SELECT point_id, {micro('COALESCE(c / 65535e0, 1e0)')} AS unit, CAST(c // 256 AS INT) AS low, CAST(c // 256 * 257 AS INT) AS high FROM c",
    "drawn_color": f"""WITH {POINTS}, w AS (SELECT point_id, CASE point_id % 3 WHEN 1 THEN point_id % 256 + point_id % 100 * 256 + point_id % 7 * 65536 + {255 << 24} WHEN 2 THEN 9 + point_id % 50 * 256 + 200 * 65536 + {255 << 24} ELSE {_PACK} END AS word FROM points)
        SELECT point_id, word, {_millionths(r='(word & 255) / 255e0', g='((word >> 8) & 255) / 255e0', b='((word >> 16) & 255) / 255e0')} FROM w""",
    "near_target": f"WITH {POINTS} SELECT sqrt((x - {TARGET[0]}e0) ** 2 + (y - {TARGET[1]}e0) ** 2 + (z - {TARGET[2]}e0) ** 2) < 0.7e0 AS is_target, COUNT(*) AS n FROM points GROUP BY 1",
    "counts_to_keep": "SELECT o_custkey, n, GREATEST(1, CAST(round_even(n * 0.5e0, 0) AS BIGINT)) AS half, GREATEST(1, CAST(round_even(n * 0.25e0, 0) AS BIGINT)) AS quarter, LEAST(n, 7) AS few, GREATEST(0, n - 12) AS less FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) c",
    "file_names": f"WITH {POINTS} SELECT point_id, 'image_' || (point_id + 1) || '_' || x || '_' || y || '_' || z || '.png' AS image, 'cloud' || point_id || '_classified.las' AS cloud FROM points",
    "matrix_products": f"""WITH {POINTS}, a AS (SELECT *, x * cos(0.5e0) - y * sin(0.5e0) AS xa, x * sin(0.5e0) + y * cos(0.5e0) AS ya, z AS za FROM points), b AS (SELECT *, xa * cos(-0.4e0) + za * sin(-0.4e0) AS xb, ya AS yb, za * cos(-0.4e0) - xa * sin(-0.4e0) AS zb FROM a),
        c AS (SELECT *, xb AS x2, yb * cos(0.3e0) - zb * sin(0.3e0) AS y2, yb * sin(0.3e0) + zb * cos(0.3e0) AS z2 FROM b) SELECT point_id, {_millionths(**_RX)} FROM c""",
    "quaternion_turns": f"""WITH {POINTS}, h AS (SELECT *, (point_id % 628) / 100e0 AS p, (point_id * 7 % 628) / 100e0 AS q FROM points),
        b AS (SELECT *, x * cos(q) + z * sin(q) AS xb, y AS yb, z * cos(q) - x * sin(q) AS zb FROM h), k AS (SELECT *, 0.6e0 * xb + 0.8e0 * zb AS kd FROM b)
        SELECT point_id, {_millionths(x='xb * cos(p) - 0.8e0 * yb * sin(p) + 0.6e0 * kd * (1 - cos(p))', y='yb * cos(p) + (0.8e0 * xb - 0.6e0 * zb) * sin(p)', z='zb * cos(p) + 0.6e0 * yb * sin(p) + 0.8e0 * kd * (1 - cos(p))')}, 1000000 AS same FROM k""",
    "inverse_projections": f"WITH {POINTS} SELECT point_id, {_millionths(**dict(zip('xyz', sql_view())))} FROM points",
    "ortho_pixels": f"""WITH {POINTS}, {_BOX}, o AS (SELECT point_id, (x - 3.0013e0) / {3.0 * W / H}e0 AS cx, (z - 2.5037e0) / 3e0 AS cy, ((20 - y) - 0.1e0) / (GREATEST(1e0, 20 - y0 + 1) - 0.1e0) AS cz, 1e0 AS cw FROM points, b),
        s AS (SELECT point_id, {PIXEL}, {micro('cz')} AS z FROM (SELECT point_id, -cx AS cx, cy, cz, cw FROM o) o2 WHERE {SEEN}) SELECT px, py, point_id, z FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY px, py ORDER BY z, point_id) AS k FROM s) q WHERE k = 1""",
    "perspective_cameras": f"""WITH {POINTS}, {_BOX}, {_fibonacci(64)}, {_axes('e', True)}, m AS (SELECT *, GREATEST(LEAST({', '.join(_ALONG)}) / 1.1e0, 0.001e0) AS nr, GREATEST({', '.join(_ALONG)}) * 1.1e0 AS fr0 FROM axes, b), m2 AS (SELECT *, GREATEST(fr0, nr + 0.01e0) AS fr, (x0 - ex) * sx + (y0 - ey) * sy + (z0 - ez) * sz AS p, (x0 - ex) * wx + (y0 - ey) * wy + (z0 - ez) * wz AS q, (x0 - ex) * ax + (y0 - ey) * ay + (z0 - ez) * az AS o FROM m)
        SELECT i, {_millionths(near='nr', far='fr', cx=f'p * {_F / (W / H)!r}e0', cy=f'-q * {_F!r}e0', cz='(o - nr) * fr / (fr - nr)', cw='o')} FROM m2""",
    "pose_projections": f"""WITH {_EYES}, {_axes('e', False)}, m AS (SELECT *, (x - ex) * sx + (y - ey) * sy + (z - ez) * sz AS p, (x - ex) * wx + (y - ey) * wy + (z - ez) * wz AS q, (x - ex) * ax + (y - ey) * ay + (z - ez) * az AS o FROM axes)
        SELECT point_id, {_millionths(cx=f'p * {_F / (W / H)!r}e0', cy=f'-q * {_F!r}e0', cz=f'(o - {NEAR}e0) * {FAR}e0 / ({FAR}e0 - {NEAR}e0)', cw='o')} FROM m""",
    "frustum_corners": f"""WITH {_EYES}, {_axes('e', False)} SELECT point_id, {_millionths(**{f'{c}{k}': f'e{c} + 0.5e0 * ({u} * {r}x + {v} * {r}y + {2 if k else 0} * {r}z)' for k, (u, v) in enumerate(((0, 0), (1, 1), (1, -1), (-1, -1), (-1, 1))) for c, r in zip('xyz', 'swa')})} FROM axes""",
    "overhead_poses": f"SELECT s_suppkey AS target_id, CAST(i AS INT) AS i, {_millionths(x='s_suppkey % 7 * 0.5e0', y='2.5e0 + s_suppkey % 3', z='s_suppkey % 11 * 0.25e0')} FROM (SELECT s_suppkey, unnest(range(s_suppkey % 4)) AS i FROM supplier) s",
    "orbit_eyes": f"WITH {POINTS} SELECT point_id, {_millionths(x='x + (4 + k / 10) * cos(k / 100) * sin(k / 7)', y='y + (4 + k / 10) * sin(k / 100)', z='z + (4 + k / 10) * cos(k / 100) * cos(k / 7)')} FROM (SELECT *, point_id % 628 * 1e0 AS k FROM points) p",
}
