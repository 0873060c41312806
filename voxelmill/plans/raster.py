"""Queries of the raster operators, on the 64 x 64 raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..operators import tiles as T
from .views import POINTS, RASTER, SIDE, micro, micros, points, raster


def jacobi_step(spark, d):
    return R.jacobi_step(raster(spark, d))


def laplacian(spark, d):
    return R.laplacian(raster(spark, d), SIDE, SIDE)


def residual(spark, d):
    r = raster(spark, d)
    return R.residual(r, r.select("px", "py", (F.col("px") * 0.5 + F.col("py")).alias("f")), SIDE, SIDE)


def restrict(spark, d):
    return R.restricted(raster(spark, d))


def prolong(spark, d):
    return R.prolonged(R.restricted(raster(spark, d)), SIDE // 2, SIDE // 2).select("px", "py", micros(F.col("v")).alias("v"))


def correct(spark, d):
    r = raster(spark, d)
    return R.corrected(r, R.restricted(r), SIDE // 2, SIDE // 2).select("px", "py", micros(F.col("v")).alias("v"))


def blur_rows(spark, d):
    return R.blurred(raster(spark, d), 4, 2.0).select("px", "py", micros(F.col("v")).alias("v"))


def blur_density(spark, d):
    """The mask's density estimate: a wide blur along both axes."""
    mask = R.blurred(raster(spark, d).select("px", "py", "al"), 30, 15.0, "px", "al")
    return R.blurred(mask, 30, 15.0, "py", "al").select("px", "py", micros(F.col("al")).alias("al"))


def axpy(spark, d):
    r = raster(spark, d)
    return R.axpy(r, r.select("px", "py", F.col("al").alias("v")), 0.5)


def dot_product(spark, d):
    r = raster(spark, d)
    return R.dot(r, r).select(micros(F.col("dot")).alias("dot"))


def _colours(spark, d):
    r = raster(spark, d)
    own = r.select("px", "py", F.col("v").alias("r"), F.col("al").alias("g"), (F.col("px") / 64.0).alias("b"), F.lit(1.0).alias("a"))
    return own, own.select("px", "py", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), (F.col("py") / 64.0).alias("a"))


def channel_products(spark, d):
    """Products of two images by pixel and channel."""
    return R.products(*_colours(spark, d))


def channel_dots(spark, d):
    """Their sums."""
    return R.dots(*_colours(spark, d)).select(*(micros(F.col(c)).alias(c) for c in "rgba"))


def image_psnr(spark, d):
    r = raster(spark, d)
    own = r.select("px", "py", *(F.floor(F.col("v") * k).alias(c) for c, k in zip("rgba", (100.0, 80.0, 60.0, 40.0))))
    other = R.jacobi_step(r).select("px", "py", *(F.floor(F.col("v") * k).alias(c) for c, k in zip("rgba", (100.0, 80.0, 60.0, 40.0))))
    return R.psnr(own, other).select(*(micros(F.col(c)).alias(c) for c in ("mse", "psnr")))


def image_stats(spark, d):
    return R.image_stats(raster(spark, d))


def distance_field(spark, d):
    return R.exact_distance(raster(spark, d), SIDE, SIDE).select("px", "py", micros(F.col("dist")).alias("dist"))


#: Side of a tile of the solver queries: the raster is 4 x 4 of them.
TILE = SIDE // 4


def _solved(spark, d, method, steps):
    return T.solved(raster(spark, d).withColumn("view", F.lit(0)), method, steps, SIDE, SIDE, TILE, ("view",))


def sor_two_steps(spark, d):
    return _solved(spark, d, "sor", 2).select("px", "py", "v")


def jacobi_two_steps(spark, d):
    return _solved(spark, d, "jacobi", 2).select("px", "py", "v")


def jump_flood_distance(spark, d):
    return _solved(spark, d, "jfa", 0).select("px", "py", micros(F.col("v")).alias("dist"))


def multigrid(spark, d):
    return _solved(spark, d, "multigrid", 2).select("px", "py", "v")


def two_grid(spark, d):
    """One multigrid cycle of two levels with two smoothing steps each."""
    return _solved(spark, d, "two_grid", 1).select("px", "py", micros(F.col("v")).alias("v"))


def conjugate_gradient(spark, d):
    """Two steps of conjugate gradients."""
    return _solved(spark, d, "cg", 2).select("px", "py", micros(F.col("v")).alias("v"))


def restrict_boundary(spark, d):
    return R.restricted_boundary(raster(spark, d))


def byte_values(spark, d):
    """Values of 0 to 1 as bytes; what lies outside is clamped."""
    return raster(spark, d).select("px", "py", R.to_bytes(F.col("v") * 3.0 - 0.25).alias("v"))


def alpha_levels(spark, d):
    """The captured pixels with half to all but a hundredth of their alphas dropped."""
    from ..operators import cloud as C

    shown = raster(spark, d).select("px", "py", F.col("al").alias("a"))
    return C.masked_levels(shown)


def background(spark, d):
    """An image stretched over a wider raster, red and blue in the other order, and the plain one where there is none."""
    from ..operators import images as G

    r = raster(spark, d)
    image = r.select("px", "py", F.col("v").alias("r"), (F.col("px") * 0.0137).alias("g"), (F.col("py") * 0.0139).alias("b"), F.lit(1.0).alias("a"))
    out = G.swizzled(G.background(spark, image, (SIDE, SIDE), 80, 40)).withColumn("kind", F.lit("image"))
    plain = G.background(spark, None, (SIDE, SIDE), 80, 40, 0.25).withColumn("kind", F.lit("plain"))
    return out.unionByName(plain).select("kind", "px", "py", *(micros(F.col(c)).alias(c) for c in "rgba"))


def _layers(spark, d):
    r = raster(spark, d)
    three = r.withColumn("layer", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    kept = F.when((F.col("px") + F.col("py")) % 3 == F.col("layer"), F.col("al")).otherwise(0.0)
    return three.select("layer", (9.0 - F.col("layer") * 2.5).alias("depth"), "px", "py", (F.col("px") / 64.0).alias("r"), (F.col("py") / 64.0).alias("g"), F.col("v").alias("b"), ((F.col("px") % 5) * 0.01).alias("sdf"), ((F.col("py") % 7) * 0.05).alias("density"), kept.alias("al"))


def composite(spark, d):
    return R.composited(_layers(spark, d), SIDE, SIDE).select("px", "py", *(micros(F.col(c)).alias(c) for c in "rgba"))


def alpha_over(spark, d):
    r = raster(spark, d)
    top = r.select("px", "py", (F.col("px") / 64.0).alias("r"), (F.col("py") / 64.0).alias("g"), F.col("v").alias("b"), (F.col("al") * 0.5).alias("a"))
    bottom = r.select("px", "py", F.col("v").alias("r"), F.col("v").alias("g"), F.lit(0.25).alias("b"), F.lit(1.0).alias("a"))
    return R.alpha_over(top, bottom).select("px", "py", *(micros(F.col(c)).alias(c) for c in "rgba"))


def _reconstructed(spark, d, steps):
    """The whole chain on two cameras at once: depth bins of all points, slices, filled holes, distances and densities, layers over each other."""
    from ..operators import reconstruction as V
    from . import projection as views

    cameras = views.two_cameras(spark)
    p = points(spark, d).withColumns({"r": F.col("x") / 6.0, "g": F.col("y") / 5.0, "b": F.col("z") / 5.0})
    bins = V.view_bins(p, cameras, views.NEAR, views.FAR)
    return V.reconstructed(p, cameras, bins, views.W, views.H, steps).select("view", "px", "py", *(micros(F.col(c)).alias(c) for c in "rgba"))


def reconstructed_views(spark, d):
    """Two views, holes filled by all 5000 steps."""
    from ..operators import reconstruction as V

    return _reconstructed(spark, d, V.STEPS)


def reconstructed_one_step(spark, d):
    """The same after one step, as SQL can follow it."""
    return _reconstructed(spark, d, 1)


def _holed(spark, d):
    smooth = raster(spark, d).select("px", "py", ((F.col("px") + 2 * F.col("py")) * 1.25).alias("v"), "al")
    return smooth.withColumn("v", F.when(F.col("al") > 0, F.col("v")).otherwise(0.0)), smooth


def fill_quality(spark, d):
    """How well each solver fills the holes of a slanted plane that is known where the raster is captured."""
    from ..operators import reconstruction as V

    return V.compared(*_holed(spark, d), SIDE, SIDE, {"jacobi": 50, "sor": 50, "multigrid": 3}, TILE).select("method", micros(F.col("mse")).alias("mse"), micros(F.col("psnr")).alias("psnr"))


def fill_quality_few_steps(spark, d):
    """The same after the few steps that SQL can follow."""
    from ..operators import reconstruction as V

    return V.compared(*_holed(spark, d), SIDE, SIDE, {"jacobi": 2, "sor": 2, "two_grid": 1}, TILE).select("method", micros(F.col("mse")).alias("mse"), micros(F.col("psnr")).alias("psnr"))


def image_stretched(spark, d):
    from ..operators import images as G

    return G.stretched(raster(spark, d), (SIDE, SIDE), 96, 40, ("v", "al")).select("px", "py", *(micros(F.col(c)).alias(c) for c in ("v", "al")))


def image_resampled(spark, d):
    """The raster at 96 x 40 pixels by a windowed sinc: wider and lower."""
    from ..operators import images as G

    return G.resampled(raster(spark, d), (SIDE, SIDE), 96, 40, ("v", "al")).select("px", "py", *(micros(F.col(c)).alias(c) for c in ("v", "al")))


def _sinc(old: int, new: int, lobes: int = 3) -> str:
    """Rows (new, old, w) of the weights, by a distance between centres."""
    wide = max(old / new, 1.0)
    x = f"(o.range + 0.5e0 - (n.range + 0.5e0) * {old / new!r}e0) / {wide!r}e0"
    part = lambda v: f"CASE WHEN {v} = 0 THEN 1e0 ELSE sin(pi() * ({v})) / (pi() * ({v})) END"
    inside = f"o.range >= FLOOR((n.range + 0.5e0) * {old / new!r}e0 - {lobes * wide!r}e0 + 0.5e0) AND o.range < FLOOR((n.range + 0.5e0) * {old / new!r}e0 + {lobes * wide!r}e0 + 0.5e0)"
    return f"SELECT new, old, w / SUM(w) OVER (PARTITION BY new) AS w FROM (SELECT n.range AS new, o.range AS old, CASE WHEN ABS({x}) < {lobes} THEN ({part(x)}) * ({part(f'({x}) / {lobes}')}) ELSE 0e0 END AS w FROM range({new}) n JOIN range({old}) o ON {inside}) s"


QUERIES = {f.__name__: f for f in (image_stretched, image_resampled, reconstructed_views, reconstructed_one_step, fill_quality, fill_quality_few_steps, two_grid, conjugate_gradient, restrict_boundary, byte_values, alpha_levels, background, jacobi_step, laplacian, residual, restrict, prolong, correct, blur_rows, blur_density, axpy, dot_product, channel_products, channel_dots, image_psnr, image_stats, distance_field, sor_two_steps, jacobi_two_steps, jump_flood_distance, multigrid, composite, alpha_over)}


_OVER = {"l": ("py", "px", "LAG"), "r": ("py", "px", "LEAD"), "d": ("px", "py", "LAG"), "u": ("px", "py", "LEAD")}


def _taps(table: str, name: str, cols: str = "px, py, v, al", by: str = "", values: tuple[str, ...] = ("v",)) -> str:
    """The table with its neighbours l, r, d, u, of several values with the value's name behind; ``by`` are further keys."""
    many = len(values) > 1
    taps = ", ".join(f"COALESCE({f}({v}) OVER (PARTITION BY {by}{line} ORDER BY {order}), {v}) AS {k}{v if many else ''}" for v in values for k, (line, order, f) in _OVER.items())
    return f"{name} AS (SELECT {cols}, {taps} FROM {table})"


def _sweeps(table: str, steps: int, name: str = "s") -> tuple[str, str]:
    """The tables of so many over-relaxation steps, and the last one's name."""
    out = ""
    for k in range(steps):
        for p in (1, 0):
            out += f", {_taps(table, f'{name}t{k}{p}')}, {name}{k}{p} AS (SELECT px, py, al, CASE WHEN al > 0 OR (px + py) % 2 <> {p} THEN v ELSE 1.9e0 * (0.25e0 * (((l + r) + d) + u)) + (1e0 - 1.9e0) * v END AS v FROM {name}t{k}{p})"
            table = f"{name}{k}{p}"
    return out, table


def _jacobi(table: str, steps: int, name: str = "j") -> tuple[str, str]:
    out = ""
    for k in range(steps):
        out += f", {_taps(table, f'{name}t{k}')}, {name}{k} AS (SELECT px, py, al, CASE WHEN al > 0 THEN v ELSE 0.25e0 * (((l + r) + d) + u) END AS v FROM {name}t{k})"
        table = f"{name}{k}"
    return out, table


def _relaxed(table: str, steps: int, name: str) -> tuple[str, str]:
    """Damped Jacobi steps for Laplace(v) = f on a table (px, py, v, al, f)."""
    out = ""
    for k in range(steps):
        out += f", {_taps(table, f'{name}t{k}', 'px, py, v, al, f')}, {name}{k} AS (SELECT px, py, al, f, CASE WHEN al > 0 THEN v ELSE 0.8e0 * (0.25e0 * (((l + r) + d) + u) - 0.25e0 * f) + 0.2e0 * v END AS v FROM {name}t{k})"
        table = f"{name}{k}"
    return out, table


def _two_grid(table: str) -> tuple[str, str]:
    """One cycle of two levels on (px, py, v, al): smooth, solve the halved residual, correct, smooth."""
    a, fine = _relaxed("g0", 2, "ga")
    b, coarse = _relaxed("half0", 6, "gb")
    c, last = _relaxed("g1", 2, "gc")
    return f""", g0 AS (SELECT px, py, v, al, 0e0 AS f FROM {table}){a}, {_taps(fine, 'gr', 'px, py, v, al, f')},
    rest AS (SELECT px, py, al, CASE WHEN al > 0 THEN 0e0 ELSE f - 4e0 * (0.25e0 * (((l + r) + d) + u) - v) END AS q FROM gr),
    half0 AS (SELECT CAST(px // 2 AS INT) AS px, CAST(py // 2 AS INT) AS py, 0e0 AS v, MAX(al) AS al, SUM(q) AS f FROM rest GROUP BY 1, 2){b},
    g1 AS (SELECT a.px, a.py, CASE WHEN a.al > 0 THEN a.v ELSE a.v + e.v END AS v, a.al, a.f FROM {fine} a JOIN {coarse} e ON e.px = a.px // 2 AND e.py = a.py // 2){c}""", last


def _gradients(table: str) -> tuple[str, str]:
    """Two steps of conjugate gradients on (px, py, v, al)."""
    apply = "CASE WHEN al > 0 THEN 0e0 ELSE 4e0 * ({x} - 0.25e0 * (((l + r) + d) + u)) END"
    return f""", {_taps(table, 'c0')}, c1 AS (SELECT px, py, al, v, -({apply.format(x='v')}) AS q FROM c0), c2 AS (SELECT px, py, al, v AS w, q AS rs, q AS v FROM c1), {_taps('c2', 'c3', 'px, py, v, al, w, rs')},
    c4 AS (SELECT px, py, al, w, rs, v AS p, {apply.format(x='v')} AS ap FROM c3), s1 AS (SELECT SUM(rs * rs) AS rr, SUM(rs * rs) / SUM(p * ap) AS st FROM c4),
    c5 AS (SELECT px, py, al, w + st * p AS w, rs - st * ap AS rs, p FROM c4, s1), s2 AS (SELECT SUM(rs * rs) AS nw FROM c5), c6 AS (SELECT px, py, al, w, rs, rs + nw / rr * p AS v FROM c5, s1, s2), {_taps('c6', 'c7', 'px, py, v, al, w, rs')},
    c8 AS (SELECT px, py, al, w, rs, v AS p, {apply.format(x='v')} AS ap FROM c7), s3 AS (SELECT SUM(rs * rs) / SUM(p * ap) AS st FROM c8), c9 AS (SELECT px, py, al, w + st * p AS v FROM c8, s3)""", "c9"


def _flood(table: str, keys: str, width: int, height: int, name: str = "f") -> tuple[str, str]:
    """Jump flooding on (keys, px, py, al): tables with the seed sx, sy and its squared distance b, and the last one's name."""
    on = " AND ".join(f"n.{k} = a.{k}" for k in keys.split(", ") if k)
    k_ = f"{keys}, " if keys else ""
    ka = ", ".join(f"a.{k}" for k in keys.split(", ") if k) + (", " if keys else "")
    out = f", {name}0 AS MATERIALIZED (SELECT {k_}px, py, CASE WHEN al > 0 THEN px END AS sx, CASE WHEN al > 0 THEN py END AS sy FROM {table}), probe AS (SELECT a.range - 1 AS oy, b.range - 1 AS ox, CASE WHEN a.range = 1 AND b.range = 1 THEN -1 ELSE a.range * 3 + b.range END AS o FROM range(3) a, range(3) b)"
    last, stride, k = f"{name}0", 1 << (max(width, height).bit_length() - 1), 1
    while stride >= 1:
        out += f""", {name}{k} AS MATERIALIZED (SELECT {ka}a.px, a.py, (arg_min({{'x': n.sx, 'y': n.sy}}, {{'d': (n.sx - a.px) ** 2 + (n.sy - a.py) ** 2, 'o': o}}) FILTER (WHERE n.sx IS NOT NULL)).x AS sx, (arg_min({{'x': n.sx, 'y': n.sy}}, {{'d': (n.sx - a.px) ** 2 + (n.sy - a.py) ** 2, 'o': o}}) FILTER (WHERE n.sx IS NOT NULL)).y AS sy
            FROM {last} a CROSS JOIN probe LEFT JOIN {last} n ON {on + ' AND ' if on else ''}n.px = a.px + ox * {stride} AND n.py = a.py + oy * {stride} GROUP BY {ka}a.px, a.py)"""
        last, stride, k = f"{name}{k}", stride // 2, k + 1
    diagonal = f"sqrt({float(width * width + height * height)}e0)"
    return out + f", {name}d AS (SELECT {k_}px, py, CASE WHEN sx IS NULL THEN {diagonal} ELSE sqrt((sx - px) ** 2 + (sy - py) ** 2) / {diagonal} END AS dist FROM {last})", f"{name}d"


_STEP = f"{RASTER}, {_taps('raster', 't')}, j AS (SELECT px, py, al, CASE WHEN al > 0 THEN v ELSE 0.25e0 * (((l + r) + d) + u) END AS v FROM t)"
_LAP = f"{RASTER}, {_taps('raster', 't')}, lap AS (SELECT px, py, al, CASE WHEN al > 0 THEN 0e0 ELSE ((((l + r) + d) + u) - 4e0 * v) / ((1e0 / 63) * (1e0 / 63)) END AS v FROM t)"
_HALF = f"{RASTER}, half AS (SELECT px // 2 AS px, py // 2 AS py, SUM(v) / 4e0 AS v, SUM(al) / 4e0 AS al FROM raster GROUP BY 1, 2)"
_NEAR = "CAST(GREATEST(0, LEAST(31, {c} // 2 + CASE WHEN {c} % 2 = 0 THEN -1 ELSE 1 END)) AS INT)"
_FINE = f"""{_HALF}, fine AS (SELECT f.px, f.py, f.v AS v0, 0.5625e0 * a.v + 0.1875e0 * b.v + 0.1875e0 * c.v + 0.0625e0 * e.v AS v FROM raster f
    JOIN half a ON a.px = f.px // 2 AND a.py = f.py // 2 JOIN half b ON b.px = {_NEAR.format(c='f.px')} AND b.py = f.py // 2
    JOIN half c ON c.px = f.px // 2 AND c.py = {_NEAR.format(c='f.py')} JOIN half e ON e.px = {_NEAR.format(c='f.px')} AND e.py = {_NEAR.format(c='f.py')})"""


def _blur(table: str, name: str, value: str, radius: int, sigma: float, axis: str, keys: tuple[str, ...] = (), size: int = SIDE, rest: str = "") -> str:
    other = "py" if axis == "px" else "px"
    ka = "".join(f"a.{k}, " for k in keys)
    on = "".join(f"b.{k} = a.{k} AND " for k in keys)
    return f"""{name} AS MATERIALIZED (SELECT {ka}a.px, a.py, {rest}SUM(b.{value} * w.w) / SUM(w.w) AS {value} FROM {table} a
        CROSS JOIN (SELECT range - {radius} AS k, exp(-((range - {radius}) * (range - {radius})) / {2 * sigma * sigma}e0) AS w FROM range({2 * radius + 1})) w
        JOIN {table} b ON {on}b.{other} = a.{other} AND b.{axis} = GREATEST(0, LEAST({size - 1}, a.{axis} + w.k)) GROUP BY {ka}a.px, a.py)"""


_LAYERS = f"""{RASTER}, ly AS (SELECT layer, 9e0 - layer * 2.5e0 AS depth, px, py, px / 64e0 AS r, py / 64e0 AS g, v AS b, (px % 5) * 0.01e0 AS sdf, (py % 7) * 0.05e0 AS density, CASE WHEN (px + py) % 3 = layer THEN al ELSE 0e0 END AS al
        FROM raster, (SELECT CAST(range AS INT) AS layer FROM range(3)) k),
    tp AS (SELECT a.*, 1e0 - (a.depth - 4e0) / GREATEST(9e0 - 4e0, 1e-5) AS cl, n.density AS dn, s.density AS ds, e.density AS de, w.density AS dw FROM ly a
        JOIN ly n ON n.layer = a.layer AND n.px = a.px AND n.py = GREATEST(0, a.py - 6) JOIN ly s ON s.layer = a.layer AND s.px = a.px AND s.py = LEAST(63, a.py + 6)
        JOIN ly e ON e.layer = a.layer AND e.py = a.py AND e.px = LEAST(63, a.px + 6) JOIN ly w ON w.layer = a.layer AND w.py = a.py AND w.px = GREATEST(0, a.px - 6)),
    sp AS (SELECT *, LEAST(dn, ds, de, dw) AS lo, (dn + ds + de + dw) * 0.25e0 AS mn FROM tp),
    al AS (SELECT *, CASE WHEN al > 0.01e0 THEN 1e0 WHEN sdf > 0.3e0 THEN 0e0 ELSE (0.7e0 + 0.29e0 * cl) * exp(-(sdf * sdf * (3000e0 + 6000e0 * cl))) * (0.7e0 + 0.3e0 * (0.3e0 + 0.7e0 * GREATEST(0e0, LEAST(1e0, GREATEST(density, lo + 0.6e0 * (mn - lo)) * 3e0)))) END AS x0 FROM sp),
    ax AS (SELECT *, CASE WHEN x0 < 0.005e0 THEN 0e0 ELSE x0 END AS x FROM al)"""


def _fold(c: str) -> str:
    v = "0e0"
    for k in range(3):
        v = f"({v} + (l{k}.{c} - {v}) * l{k}.x)" if c != "a" else f"(l{k}.x + {v} * (1e0 - l{k}.x))"
    return v


def _reconstruction_sql() -> str:
    """Two views from points to pixels, one over-relaxation step."""
    from . import depth as D
    from . import projection as V

    w, h, near, far = V.W, V.H, V.NEAR, V.FAR
    reach = int(max(2.0, w * 0.1))
    parts = [f"{V.sql_clip(name=f'clip{k}', eye=e)}" for k, e in V.EYES.items()]
    views = " UNION ALL ".join(f"SELECT {k} AS view, point_id, x / 6e0 AS r, y / 5e0 AS g, z / 5e0 AS b, {V.PIXEL}, cz / cw AS z, d FROM clip{k} WHERE {V.SEEN}" for k in V.EYES)
    sweep = ""
    table = "dense"
    for p in (1, 0):
        sweep += f", {_taps(table, f'sw{p}', 'view, layer, depth, px, py, al, r, g, b', 'view, layer, ', ('r', 'g', 'b'))}, st{p} AS (SELECT view, layer, depth, px, py, al, {', '.join(f'CASE WHEN al > 0 OR (px + py) % 2 <> {p} THEN {c} ELSE 1.9e0 * (0.25e0 * (((l{c} + r{c}) + d{c}) + u{c})) + (1e0 - 1.9e0) * {c} END AS {c}' for c in 'rgb')} FROM sw{p})"
        table = f"st{p}"
    keys = ("view", "layer")
    flood, flooded = _flood("dense", "view, layer", w, h)
    close = "(1e0 - (depth - d0) / GREATEST(d1 - d0, 1e-5))"
    support = "GREATEST(density, LEAST(dn, ds, de, dw) + 0.6e0 * ((((dn + ds) + de) + dw) * 0.25e0 - LEAST(dn, ds, de, dw)))"
    near_ = f"(0.7e0 + 0.29e0 * {close}) * exp(-(sdf * sdf * (3000e0 + 6000e0 * {close}))) * (0.7e0 + 0.3e0 * (0.3e0 + 0.7e0 * GREATEST(0e0, LEAST(1e0, {support} * 3e0))))"
    taps = {}
    for name, line, axis, step, edge in (("dn", "px", "py", "LAG", "FIRST"), ("ds", "px", "py", "LEAD", "LAST"), ("de", "py", "px", "LEAD", "LAST"), ("dw", "py", "px", "LAG", "FIRST")):
        over = f"PARTITION BY view, layer, {line} ORDER BY {axis}"
        taps[name] = f"COALESCE({step}(density, {reach}) OVER ({over}), {edge}_VALUE(density) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return f"""WITH RECURSIVE {POINTS}, {', '.join(parts)}, seen AS ({views}),
    ok AS (SELECT view, d FROM seen WHERE d > 0 AND NOT isnan(d) AND d BETWEEN {near}e0 AND {far}e0),
    rg AS (SELECT view, GREATEST({near}e0, MIN(d) * 0.95e0) AS n, LEAST({far}e0, MAX(d) * 1.05e0) AS f FROM ok GROUP BY view),
    hs AS (SELECT view, CAST(FLOOR((d - n) / (f - n) * 499) AS INT) AS i, COUNT(*) AS c FROM ok JOIN rg USING (view) GROUP BY 1, 2),
    hist AS (SELECT rg.view, CAST(range AS INT) AS i, COALESCE(c, 0) AS c, n, f FROM rg CROSS JOIN range(500) LEFT JOIN hs ON hs.view = rg.view AND hs.i = range),
    sm AS (SELECT view, i, n, f, CAST(SUM(c) OVER wd AS DOUBLE) / CAST(COUNT(*) OVER wd AS DOUBLE) AS a FROM hist WINDOW wd AS (PARTITION BY view ORDER BY i ROWS BETWEEN 8 PRECEDING AND 7 FOLLOWING)),
    lg AS (SELECT *, LAG(a) OVER (PARTITION BY view ORDER BY i) AS b, LEAD(a) OVER (PARTITION BY view ORDER BY i) AS e FROM sm),
    pk AS (SELECT view, n + CAST(i AS DOUBLE) / 500 * (f - n) AS depth FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY view ORDER BY a DESC, i) AS k FROM lg WHERE a > b AND a > e) s WHERE k <= 12),
    od AS (SELECT view, CAST(ROW_NUMBER() OVER wd - 1 AS INT) AS k, depth, LAG(depth) OVER wd AS p, LEAD(depth) OVER wd AS q FROM pk WINDOW wd AS (PARTITION BY view ORDER BY depth)),
    c0 AS (SELECT view, k, CASE WHEN p IS NULL THEN {max(0.0, near * 0.5)}e0 ELSE (p + depth) / 2 END AS s, CASE WHEN q IS NULL THEN {far * 1.5}e0 ELSE (depth + q) / 2 END AS e FROM od),
    rc(view, k, s, e, ps, pe) AS (SELECT view, k, s, e, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM c0 WHERE k = 0
        UNION ALL SELECT c.view, c.k, (r.e + c.s) / 2 - LEAST(c.e - c.s, r.e - r.s) * 0.1e0, c.e, r.s, (r.e + c.s) / 2 + LEAST(c.e - c.s, r.e - r.s) * 0.1e0 FROM rc r JOIN c0 c ON c.view = r.view AND c.k = r.k + 1),
    bins AS MATERIALIZED (SELECT r.view, r.k AS bin_id, r.s AS s, COALESCE(nx.pe, r.e) AS e FROM rc r LEFT JOIN rc nx ON nx.view = r.view AND nx.k = r.k + 1),
    span AS (SELECT view, MIN((s + e) / 2) AS d0, MAX((s + e) / 2) AS d1 FROM bins GROUP BY view),
    zb AS MATERIALIZED (SELECT * FROM (SELECT s.view, -bin_id AS layer, (bins.s + bins.e) / 2 AS depth, px, py, r, g, b, ROW_NUMBER() OVER (PARTITION BY s.view, bin_id, px, py ORDER BY z, point_id) AS k FROM seen s JOIN bins ON bins.view = s.view AND d BETWEEN bins.s AND bins.e) q WHERE k = 1),
    lay AS (SELECT DISTINCT view, layer, depth FROM zb),
    dense AS MATERIALIZED (SELECT lay.view, lay.layer, lay.depth, CAST(gx.range AS INT) AS px, CAST(gy.range AS INT) AS py, CASE WHEN zb.k IS NULL THEN 0e0 ELSE 1e0 END AS al, COALESCE(zb.r, 0e0) AS r, COALESCE(zb.g, 0e0) AS g, COALESCE(zb.b, 0e0) AS b
        FROM lay CROSS JOIN range({w}) gx CROSS JOIN range({h}) gy LEFT JOIN zb ON zb.view = lay.view AND zb.layer = lay.layer AND zb.px = gx.range AND zb.py = gy.range){sweep}{flood},
    fd2 AS MATERIALIZED (SELECT view, layer, px, py, dist AS sdf FROM {flooded}), {_blur('fd2', 'fx', 'sdf', 4, 2.0, 'px', keys, w)}, {_blur('fx', 'fy', 'sdf', 4, 2.0, 'py', keys, h)},
    dn0 AS (SELECT view, layer, px, py, al AS density FROM dense), {_blur('dn0', 'dn1', 'density', 30, 15.0, 'px', keys, w)}, {_blur('dn1', 'dn2x', 'density', 30, 15.0, 'py', keys, h)}, dn2 AS (SELECT * FROM dn2x),
    tp AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {k}' for k, e in taps.items())} FROM dn2),
    full_ AS MATERIALIZED (SELECT t.*, fy.sdf, tp.density, dn, ds, de, dw, d0, d1 FROM {table} t JOIN fy USING (view, layer, px, py) JOIN tp USING (view, layer, px, py) JOIN span USING (view)),
    ax AS (SELECT *, CASE WHEN al > 0.01e0 THEN 1e0 WHEN sdf > 0.3e0 THEN 0e0 ELSE {near_} END AS alpha FROM full_),
    vis AS (SELECT view, layer, px, py, r, g, b, CASE WHEN alpha < 0.005e0 THEN 0e0 ELSE alpha END AS alpha, ROW_NUMBER() OVER (PARTITION BY view, px, py ORDER BY layer) AS k FROM ax),
    acc AS (SELECT view, px, py, k, r * alpha AS r, g * alpha AS g, b * alpha AS b, alpha AS a FROM vis WHERE k = 1
        UNION ALL SELECT v.view, v.px, v.py, v.k, c.r + (v.r - c.r) * v.alpha, c.g + (v.g - c.g) * v.alpha, c.b + (v.b - c.b) * v.alpha, v.alpha + c.a * (1e0 - v.alpha) FROM acc c JOIN vis v ON v.view = c.view AND v.px = c.px AND v.py = c.py AND v.k = c.k + 1)
    SELECT view, px, py, {micro('r')} AS r, {micro('g')} AS g, {micro('b')} AS b, {micro('a')} AS a FROM (SELECT *, MAX(k) OVER (PARTITION BY view, px, py) AS top FROM acc) s WHERE k = top"""


def _errors_sql() -> str:
    true = "(px + 2 * py) * 1.25e0"
    base = f"{RASTER}, hole AS MATERIALIZED (SELECT px, py, al, CASE WHEN al > 0 THEN {true} ELSE 0e0 END AS v FROM raster)"
    parts = [(m, *f) for m, f in (("jacobi", _jacobi("hole", 2)), ("sor", _sweeps("hole", 2)), ("two_grid", _two_grid("hole")))]
    scores = " UNION ALL ".join(f"SELECT '{m}' AS method, AVG(({true} - v) ** 2) AS mse FROM {t}" for m, _, t in parts)
    return f"WITH {base}{''.join(q for _, q, _ in parts)}, e AS ({scores}) SELECT method, {micro('mse')} AS mse, {micro('10 * log10(255e0 * 255e0 / mse)')} AS psnr FROM e"


def _solved_sql(made: tuple[str, str], select: str = "v") -> str:
    return f"WITH {RASTER}{made[0]} SELECT px, py, {select} AS v FROM {made[1]}"


ORACLE_SQL = {
    "image_resampled": f"""WITH {RASTER}, cw AS ({_sinc(SIDE, 96)}), rw AS ({_sinc(SIDE, 40)})
        SELECT CAST(cw.new AS INT) AS px, CAST(rw.new AS INT) AS py, {micro('SUM(cw.w * rw.w * v)')} AS v, {micro('SUM(cw.w * rw.w * al)')} AS al FROM raster JOIN cw ON cw.old = px JOIN rw ON rw.old = py GROUP BY cw.new, rw.new""",
    "image_stretched": f"""WITH {RASTER}, g AS (SELECT CAST(a.range AS INT) AS px, CAST(b.range AS INT) AS py, GREATEST(0e0, LEAST(63e0, (a.range + 0.5e0) * {64 / 96!r}e0 - 0.5e0)) AS x, GREATEST(0e0, LEAST(63e0, (b.range + 0.5e0) * {64 / 40!r}e0 - 0.5e0)) AS y FROM range(96) a, range(40) b),
        t AS (SELECT px, py, LEAST(FLOOR(x) + i.range, 63) AS sx, LEAST(FLOOR(y) + j.range, 63) AS sy, (CASE i.range WHEN 0 THEN 1 - (x - FLOOR(x)) ELSE x - FLOOR(x) END) * (CASE j.range WHEN 0 THEN 1 - (y - FLOOR(y)) ELSE y - FLOOR(y) END) AS w FROM g, range(2) i, range(2) j)
        SELECT t.px, t.py, {micro('SUM(w * r.v)')} AS v, {micro('SUM(w * r.al)')} AS al FROM t JOIN raster r ON r.px = t.sx AND r.py = t.sy GROUP BY t.px, t.py""",
    "jacobi_step": f"WITH {_STEP} SELECT px, py, v FROM j",
    "jacobi_two_steps": f"WITH {_STEP}, {_taps('j', 't2')} SELECT px, py, CASE WHEN al > 0 THEN v ELSE 0.25e0 * (((l + r) + d) + u) END AS v FROM t2",
    "sor_two_steps": _solved_sql(_sweeps("raster", 2)),
    "two_grid": _solved_sql(_two_grid("raster"), micro("v")),
    "conjugate_gradient": _solved_sql(_gradients("raster"), micro("v")),
    "jump_flood_distance": (lambda made: f"WITH {RASTER}{made[0]} SELECT px, py, {micro('dist')} AS dist FROM {made[1]}")(_flood("raster", "", SIDE, SIDE)),
    "fill_quality_few_steps": _errors_sql(),
    "reconstructed_one_step": _reconstruction_sql(),
    "restrict_boundary": f"WITH {_HALF} SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, 0e0 AS v, al FROM half",
    "byte_values": f"WITH {RASTER} SELECT px, py, CAST(FLOOR(LEAST(GREATEST((v * 3e0 - 0.25e0) * 255e0, 0e0), 255e0)) AS INT) AS v FROM raster",
    "alpha_levels": f"WITH {RASTER} SELECT CAST(p.percent AS INT) AS percent, px, py, CASE WHEN ((CAST(px AS BIGINT) * 73856093 + CAST(py AS BIGINT) * 19349663) % 2147483648 * 2654435761 % 4294967296) / 4294967296e0 > p.percent / 100e0 THEN al ELSE 0e0 END AS a FROM raster, (VALUES (50), (80), (90), (95), (99)) p(percent)",
    "background": f"""WITH {RASTER}, g AS (SELECT CAST(a.range AS INT) AS px, CAST(b.range AS INT) AS py, GREATEST(0e0, LEAST(63e0, (a.range + 0.5e0) * {64 / 80!r}e0 - 0.5e0)) AS x, GREATEST(0e0, LEAST(63e0, (b.range + 0.5e0) * {64 / 40!r}e0 - 0.5e0)) AS y FROM range(80) a, range(40) b),
        t AS (SELECT px, py, LEAST(FLOOR(x) + i.range, 63) AS sx, LEAST(FLOOR(y) + j.range, 63) AS sy, (CASE i.range WHEN 0 THEN 1 - (x - FLOOR(x)) ELSE x - FLOOR(x) END) * (CASE j.range WHEN 0 THEN 1 - (y - FLOOR(y)) ELSE y - FLOOR(y) END) AS w FROM g, range(2) i, range(2) j)
        SELECT 'image' AS kind, t.px, t.py, {micro('SUM(w * r.py * 0.0139e0)')} AS r, {micro('SUM(w * r.px * 0.0137e0)')} AS g, {micro('SUM(w * r.v)')} AS b, {micro('SUM(w)')} AS a FROM t JOIN raster r ON r.px = t.sx AND r.py = t.sy GROUP BY t.px, t.py
        UNION ALL SELECT 'plain', CAST(a.range AS INT), CAST(b.range AS INT), 250000, 250000, 250000, 1000000 FROM range(80) a, range(40) b""",
    "laplacian": f"WITH {_LAP} SELECT px, py, v FROM lap",
    "residual": f"WITH {_LAP} SELECT px, py, CASE WHEN al > 0 THEN 0e0 ELSE (px * 0.5e0 + py) - v END AS v FROM lap",
    "restrict": f"WITH {_HALF} SELECT CAST(px AS INT) AS px, CAST(py AS INT) AS py, v, al FROM half",
    "prolong": f"WITH {_FINE} SELECT px, py, {micro('v')} AS v FROM fine",
    "correct": f"WITH {_FINE} SELECT px, py, {micro('v0 + v')} AS v FROM fine",
    "blur_rows": f"WITH {RASTER}, {_blur('raster', 'h', 'v', 4, 2.0, 'px')} SELECT px, py, {micro('v')} AS v FROM h",
    "blur_density": f"WITH {RASTER}, {_blur('raster', 'h', 'al', 30, 15.0, 'px')}, {_blur('h', 'g', 'al', 30, 15.0, 'py')} SELECT px, py, {micro('al')} AS al FROM g",
    "axpy": f"WITH {RASTER} SELECT px, py, v + 0.5e0 * al AS v FROM raster",
    "channel_products": f"WITH {RASTER} SELECT px, py, v * al AS r, al * (px / 64e0) AS g, (px / 64e0) * v AS b, py / 64e0 AS a FROM raster",
    "channel_dots": f"WITH {RASTER} SELECT {micro('SUM(v * al)')} AS r, {micro('SUM(al * (px / 64e0))')} AS g, {micro('SUM((px / 64e0) * v)')} AS b, {micro('SUM(py / 64e0)')} AS a FROM raster",
    "dot_product": f"WITH {RASTER} SELECT {micro('SUM(v * v)')} AS dot FROM raster",
    "image_psnr": f"""WITH {_STEP}, e AS (SELECT {' + '.join(f'(FLOOR(a.v * {k}e0) - FLOOR(b.v * {k}e0)) ** 2' for k in (100.0, 80.0, 60.0, 40.0))} AS s FROM raster a JOIN j b USING (px, py)), m AS (SELECT AVG(s / 4) AS mse FROM e)
        SELECT {micro('mse')} AS mse, {micro('10 * log10(255e0 * 255e0 / mse)')} AS psnr FROM m""",
    "image_stats": f"WITH {RASTER} SELECT MIN(v) AS low, MAX(v) AS high, COUNT(*) FILTER (WHERE v <> 0) AS non_zero FROM raster",
    "distance_field": f"WITH {RASTER} SELECT a.px, a.py, {micro(f'MIN(sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py))) / sqrt({2 * SIDE * SIDE}e0)')} AS dist FROM raster a, raster b WHERE b.al > 0 GROUP BY a.px, a.py",
    "composite": f"WITH {_LAYERS} SELECT l0.px, l0.py, {', '.join(f'{micro(_fold(c))} AS {c}' for c in 'rgba')} FROM ax l0 JOIN ax l1 ON l1.px = l0.px AND l1.py = l0.py AND l1.layer = 1 JOIN ax l2 ON l2.px = l0.px AND l2.py = l0.py AND l2.layer = 2 WHERE l0.layer = 0",
    "alpha_over": f"WITH {RASTER}, t AS (SELECT px, py, px / 64e0 AS r, py / 64e0 AS g, v AS b, al * 0.5e0 AS a, v FROM raster) SELECT px, py, {micro('r * a + v * (1e0 - a)')} AS r, {micro('g * a + v * (1e0 - a)')} AS g, {micro('b * a + 0.25e0 * (1e0 - a)')} AS b, {micro('a + 1e0 * (1e0 - a)')} AS a FROM t",
}
