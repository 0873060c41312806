"""Rasters as rows (view, px, py, v, al): stencils, multigrid transfers, blurs, image metrics and compositing.

One step of a stencil is a window over rows and columns, which partitions by
raster line.  Solvers that need thousands of steps run as numpy kernels, one group
for each (view, layer): a raster of 1024 x 512 has a few megabytes, whatever the
number of views, so the kernels' memory is bounded and views run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _along(axis: str, by: tuple[str, ...] = ()) -> WindowSpec:
    """A raster line, in order; ``by`` names the keys of several rasters."""
    return Window.partitionBy(*by, "py" if axis == "px" else "px").orderBy(axis)


def neighbours(raster: DataFrame, value: str = "v") -> DataFrame:
    """Adds l, r, d, u: the four neighbours' values, the pixel's own at the edges."""
    own = F.col(value)
    return raster.withColumns({n: F.coalesce(f(value).over(_along(axis)), own) for n, f, axis in (("l", F.lag, "px"), ("r", F.lead, "px"), ("d", F.lag, "py"), ("u", F.lead, "py"))})


def _around() -> Column:
    return ((F.col("l") + F.col("r")) + F.col("d")) + F.col("u")


def jacobi_step(raster: DataFrame) -> DataFrame:
    """One Jacobi step: the mean of the neighbours where nothing was captured (al = 0)."""
    return neighbours(raster).select("px", "py", F.when(F.col("al") > 0, F.col("v")).otherwise(0.25 * _around()).alias("v"))


def laplacian(raster: DataFrame, width: int, height: int) -> DataFrame:
    """The five-point Laplacian with h = 1 / (larger side - 1), 0 where captured."""
    h = 1.0 / (max(width, height) - 1)
    return neighbours(raster).select("px", "py", F.when(F.col("al") > 0, 0.0).otherwise((_around() - 4.0 * F.col("v")) / (h * h)).alias("v"))


def residual(raster: DataFrame, source: DataFrame, width: int, height: int) -> DataFrame:
    """source - Laplacian, 0 where captured; source is (px, py, f)."""
    lap = laplacian(raster, width, height).withColumnRenamed("v", "lap")
    joined = raster.select("px", "py", "al").join(lap, ["px", "py"]).join(source, ["px", "py"])
    return joined.select("px", "py", F.when(F.col("al") > 0, 0.0).otherwise(F.col("f") - F.col("lap")).alias("v"))


def restricted(raster: DataFrame) -> DataFrame:
    """Half the size: the mean of 2 x 2 pixels, as bilinear sampling at the coarse centre gives for even sizes."""
    half = [F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("px", "py")]
    return raster.groupBy(*half).agg(*((F.sum(c) / 4.0).alias(c) for c in ("v", "al")))


def restricted_boundary(raster: DataFrame) -> DataFrame:
    """The restriction that keeps alpha only."""
    return restricted(raster).select("px", "py", F.lit(0.0).alias("v"), "al")


def prolonged(coarse: DataFrame, width: int, height: int) -> DataFrame:
    """Twice the size: bilinear between coarse centres, clamped at the edges; width and height are the coarse ones.

    Each fine pixel takes 9/16, 3/16, 3/16 and 1/16 of its four nearest coarse pixels.
    """
    taps = F.array(*[F.struct(F.lit(sx).alias("sx"), F.lit(sy).alias("sy"), F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), F.lit((0.75 if ox == 0 else 0.25) * (0.75 if oy == 0 else 0.25)).alias("w")) for sx in (0, 1) for sy in (0, 1) for ox in (0, 1) for oy in (0, 1)])
    fine = F.explode(taps)
    # a tap with o = 1 comes from the neighbour on the fine pixel's side; seen from the coarse pixel, it goes to the neighbour's child
    spread = coarse.select("px", "py", "v", fine.alias("t"))
    side = {c: F.when(F.col(f"t.s{c}") == 1, 1).otherwise(-1) for c in "xy"}
    to = {c: F.col(f"p{c}") - F.col(f"t.o{c}") * side[c] for c in "xy"}
    edge = []
    for c, size in (("x", width), ("y", height)):
        edge.append(to[c].between(0, size - 1))
    moved = spread.where(edge[0] & edge[1]).select((to["x"] * 2 + F.col("t.sx")).alias("px"), (to["y"] * 2 + F.col("t.sy")).alias("py"), (F.col("v") * F.col("t.w")).alias("c"), F.col("t.w").alias("w"))
    return moved.groupBy("px", "py").agg((F.sum("c") / F.sum("w")).alias("v"))


def corrected(raster: DataFrame, coarse: DataFrame, width: int, height: int) -> DataFrame:
    """raster + the prolonged coarse correction."""
    fine = prolonged(coarse, width, height).withColumnRenamed("v", "c")
    return raster.join(fine, ["px", "py"]).select("px", "py", (F.col("v") + F.col("c")).alias("v"), "al")


def axpy(a: DataFrame, b: DataFrame, k: float) -> DataFrame:
    """a + k b by pixel."""
    return a.select("px", "py", "v").join(b.select("px", "py", F.col("v").alias("w")), ["px", "py"]).select("px", "py", (F.col("v") + k * F.col("w")).alias("v"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the sum of products by pixel."""
    return a.select("px", "py", "v").join(b.select("px", "py", F.col("v").alias("w")), ["px", "py"]).agg(F.sum(F.col("v") * F.col("w")).alias("dot"))


def products(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """(px, py, channels): products by pixel and channel; a pixel that one of the rasters lacks has none."""
    both = a.select("px", "py", *channels).join(b.select("px", "py", *(F.col(c).alias(f"{c}_") for c in channels)), ["px", "py"])
    return both.select("px", "py", *((F.col(c) * F.col(f"{c}_")).alias(c) for c in channels))


def dots(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """One row: the sum of products of each channel."""
    return products(a, b, channels).agg(*(F.sum(c).alias(c) for c in channels))


def kernel_weights(radius: int, sigma: float) -> list[float]:
    return [float(np.exp(-(k * k) / (2 * sigma * sigma))) for k in range(-radius, radius + 1)]


def blurred(raster: DataFrame, radius: int, sigma: float, axis: str = "px", value: str = "v", by: tuple[str, ...] = ()) -> DataFrame:
    """A normalised Gaussian along one axis, the edge pixel repeated beyond the edge; one window over the line."""
    w = _along(axis, by)
    line = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = kernel_weights(radius, sigma)
    total = sum(weights)
    first, last, own = F.first(value).over(line), F.last(value).over(line), F.col(value)
    out = F.lit(0.0)
    for k, x in zip(range(-radius, radius + 1), weights):
        tap = own if k == 0 else F.coalesce(F.lag(value, -k).over(w), first) if k < 0 else F.coalesce(F.lead(value, k).over(w), last)
        out = out + tap * x
    return raster.withColumn(value, out / total)


def psnr(a: DataFrame, b: DataFrame, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """One row: mse over all pixels and channels of 0 to 255 and psnr in dB, infinite for equal images."""
    both = a.select("px", "py", *channels).join(b.select("px", "py", *(F.col(c).alias(f"{c}_") for c in channels)), ["px", "py"])
    error = sum(((F.col(c) - F.col(f"{c}_")) * (F.col(c) - F.col(f"{c}_")) for c in channels), F.lit(0.0)) / len(channels)
    return both.agg(F.avg(error).alias("mse")).withColumn("psnr", F.when(F.col("mse") == 0, float("inf")).otherwise(10 * F.log10(255.0 * 255.0 / F.when(F.col("mse") > 0, F.col("mse")))))


def image_stats(raster: DataFrame, value: str = "v") -> DataFrame:
    return raster.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(F.col(value) != 0).alias("non_zero"))


def to_bytes(c: Column) -> Column:
    """0 to 1 as a whole 0 to 255, clamped and cut."""
    return F.floor(F.least(F.greatest(c * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int")


def exact_distance(raster: DataFrame, width: int, height: int) -> DataFrame:
    """(px, py, dist): distance to the nearest captured pixel over the diagonal; the diagonal where there is none.

    Separable and exact: per column the nearest seed above and below by windows,
    then per row the least over its columns, a join within the row only.
    """
    diagonal = float(np.hypot(width, height))
    up, down = _along("py").rowsBetween(Window.unboundedPreceding, 0), _along("py").rowsBetween(0, Window.unboundedFollowing)
    seed = F.when(F.col("al") > 0, F.col("py"))
    gap = F.least(F.col("py") - F.last(seed, True).over(up), F.first(seed, True).over(down) - F.col("py"))
    near = raster.select("px", "py", gap.alias("g"))
    columns = near.where("g IS NOT NULL").groupBy("py").agg(F.collect_list(F.struct("px", "g")).alias("s"))  # as many as a line has pixels
    best = F.aggregate("s", F.lit(float("inf")), lambda m, e: F.least(m, ((F.col("px") - e["px"]) * (F.col("px") - e["px"]) + e["g"] * e["g"]).cast("double")))
    return near.join(columns, "py", "left").select("px", "py", F.when(F.col("s").isNull(), diagonal).otherwise(F.sqrt(best) / diagonal).alias("dist"))


def composited(layers: DataFrame, width: int, height: int, by: tuple[str, ...] = (), span: DataFrame | None = None) -> DataFrame:
    """(by, px, py, r, g, b, a): layers (by, layer, depth, px, py, r, g, b, sdf, density, al) over each other, in layer order (far first).

    A captured pixel is opaque; one far from any (distance above 0.3) is clear;
    else alpha falls with the distance, the sharper the closer the layer, and rises
    with the density here and in four directions.  ``by`` names the keys of several
    views; ``span`` (by, d0, d1) is the depths' range, of the layers' own unless
    given.  A pixel on which no layer shows is 0 in every channel.
    """
    if span is None:
        ends = [F.min("depth").alias("d0"), F.max("depth").alias("d1")]
        span = layers.groupBy(*by).agg(*ends) if by else layers.agg(*ends)
    span = F.broadcast(span)  # one row for each view
    reach = int(max(2.0, width * 0.1))
    base = layers.join(span, list(by)) if by else layers.crossJoin(span)
    base = base.withColumn("close", 1.0 - (F.col("depth") - F.col("d0")) / F.greatest(F.col("d1") - F.col("d0"), F.lit(1e-5)))
    taps = {}
    for name, axis, k in (("dn", "py", -reach), ("ds", "py", reach), ("de", "px", reach), ("dw", "px", -reach)):
        w = Window.partitionBy(*by, "layer", "px" if axis == "py" else "py").orderBy(axis)
        line = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        taps[name] = F.coalesce(F.lag("density", -k).over(w), F.first("density").over(line)) if k < 0 else F.coalesce(F.lead("density", k).over(w), F.last("density").over(line))
    t = base.withColumns(taps)
    four = [F.col(c) for c in ("dn", "ds", "de", "dw")]
    low, mean = F.least(*four), (four[0] + four[1] + four[2] + four[3]) * 0.25
    support = F.greatest(F.col("density"), low + 0.6 * (mean - low))
    modulator = 0.3 + 0.7 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), support * 3.0))
    near = (0.7 + 0.29 * F.col("close")) * F.exp(-(F.col("sdf") * F.col("sdf") * (3000.0 + 6000.0 * F.col("close")))) * (0.7 + 0.3 * modulator)
    alpha = F.when(F.col("al") > 0.01, 1.0).when(F.col("sdf") > 0.3, 0.0).otherwise(near)
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))
    shown = F.when(F.col("alpha") >= 0.005, F.struct("layer", "r", "g", "b", "alpha"))
    stack = F.sort_array(F.collect_list(shown))  # a dozen layers

    def over(below: Column, f: Column) -> Column:
        x = f["alpha"]
        return F.struct(*((below[c] + (f[c] - below[c]) * x).alias(c) for c in "rgb"), (x + below["a"] * (1.0 - x)).alias("a"))

    done = t.withColumn("alpha", alpha).groupBy(*by, "px", "py").agg(F.aggregate(stack, zero, over).alias("p"))
    return done.select(*by, "px", "py", *(F.col(f"p.{c}").alias(c) for c in "rgba"))


def alpha_over(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """top (r, g, b, a) over bottom by pixel."""
    both = top.join(bottom.select("px", "py", *(F.col(c).alias(f"{c}_") for c in "rgba")), ["px", "py"])
    return both.select("px", "py", *((F.col(c) * F.col("a") + F.col(f"{c}_") * (1.0 - F.col("a"))).alias(c) for c in "rgb"), (F.col("a") + F.col("a_") * (1.0 - F.col("a"))).alias("a"))


# ---- kernels: one raster of a (view, layer) at a time, or a stack of channels over one mask ---------


def dense(pdf: pd.DataFrame, column: str) -> np.ndarray:
    out = np.zeros((int(pdf.py.max()) + 1, int(pdf.px.max()) + 1))
    out[pdf.py.to_numpy(), pdf.px.to_numpy()] = pdf[column].to_numpy()
    return out


def mean4(v: np.ndarray) -> np.ndarray:
    """The mean of the four neighbours, the pixel's own value beyond the edges; the last two axes are rows and columns."""
    p = np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    return 0.25 * (((p[..., 1:-1, :-2] + p[..., 1:-1, 2:]) + p[..., :-2, 1:-1]) + p[..., 2:, 1:-1])


def sor(v: np.ndarray, al: np.ndarray, steps: int, omega: float = 1.9, first: int = 1) -> np.ndarray:
    """Red-black over-relaxation: pixels with odd x + y (even ones, if ``first`` is 0), then the others; captured pixels stay.

    A step works on strided views of every other row and column.  It ends early
    where a step leaves every bit as it was, as all further ones would.
    """
    h, w = al.shape
    free = al <= 0
    p = np.pad(v.reshape(-1, h, w), [(0, 0), (1, 1), (1, 1)], mode="edge")
    halves = []
    for parity in (1, 0):
        for r in (0, 1):
            c = (parity - r) % 2
            rows, cols = slice(1 + r, h + 1, 2), slice(1 + c, w + 1, 2)
            taps = p[:, rows, c:w:2], p[:, rows, 2 + c : w + 2 : 2], p[:, r:h:2, cols], p[:, 2 + r : h + 2 : 2, cols]
            halves.append((parity, p[:, rows, cols], taps, free[r::2, c::2]))
    for k in range(steps):
        before = p.copy() if k % 64 == 63 else None
        for parity in (first, 1 - first):
            p[:, 0, :], p[:, -1, :], p[:, :, 0], p[:, :, -1] = p[:, 1, :], p[:, -2, :], p[:, :, 1], p[:, :, -2]
            for own, at, (left, right, down, up), open_ in halves:
                if own == parity:
                    np.copyto(at, omega * (0.25 * (((left + right) + down) + up)) + (1.0 - omega) * at, where=open_)
        if before is not None and (before[:, 1:-1, 1:-1] == p[:, 1:-1, 1:-1]).all():
            break
    return p[:, 1:-1, 1:-1].reshape(v.shape).copy()


def jacobi(v: np.ndarray, al: np.ndarray, steps: int) -> np.ndarray:
    for _ in range(steps):
        v = np.where(al > 0, v, mean4(v))
    return v


def v_cycle(v: np.ndarray, al: np.ndarray, f: np.ndarray, smooth: int = 20, solve: int = 10, least: int = 4, levels: int = 10) -> np.ndarray:
    """A multigrid cycle for Laplace(v) = f (in pixel units) on the pixels not captured, of so many levels at most."""
    v = relaxed(v, al, f, smooth)
    if coarser(*v.shape, least, levels):
        coarse, closed = halved(v, al, f)
        e = v_cycle(np.zeros_like(coarse), closed, coarse, smooth, solve, least, levels - 1)
        v = doubled(v, al, e)
    else:
        v = relaxed(v, al, f, solve)
    return relaxed(v, al, f, smooth)


def coarser(h: int, w: int, least: int, levels: int) -> bool:
    """Whether a multigrid cycle goes on to half the size."""
    return levels > 1 and min(h, w) >= 2 * least and h % 2 == 0 and w % 2 == 0


def relaxed(v: np.ndarray, al: np.ndarray, f: np.ndarray, steps: int) -> np.ndarray:
    """Damped Jacobi steps of Laplace(v) = f on the pixels not captured."""
    for _ in range(steps):
        v = np.where(al <= 0, 0.8 * (mean4(v) - 0.25 * f) + 0.2 * v, v)
    return v


def halved(v: np.ndarray, al: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of f, summed over 2 x 2 pixels, and where one of them is captured."""
    return summed_up(np.where(al <= 0, f - 4 * (mean4(v) - v), 0.0), al)


def summed_up(rest: np.ndarray, al: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of 2 x 2 pixels, and where one of them is captured."""
    h, w = rest.shape
    quarter = rest.reshape(h // 2, 2, w // 2, 2)
    coarse = ((quarter[:, 0, :, 0] + quarter[:, 0, :, 1]) + quarter[:, 1, :, 0]) + quarter[:, 1, :, 1]
    return coarse, al.reshape(h // 2, 2, w // 2, 2).max(axis=(1, 3))


def doubled(v: np.ndarray, al: np.ndarray, e: np.ndarray) -> np.ndarray:
    """v with a correction of half the size added to the pixels not captured."""
    return np.where(al <= 0, v + np.kron(e, np.ones((2, 2))), v)


def conjugate_gradient(v: np.ndarray, al: np.ndarray, steps: int) -> np.ndarray:
    """Solves Laplace(v) = 0 on the pixels not captured; all captured or none: v as it is."""
    free = al <= 0
    if free.all() or not free.any():
        return v

    def apply(u: np.ndarray) -> np.ndarray:
        return np.where(free, 4 * (u - mean4(u)), 0.0)

    r = -apply(v)
    p, rr = r.copy(), float((r * r).sum())
    for _ in range(steps):
        if rr < 1e-20:
            break
        q = apply(p)
        step = rr / float((p * q).sum())
        v = v + step * p
        r = r - step * q
        new = float((r * r).sum())
        p, rr = r + new / rr * p, new
    return v


def jump_flood(al: np.ndarray) -> np.ndarray:
    """Distance to the nearest captured pixel over the diagonal, by jump flooding (now and then a little too far); the diagonal without any.

    A pixel takes a neighbour's seed where that is nearer than its own, of equally
    near ones the first, row by row.
    """
    h, w = al.shape
    y, x = np.indices(al.shape)
    sx, sy = np.where(al > 0, x, -1), np.where(al > 0, y, -1)
    stride = 1 << (max(w, h).bit_length() - 1)
    while stride >= 1:
        near = []
        for oy, ox in AROUND:
            yy, xx = y + oy * stride, x + ox * stride
            inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
            near.append(tuple(np.where(inside, s[np.clip(yy, 0, h - 1), np.clip(xx, 0, w - 1)], -1) for s in (sx, sy)))
        sx, sy = nearer(sx, sy, near, x, y)
        stride //= 2
    return seed_distance(sx, sy, x, y, float(np.hypot(w, h)))


#: Steps to the eight neighbours, row by row.
AROUND = [(oy, ox) for oy in (-1, 0, 1) for ox in (-1, 0, 1) if ox or oy]


def nearer(sx: np.ndarray, sy: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each pixel's seed (-1: none) and its neighbours' the nearest one to its place, the first at ties."""
    away = lambda cx, cy: np.where(cx >= 0, (cx - x) ** 2.0 + (cy - y) ** 2.0, np.inf)
    best = away(sx, sy)
    for cx, cy in near:
        d = away(cx, cy)
        better = d < best
        sx, sy, best = np.where(better, cx, sx), np.where(better, cy, sy), np.where(better, d, best)
    return sx, sy


def seed_distance(sx: np.ndarray, sy: np.ndarray, x: np.ndarray, y: np.ndarray, diagonal: float) -> np.ndarray:
    """Distance to the seed over the diagonal; the diagonal without one."""
    return np.where(sx < 0, diagonal, np.sqrt((sx - x) ** 2.0 + (sy - y) ** 2.0) / diagonal)


def smoothed(v: np.ndarray, radius: int, sigma: float) -> np.ndarray:
    """The Gaussian of blurred() along rows, then columns."""
    weights = kernel_weights(radius, sigma)
    for axis in (1, 0):
        n, out = v.shape[axis], np.zeros_like(v)
        for k, x in zip(range(-radius, radius + 1), weights):
            out += x * np.take(v, np.clip(np.arange(n) + k, 0, n - 1), axis=axis)
        v = out / sum(weights)
    return v


#: Kernel of each method: (values, mask, steps) -> values.
METHODS = {
    "sor": sor,
    "jacobi": jacobi,
    "cg": conjugate_gradient,
    "jfa": lambda v, al, steps: jump_flood(al),
    "multigrid": lambda v, al, steps: v if not steps else METHODS["multigrid"](v_cycle(v, al, np.zeros_like(v)), al, steps - 1),
    "two_grid": lambda v, al, steps: v if not steps else METHODS["two_grid"](v_cycle(v, al, np.zeros_like(v), 2, 2, levels=2), al, steps - 1),
}


def solved(raster: DataFrame, method: str, steps: int, keys: tuple[str, ...] = ("view", "layer")) -> DataFrame:
    """(keys, px, py, v) after ``steps`` of a method on each raster (keys, px, py, v, al), which has every pixel; jfa gives the flooded distance.

    ValueError if there is no such method.
    """
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {sorted(METHODS)}")
    kernel = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = kernel(dense(pdf, "v"), dense(pdf, "al"), steps)
        pdf = pdf[[*keys, "px", "py"]].copy()
        pdf["v"] = out[pdf.py.to_numpy(), pdf.px.to_numpy()]
        return pdf

    kinds = ", ".join(f"{k} {dict(raster.dtypes)[k]}" for k in keys)
    return raster.groupBy(*keys).applyInPandas(run, f"{kinds}, px int, py int, v double")
