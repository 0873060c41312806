"""Solvers for rasters larger than a task: tiles with halo exchange.

A raster is cut into square tiles.  What travels are pieces: rectangles of some
planes, addressed to each tile whose window, the tile and a halo around it, they
overlap.  A round gathers a tile's pieces into its window, runs a numpy kernel on it,
cuts what is still right (a stencil spoils one more ring of the halo in each step)
and sends that on as pieces for the next round: one shuffle by tile.  A halo of so
many pixels pays for as many steps, so there are far fewer rounds than steps, and
each pixel is worked out by the same operations in the same order as on the whole
raster: results are equal bit for bit but for sums over all pixels.

A task holds one window, and rounds of many rasters, told apart by keys, run together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster as R
from .tables import Tables

#: Side of a tile, and the widest halo that pays for several steps of a stencil.
TILE, HALO = 256, 64
#: Rounds after which the pieces are written, which cuts their lineage.
ROUNDS = 8

Kernel = Callable[["Window"], np.ndarray]


@dataclass
class Window:
    """A tile and what is known around it: planes over rows y0 .. and columns x0 .. of the raster."""

    planes: np.ndarray
    y0: int
    x0: int
    own: tuple[slice, slice]
    extra: dict[int, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def cut(self, planes: np.ndarray) -> np.ndarray:
        """The tile's own part of planes over the window."""
        return planes[(..., *self.own)]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of the window's pixels in the raster."""
        y, x = np.indices(self.planes.shape[1:])
        return y + self.y0, x + self.x0


@dataclass(frozen=True)
class Grid:
    """Rasters of one size cut into tiles, and the columns that tell them apart."""

    width: int
    height: int
    tile: int
    keys: tuple[str, ...]
    kinds: str

    def schema(self) -> str:
        return f"{self.kinds}, ty int, tx int, kind int, y0 int, x0 int, h int, w int, planes binary"

    def span(self, at: int, halo: int, size: int) -> tuple[int, int]:
        return max(0, at * self.tile - halo), min(size, (at + 1) * self.tile + halo)

    def pieces(self, planes: np.ndarray, y0: int, x0: int, halo: int, kind: int = 0) -> Iterator[tuple]:
        """(ty, tx, kind, y0, x0, h, w, planes) for every tile whose window the rectangle overlaps."""
        h, w = planes.shape[1:]
        reach = lambda a, n, most: range(max(0, (a - halo) // self.tile), min((a + n - 1 + halo) // self.tile, (most - 1) // self.tile) + 1)
        for ty in reach(y0, h, self.height):
            low, high = self.span(ty, halo, self.height)
            rows = slice(max(low, y0), min(high, y0 + h))
            for tx in reach(x0, w, self.width):
                low, high = self.span(tx, halo, self.width)
                cols = slice(max(low, x0), min(high, x0 + w))
                if rows.stop > rows.start and cols.stop > cols.start:
                    part = planes[:, rows.start - y0 : rows.stop - y0, cols.start - x0 : cols.stop - x0]
                    yield ty, tx, kind, rows.start, cols.start, *part.shape[1:], np.ascontiguousarray(part).tobytes()

    def window(self, pdf: pd.DataFrame, halo: int) -> Window:
        """The window of the tile that a group's pieces are for; pieces of other kinds than 0 are kept apart."""
        ty, tx = int(pdf.ty.iloc[0]), int(pdf.tx.iloc[0])
        (top, bottom), (left, right) = self.span(ty, halo, self.height), self.span(tx, halo, self.width)
        own = slice(ty * self.tile - top, min(self.height, (ty + 1) * self.tile) - top), slice(tx * self.tile - left, min(self.width, (tx + 1) * self.tile) - left)
        planes, extra = None, {}
        for kind, y0, x0, h, w, raw in pdf[["kind", "y0", "x0", "h", "w", "planes"]].itertuples(index=False):
            part = np.frombuffer(raw).reshape(-1, h, w)
            if kind:
                extra.setdefault(kind, []).append((y0, x0, part))
                continue
            planes = np.zeros((len(part), bottom - top, right - left)) if planes is None else planes
            planes[:, y0 - top : y0 - top + h, x0 - left : x0 - left + w] = part
        return Window(planes, top, left, own, extra)


def _group(pdf: pd.DataFrame, grid: Grid, rows: Iterator[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=["ty", "tx", "kind", "y0", "x0", "h", "w", "planes"])
    for k in reversed(grid.keys):
        out.insert(0, k, pdf[k].iloc[0])
    return out


def tiled(raster: DataFrame, columns: tuple[str, ...], grid: Grid, halo: int) -> DataFrame:
    """Pieces of a raster's pixels (keys, px, py, columns); pixels without a row are 0."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.py.iloc[0]) // grid.tile * grid.tile, int(pdf.px.iloc[0]) // grid.tile * grid.tile
        planes = np.zeros((len(columns), min(grid.tile, grid.height - y0), min(grid.tile, grid.width - x0)))
        for plane, c in zip(planes, columns):
            plane[pdf.py.to_numpy() - y0, pdf.px.to_numpy() - x0] = pdf[c].to_numpy(float, na_value=0.0)
        return _group(pdf, grid, grid.pieces(planes, y0, x0, halo))

    tiles = [F.floor(F.col(c) / grid.tile).alias(f"__{c}") for c in ("py", "px")]
    return raster.select(*grid.keys, "px", "py", *columns).groupBy(*grid.keys, *tiles).applyInPandas(cut, grid.schema())


def round_(pieces: DataFrame, grid: Grid, halo: int, kernel: Kernel, after: int) -> DataFrame:
    """One round: ``kernel`` gives a tile's new planes from its window; they are sent on with the halo of the next round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        window = grid.window(pdf, halo)
        return _group(pdf, grid, grid.pieces(kernel(window), window.y0 + window.own[0].start, window.x0 + window.own[1].start, after))

    return pieces.groupBy(*grid.keys, "ty", "tx").applyInPandas(run, grid.schema())


def pixels(pieces: DataFrame, grid: Grid, plane: int = 0) -> DataFrame:
    """(keys, px, py, v) of pieces without a halo."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(len(pdf)):
                r = pdf.iloc[k]
                v = np.frombuffer(r.planes).reshape(-1, r.h, r.w)[plane]
                y, x = np.indices(v.shape)
                yield pd.DataFrame({**{c: r[c] for c in grid.keys}, "px": (x + r.x0).ravel().astype(np.int32), "py": (y + r.y0).ravel().astype(np.int32), "v": v.ravel()})

    return pieces.where("kind = 0").mapInPandas(spread, f"{grid.kinds}, px int, py int, v double")


def _stepped(pieces: DataFrame, grid: Grid, tables: Tables, steps: int, rings: int, halo: int, kernel: Callable[[Window, int], np.ndarray], after: int = 0) -> DataFrame:
    """``steps`` steps that spoil so many rings each, as many in a round as the halo of the pieces pays for; what comes out has a halo of ``after``."""
    most, number = max(1, halo // rings), 0
    while steps > 0:
        now = min(steps, most)
        steps -= now
        pieces = round_(pieces, grid, halo, lambda w, now=now: kernel(w, now), halo if steps else after)
        number += 1
        if number % ROUNDS == 0:
            pieces = tables.cut("stepped", pieces)
    return pieces


def _halo(grid: Grid, steps: int, rings: int) -> int:
    return max(rings, min(steps * rings, HALO, grid.tile) // rings * rings)


def sor(pieces: Callable[[int], DataFrame], grid: Grid, tables: Tables, steps: int, omega: float = 1.9) -> DataFrame:
    """Red-black over-relaxation; pieces of (v, al), made for a halo."""

    def kernel(w: Window, now: int) -> np.ndarray:
        v, al = w.planes
        return w.cut(np.stack([R.sor(v, al, now, omega, first=(w.y0 + w.x0 + 1) % 2), al]))

    halo = _halo(grid, steps, 2)
    return _stepped(pieces(halo), grid, tables, steps, 2, halo, kernel)


def jacobi(pieces: Callable[[int], DataFrame], grid: Grid, tables: Tables, steps: int) -> DataFrame:
    def kernel(w: Window, now: int) -> np.ndarray:
        v, al = w.planes
        return w.cut(np.stack([R.jacobi(v, al, now), al]))

    halo = _halo(grid, steps, 1)
    return _stepped(pieces(halo), grid, tables, steps, 1, halo, kernel)


def jump_flood(pieces: Callable[[int], DataFrame], grid: Grid, tables: Tables) -> DataFrame:
    """Flooded distances; pieces of (al).  Strides of a tile and more exchange whole tiles, all shorter ones are done in one window of 3 x 3 tiles."""
    if grid.tile & (grid.tile - 1):
        raise ValueError("the side of a tile must be a power of two")
    stride = 1 << (max(grid.width, grid.height).bit_length() - 1)

    def sent(planes: np.ndarray, y0: int, x0: int, stride: int) -> Iterator[tuple]:
        if stride < grid.tile:
            yield from grid.pieces(planes, y0, x0, grid.tile)
            return
        by = stride // grid.tile
        rows, cols = -(-grid.height // grid.tile), -(-grid.width // grid.tile)
        yield y0 // grid.tile, x0 // grid.tile, 0, y0, x0, *planes.shape[1:], planes.tobytes()
        for k, (oy, ox) in enumerate(R.AROUND):
            ty, tx = y0 // grid.tile - oy * by, x0 // grid.tile - ox * by  # whose neighbour this tile is
            if 0 <= ty < rows and 0 <= tx < cols:
                yield ty, tx, k + 1, y0, x0, *planes.shape[1:], planes.tobytes()

    def seeds(w: Window) -> np.ndarray:
        y, x = w.places()
        return np.stack([np.where(w.planes[0] > 0, p, -1.0) for p in (x, y)])

    def long(w: Window) -> np.ndarray:
        y, x = w.places()
        near = []
        for k in range(len(R.AROUND)):
            other = np.full(w.planes.shape, -1.0)
            for _, _, part in w.extra.get(k + 1, ()):
                other[:, : part.shape[1], : part.shape[2]] = part[:, : other.shape[1], : other.shape[2]]
            near.append(tuple(other))
        return np.stack(R.nearer(*w.planes, near, x, y))

    def short(w: Window, stride: int) -> np.ndarray:
        y, x = w.places()
        sx, sy = w.planes
        h, wide = sx.shape
        while stride >= 1:
            near = []
            for oy, ox in R.AROUND:
                moved = np.full((2, h, wide), -1.0)
                to = slice(max(0, -oy * stride), min(h, h - oy * stride)), slice(max(0, -ox * stride), min(wide, wide - ox * stride))
                if to[0].stop > to[0].start and to[1].stop > to[1].start:
                    at = slice(to[0].start + oy * stride, to[0].stop + oy * stride), slice(to[1].start + ox * stride, to[1].stop + ox * stride)
                    moved[(slice(None), *to)] = np.stack([sx, sy])[(slice(None), *at)]
                near.append(tuple(moved))
            sx, sy = R.nearer(sx, sy, near, x, y)
            stride //= 2
        return w.cut(R.seed_distance(sx, sy, x, y, float(np.hypot(grid.width, grid.height)))[None])

    def flood(found: DataFrame, halo: int, kernel: Kernel, after: int | None) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            window = grid.window(pdf, halo)
            planes, y0, x0 = kernel(window), window.y0 + window.own[0].start, window.x0 + window.own[1].start
            return _group(pdf, grid, grid.pieces(planes, y0, x0, 0) if after is None else sent(planes, y0, x0, after))

        return found.groupBy(*grid.keys, "ty", "tx").applyInPandas(run, grid.schema())

    found = flood(pieces(0), 0, seeds, stride)
    while stride >= grid.tile:
        found = flood(found, 0, long, stride // 2)
        stride //= 2
    return flood(found, grid.tile, lambda w, s=stride: short(w, s), None)


def v_cycle(pieces: DataFrame, grid: Grid, tables: Tables, smooth: int, solve: int, halo_after: int, least: int = 4, levels: int = 10) -> DataFrame:
    """One multigrid cycle on pieces of (v, al, f) with a halo of _reach(grid, smooth); on the way down a coarse raster has half the tiles a side, until one tile holds it, and one task does the rest."""
    if grid.width <= grid.tile and grid.height <= grid.tile:
        return round_(pieces, grid, _reach(grid, smooth), lambda w: w.cut(np.stack([R.v_cycle(*w.planes, smooth, solve, least, levels), *w.planes[1:]])), halo_after)

    def relax(w: Window, now: int) -> np.ndarray:
        return w.cut(np.stack([R.relaxed(*w.planes, now), *w.planes[1:]]))

    halo = _reach(grid, smooth)
    if not R.coarser(grid.height, grid.width, least, levels):
        return _stepped(pieces, grid, tables, smooth + solve + smooth, 1, halo, relax, halo_after)
    half = Grid(grid.width // 2, grid.height // 2, grid.tile, grid.keys, grid.kinds)
    wide = _reach(half, smooth)
    if smooth >= halo:  # more steps than a window holds: all but the last round's
        ahead = smooth - halo + 1
        pieces = _stepped(pieces, grid, tables, ahead, 1, halo, relax, halo)
    last = min(smooth, halo - 1)

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        w = grid.window(pdf, halo)
        y0, x0 = w.y0 + w.own[0].start, w.x0 + w.own[1].start
        v, al, f = np.stack([R.relaxed(*w.planes, last), *w.planes[1:]])
        rest = w.cut(np.where(al <= 0, f - 4 * (R.mean4(v) - v), 0.0))
        coarse, closed = R.summed_up(rest, w.cut(al))
        rows = [*grid.pieces(w.cut(np.stack([v, al, f])), y0, x0, halo, 1), *half.pieces(np.stack([np.zeros_like(coarse), closed, coarse]), y0 // 2, x0 // 2, wide)]
        return _group(pdf, grid, rows)

    name = f"level{grid.width}x{grid.height}"
    both = tables.cut(name, pieces.groupBy(*grid.keys, "ty", "tx").applyInPandas(down, grid.schema()))
    e = v_cycle(both.where("kind = 0"), half, tables, smooth, solve, 0, least, levels - 1)

    def to_fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A coarse tile's correction to all fine windows that it overlaps, at twice its places."""
        for pdf in batches:
            for k in range(len(pdf)):
                r = pdf.iloc[[k]]
                part = np.frombuffer(r.planes.iloc[0]).reshape(-1, r.h.iloc[0], r.w.iloc[0])[:1]
                yield _group(r, grid, grid.pieces(np.kron(part, np.ones((1, 2, 2))), 2 * int(r.y0.iloc[0]), 2 * int(r.x0.iloc[0]), halo, 2))

    def up(w: Window, now: int) -> np.ndarray:
        planes = {}
        for kind in (1, 2):
            top, left = w.y0, w.x0
            for y, x, part in w.extra[kind]:
                planes.setdefault(kind, np.zeros((len(part), *shape(w))))[:, y - top : y - top + part.shape[1], x - left : x - left + part.shape[2]] = part
        v, al, f = planes[1]
        v = np.where(al <= 0, v + planes[2][0], v)
        return w.cut(np.stack([R.relaxed(v, al, f, now), al, f]))

    def shape(w: Window) -> tuple[int, int]:
        ends = [(y + p.shape[1], x + p.shape[2]) for y, x, p in w.extra[1]]
        return max(a for a, _ in ends) - w.y0, max(b for _, b in ends) - w.x0

    fixes = e.where("kind = 0").mapInPandas(to_fine, grid.schema())
    first = min(smooth, halo)
    joined = both.where("kind = 1").unionByName(fixes)
    done = round_(joined, grid, halo, lambda w: up(w, first), halo if smooth > first else halo_after)
    return _stepped(done, grid, tables, smooth - first, 1, halo, relax, halo_after)


def _reach(grid: Grid, smooth: int) -> int:
    """The halo of a multigrid level: what its smoothing spoils and one ring for the residual."""
    return min(max(smooth + 1, 2), HALO, grid.tile)


def multigrid(pieces: Callable[[int], DataFrame], grid: Grid, tables: Tables, cycles: int, smooth: int = 20, solve: int = 10, levels: int = 10) -> DataFrame:
    halo = _reach(grid, smooth)
    found = pieces(halo)
    for k in range(cycles):
        found = tables.cut("cycle", v_cycle(found, grid, tables, smooth, solve, halo if k < cycles - 1 else 0, levels=levels))
    return found


def conjugate_gradient(pieces: Callable[[int], DataFrame], grid: Grid, tables: Tables, steps: int) -> DataFrame:
    """Solves Laplace(v) = 0 on the pixels not captured; pieces of (v, al).

    A step takes two rounds, one for each of its two sums over a raster, which
    are a row for each raster.  A raster that is all captured, or not at all, stays,
    and so does one whose residual is next to nothing.
    """

    def apply(u: np.ndarray, al: np.ndarray) -> np.ndarray:
        return np.where(al <= 0, 4 * (u - R.mean4(u)), 0.0)

    def summed(found: DataFrame, a: int, b: int, name: str) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                planes = [np.frombuffer(raw).reshape(-1, h, w) for raw, h, w in zip(pdf.planes, pdf.h, pdf.w)]
                yield pd.DataFrame({**{k: pdf[k] for k in grid.keys}, "s": [float((p[a] * p[b]).sum()) for p in planes], "held": [int((p[1] > 0).sum()) for p in planes]})

        return found.mapInPandas(each, f"{grid.kinds}, s double, held long").groupBy(*grid.keys).agg(F.sum("s").alias(name), F.sum("held").alias("held"))

    def moved(found: DataFrame, sums: DataFrame, halo: int, kernel: Callable[[Window, pd.Series], np.ndarray], after: int) -> DataFrame:
        """A round whose kernel also gets its raster's sums."""
        kept = [c for c in sums.columns if c not in grid.keys]

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            w = grid.window(pdf, halo)
            return _group(pdf, grid, grid.pieces(kernel(w, pdf[kept].iloc[0]), w.y0 + w.own[0].start, w.x0 + w.own[1].start, after))

        return found.join(sums, list(grid.keys)).groupBy(*grid.keys, "ty", "tx").applyInPandas(run, grid.schema())

    def start(w: Window) -> np.ndarray:
        v, al = w.planes
        r = -apply(v, al)
        return w.cut(np.stack([v, al, r, r]))

    pixels_ = grid.width * grid.height
    found = tables.cut("cg", round_(pieces(1), grid, 1, start, 0))  # v, al, r, p
    rr = summed(found, 2, 2, "rr")
    live = lambda s: s.rr >= 1e-20 and 0 < s.held < pixels_
    for _ in range(steps):
        halved = round_(found, grid, 0, lambda w: w.planes, 1)  # sends p's borders

        def multiply(w: Window) -> np.ndarray:
            v, al, r, p = w.planes
            return w.cut(np.stack([v, al, r, p, apply(p, al)]))

        found = tables.cut("q", round_(halved, grid, 1, multiply, 0))
        sums = tables.cut("pq", summed(found, 3, 4, "pq").drop("held").join(rr, list(grid.keys)))

        def step(w: Window, s: pd.Series) -> np.ndarray:
            v, al, r, p, q = w.planes
            if live(s):
                k = s.rr / s.pq
                v, r = v + k * p, r - k * q
            return np.stack([v, al, r, p])

        found = tables.cut("cg", moved(found, sums, 0, step, 0))
        new = summed(found, 2, 2, "new").drop("held")
        both = tables.cut("rr", sums.join(new, list(grid.keys)))

        def turn(w: Window, s: pd.Series) -> np.ndarray:
            v, al, r, p = w.planes
            return np.stack([v, al, r, r + s.new / s.rr * p if live(s) else p])

        found = tables.cut("turned", moved(found, both, 0, turn, 0))
        rr = both.select(*grid.keys, F.when((F.col("rr") >= 1e-20) & (F.col("held") > 0) & (F.col("held") < pixels_), F.col("new")).otherwise(F.col("rr")).alias("rr"), "held")
    return found


METHODS = {
    "sor": sor,
    "jacobi": jacobi,
    "jfa": lambda pieces, grid, tables, steps: jump_flood(pieces, grid, tables),
    "cg": conjugate_gradient,
    "multigrid": multigrid,
    "two_grid": lambda pieces, grid, tables, cycles: multigrid(pieces, grid, tables, cycles, 2, 2, 2),
}


def solved(raster: DataFrame, method: str, steps: int, width: int, height: int, tile: int = TILE, keys: tuple[str, ...] = ("view", "layer")) -> DataFrame:
    """(keys, px, py, v) after ``steps`` of a method on each raster (keys, px, py, v, al) of width x height pixels, whatever its size; jfa gives the flooded distance.

    The methods and their results are those of raster.solved(), where a task holds a
    whole raster.  A pixel without a row, or null, is 0 and not captured; pixels off
    the raster are an error; a raster without any row has none.  ValueError for an
    unknown method or an odd tile.
    """
    if method not in METHODS:
        raise ValueError(f"{method!r} is none of {sorted(METHODS)}")
    if tile < 2 or tile % 2:
        raise ValueError("the side of a tile must be even")
    kinds = dict(raster.dtypes)
    grid = Grid(width, height, tile, keys, ", ".join(f"{k} {kinds[k]}" for k in keys))
    tables = Tables(raster.sparkSession)
    columns = ("al",) if method == "jfa" else ("v", "al")
    source = raster.withColumn("f", F.lit(0.0)) if method in ("multigrid", "two_grid") else raster
    columns += ("f",) * (method in ("multigrid", "two_grid"))

    def pieces(halo: int) -> DataFrame:
        return _whole(tiled(source, columns, grid, halo), grid, halo, len(columns))

    if not steps and method != "jfa":
        return pixels(round_(pieces(0), grid, 0, lambda w: w.planes, 0), grid)
    return pixels(METHODS[method](pieces, grid, tables, steps), grid)


def _whole(found: DataFrame, grid: Grid, halo: int, n: int) -> DataFrame:
    """The pieces, and empty ones for tiles of a raster that have no pixel, as the rounds are by tile."""
    rows, cols = -(-grid.height // grid.tile), -(-grid.width // grid.tile)
    every = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    own = found.select(*grid.keys, "ty", "tx").distinct()
    blank = found.select(*grid.keys).distinct().withColumn("k", F.explode(every)).select(*grid.keys, F.floor(F.col("k") / cols).cast("int").alias("ty"), (F.col("k") % cols).cast("int").alias("tx"))
    blank = blank.join(own, [*grid.keys, "ty", "tx"], "left_anti")
    zero = np.zeros((n, 1, 1)).tobytes()
    at = [(F.col(c) * grid.tile).cast("int").alias(f"{c[1]}0") for c in ("ty", "tx")]
    return found.unionByName(blank.select("*", F.lit(0).alias("kind"), *at, F.lit(1).alias("h"), F.lit(1).alias("w"), F.lit(zero).alias("planes")))
