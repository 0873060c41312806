"""The nearest neighbours of a large cloud's points in the cloud itself, by blocks of nearby points.

A block's points meet in one task, so a point travels once for its own block and once
for each further block that the ball of its k nearest so far reaches into: no
probes of cells are shuffled.  Blocks follow the points' density, and what is measured in a
block are runs of points whose boxes are near enough, so neither needs points to be spread evenly.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

#: Points that a block holds at least before it is cut (up to twice as many stay together), and blocks at most, about.
BLOCK, BLOCKS = 8192, 10_000
#: Slices of a block of which a pass counts the points, and passes at most.
SLICES, PASSES = 256, 64
#: Points of a run, pairs of points that a task measures at once, and points of a task.
RUN, PAIRS, TASK = 24, 1 << 20, 100_000
ENDS = [f"{c}{e}" for c in "xyz" for e in (0, 1)]


def _ends() -> list:
    return [f(c).alias(f"{c}{e}") for c in "xyz" for e, f in ((0, F.min), (1, F.max))]


def blocked(tables: Tables, points: DataFrame, most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """points with their ``block``, and the blocks (block, n, and the ends x0 .. z1 of their points).

    A pass cuts every block of more than twice ``most`` points across its longest side, at the edges
    of slices that are counted; a slice with more than a part's share becomes a block by
    itself.  Points at one place stay together.
    """
    own = points.withColumn("block", F.lit(0).cast("long"))
    every = tables.cut("blocks", own.groupBy("block").agg(F.count("*").alias("n"), *_ends()))
    total = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(most, total // BLOCKS)
    for k in range(PASSES):
        side = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"))
        large = (F.col("n") > 2 * most) & (side > 0)
        if every.where(large).isEmpty():
            break
        axis = F.coalesce(*(F.when(F.col(f"{c}1") - F.col(f"{c}0") == side, F.lit(i)) for i, c in enumerate("xyz")))
        parts = F.ceil(F.pow(F.col("n") / most, F.lit(1 / max(1, 3 - k))))
        split = every.where(large).select("block", (F.col("n") / parts).alias("share"), axis.alias("axis"), F.get(F.array("x0", "y0", "z0"), axis).alias("low"), side.alias("side"))  # at most BLOCKS rows
        at = F.when(F.col("axis") == 0, F.col("x")).when(F.col("axis") == 1, F.col("y")).otherwise(F.col("z"))
        slice_ = F.least(F.floor((at - F.col("low")) / F.col("side") * SLICES), F.lit(SLICES - 1)).cast("int")
        counted = own.join(F.broadcast(split), "block").groupBy("block", "share", slice_.alias("slice")).agg(F.count("*").alias("n"), *_ends())
        before = F.sum("n").over(Window.partitionBy("block").orderBy("slice")) - F.col("n")
        part = F.when(F.col("n") > F.col("share"), -F.col("slice") - 1).otherwise(F.floor(before / F.col("share")))
        counted = tables.cut(f"slices{k}", counted.withColumn("part", F.xxhash64("block", part.cast("long"))))  # SLICES rows of a block at most; equal hashes would join two blocks, no more
        to = counted.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slice", "part"))).alias("to"))
        to = tables.cut(f"to{k}", split.join(to, "block").select("block", "axis", "low", "side", F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda s: F.col("to")[s]).alias("to")))
        own = own.join(F.broadcast(to), "block", "left").withColumn("block", F.coalesce(F.get("to", slice_), "block")).drop("axis", "low", "side", "to")
        parts_ = counted.groupBy(F.col("part").alias("block")).agg(F.sum("n").alias("n"), *(f(e).alias(e) for e, f in zip(ENDS, 3 * (F.min, F.max))))
        every = tables.cut("blocks", every.where(~large).unionByName(parts_))
    return own, every


class Runs:
    """Points in an order that puts runs of ``size`` of them near each other: by x into slabs, in these by y into strips, in these by z; with the runs' boxes."""

    def __init__(self, at: np.ndarray, size: int):
        n = len(at)
        per = max(1, int(np.ceil((n / size) ** (1 / 3))))
        self.order, group = np.argsort(at[:, 0], kind="stable"), np.empty(n, np.int64)
        for axis, points in ((1, per * per * size), (2, per * size)):
            group[self.order] = np.arange(n) // points
            self.order = np.lexsort((at[:, axis], group))
        self.at, self.size, self.starts = at[self.order], size, np.arange(0, n, size)
        self.low, self.high = (f.reduceat(self.at, self.starts, axis=0) for f in (np.minimum, np.maximum))

    def own_reach(self, k: int) -> np.ndarray:
        """A distance within which each point has k of the points, from its run alone; infinite with fewer points."""
        n, reach = len(self.at), np.full(len(self.at), np.inf)
        whole = n // self.size * self.size
        for first, at in ((0, self.at[:whole].reshape(-1, self.size, 3)), (max(0, n - self.size), self.at[None, max(0, n - self.size) :])):
            if at.size and at.shape[1] >= k:
                found = np.partition(_distance(at[:, :, None], at[:, None]), k - 1, axis=2)[:, :, k - 1].ravel()
                reach[first : first + len(found)] = np.minimum(reach[first : first + len(found)], found)
        return reach


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As in the cell search and in SQL: terms in this order."""
    x, y, z = (a[..., i] - b[..., i] for i in range(3))
    return np.sqrt(x * x + y * y + z * z)


def _gap(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """The distance of two boxes: not above that of any of their points, as each step rounds in the same way."""
    x, y, z = (np.maximum(np.maximum(low2[..., i] - high[..., i], low[..., i] - high2[..., i]), 0.0) for i in range(3))
    return np.sqrt(x * x + y * y + z * z)


def _meeting(low: np.ndarray, high: np.ndarray, reach: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of boxes whose distance is within the first one's reach, in order of i."""
    found, rows = [], max(1, PAIRS // max(1, len(low2)))
    for at in range(0, len(low), rows):
        i, j = np.nonzero(_gap(low[at : at + rows, None], high[at : at + rows, None], low2, high2) <= reach[at : at + rows, None])
        found.append((i + at, j))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.empty(0, np.int64),) * 2


def _members(runs: Runs, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, point) of each point of those runs."""
    point = runs.starts[of][:, None] + np.arange(runs.size)
    place, column = np.nonzero(point < len(runs.at))
    return place, point[place, column]


def _ranks(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of equal numbers begins, and each number's rank in its stretch."""
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    return first, np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))


def _first(q: np.ndarray, d: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each q the k first by d and p, in order.  A sort by one rounded number bounds the k-th distance, so only what is within that bound is put in order exactly."""
    if not len(q):
        return q, d, p
    top = d.max()
    order = np.argsort(q + d * (0.5 / top) if 0 < top < np.inf else q, kind="stable")
    q, d, p = q[order], d[order], p[order]
    first, rank = _ranks(q)
    bound = np.maximum.reduceat(np.where(rank < k, d, 0.0), first)
    near = np.flatnonzero(d <= np.repeat(bound, np.diff(np.r_[first, len(q)])))
    q, d, p = q[near], d[near], p[near]
    if not ((q[1:] > q[:-1]) | (d[1:] > d[:-1]) | ((d[1:] == d[:-1]) & (p[1:] > p[:-1]))).all():
        order = np.lexsort((p, d, q))
        q, d, p = q[order], d[order], p[order]
    kept = _ranks(q)[1] < k
    return q[kept], d[kept], p[kept]


def best(asked: Runs, reach: np.ndarray, held: Runs, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, d, id): the k nearest held points within the reach of each asked point, in order, lower ids first at ties; points and ids are numbered by the runs' orders."""
    if not len(asked.at) or not len(held.at):
        return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
    i, j = _meeting(asked.low, asked.high, np.maximum.reduceat(reach, asked.starts), held.low, held.high)
    ends = np.searchsorted(i, np.arange(len(asked.starts)), "right")  # pairs of runs up to each asked run
    out, run, most = [], 0, max(1, PAIRS // (asked.size * held.size))
    while run < len(ends):
        done = ends[run - 1] if run else 0
        to = max(run + 1, int(np.searchsorted(ends, done + most, "right")))
        pair, q = _members(asked, i[done : ends[to - 1]])
        r = j[done : ends[to - 1]][pair]
        a = asked.at.take(q, 0)
        near = _gap(a, a, held.low.take(r, 0), held.high.take(r, 0)) <= reach[q]
        q, r = q[near], r[near]
        pair, p = _members(held, r)
        q = q[pair]
        d = _distance(asked.at.take(q, 0), held.at.take(p, 0))
        near = np.flatnonzero(d <= reach[q])
        out.append(_first(q[near], d[near], ids[p[near]], k))
        run = to
    return tuple(np.concatenate(v) for v in zip(*out))


def _enough(at: np.ndarray, k: int, n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For points that haven't k in their block: a distance within which whole blocks have k; infinite where all have fewer."""
    reach = np.full(len(at), np.inf)
    for row, a in enumerate(at):
        far = _distance(np.maximum(np.abs(a - low), np.abs(high - a)), np.zeros(3))
        order = np.argsort(far)
        last = np.searchsorted(np.cumsum(n[order]), k)
        if last < len(n):
            reach[row] = far[order[last]]
    return reach


def _places(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in "xyz"], axis=1)


def _lists(n: int, point: np.ndarray, *values: pa.Array, names: tuple[str, ...] = ()) -> pa.Array:
    """For each of n points the values that stand at it, in their order."""
    ends = np.searchsorted(point, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(values, names) if names else values[0])


BEST = "best array<struct<d: double, other: bigint>>"


def searched(tables: Tables, points: DataFrame, k: int) -> DataFrame:
    """(point_id, other, d): the k nearest points (point_id, x, y, z, asks) of each that asks, itself included, the lowest ids at ties; those without finite coordinates are left out."""
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in "xyz"])
    points = points.select(F.col("point_id").cast("long").alias("point_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"), "asks").where(finite)
    own, every = blocked(tables, points)
    rows = every.toPandas()  # at most twice BLOCKS rows, or a few for each hot slice
    ends = rows[[f"{c}0" for c in "xyz"]].to_numpy(), rows[[f"{c}1" for c in "xyz"]].to_numpy()
    shared = points.sparkSession.sparkContext.broadcast((rows["block"].to_numpy(), rows["n"].to_numpy(), *ends))
    size = max(RUN, k)

    def within(table: pa.Table) -> pa.Table:
        """The k nearest in the own block, and the other blocks in which nearer ones may be."""
        names, n, low, high = shared.value
        block, held = table["block"][0].as_py(), Runs(_places(table), size)
        ids, asks = table["point_id"].to_numpy()[held.order], np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False)[held.order])
        asked = Runs(held.at[asks], size) if len(asks) < len(ids) else held
        which = asks[asked.order] if asked is not held else asks
        reach = held.own_reach(k)[which]
        q, d, other = best(asked, reach, held, ids, k)
        if len(ids) >= k:
            reach = d[np.searchsorted(q, np.arange(len(which)), "right") - 1]
        else:
            reach = _enough(asked.at, k, n, low, high)
        far = np.flatnonzero(names != block)
        far = far[_gap(held.low.min(0), held.high.max(0), low[far], high[far]) <= reach.max(initial=0.0)]
        run, b = _meeting(asked.low, asked.high, np.maximum.reduceat(reach, asked.starts), low[far], high[far]) if len(which) else (far[:0], far[:0])
        pair, point = _members(asked, run)
        b = far[b[pair]]
        near = _gap(asked.at[point], asked.at[point], low[b], high[b]) <= reach[point]
        point, b = point[near], b[near]
        order = np.argsort(point, kind="stable")
        point, b = point[order], b[order]
        stays = np.bincount(point, minlength=len(which)) == 0
        found = {"point_id": pa.array(ids[which]), "best": _lists(len(which), q, pa.array(d), pa.array(other), names=("d", "other")), "blocks": _lists(len(which), point, pa.array(names[b]))}
        return pa.table({**found, **{c: pa.array(v, mask=stays) for c, v in zip("xyz", asked.at.T)}, "reach": pa.array(reach, mask=stays)})

    def beyond(visits: pa.Table, table: pa.Table) -> pa.Table:
        """Nearer ones of another block's points."""
        asked, held = (Runs(_places(t), size) if len(t) else None for t in (visits, table))
        q, d, other = best(asked, visits["reach"].to_numpy()[asked.order], held, table["point_id"].to_numpy()[held.order], k) if asked and held else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        some, q = np.unique(q, return_inverse=True)
        ids = visits["point_id"].to_numpy()[asked.order][some] if asked else some
        return pa.table({"point_id": pa.array(ids, pa.int64()), "best": _lists(len(some), q, pa.array(d), pa.array(other), names=("d", "other"))})

    dealt = own.repartition(max(1, min(int(rows["n"].sum()) // TASK, 100_000)), "block")  # few bytes of much work: Spark would put many blocks into one task
    met = tables.cut("met", dealt.groupBy("block").applyInArrow(within, f"point_id long, {BEST}, blocks array<bigint>, x double, y double, z double, reach double"))
    shared.unpersist()
    visits = met.where(F.size("blocks") > 0).select("point_id", *"xyz", "reach", F.explode("blocks").alias("block"))
    more = visits.groupBy("block").cogroup(own.select("point_id", *"xyz", "block").groupBy("block")).applyInArrow(beyond, f"point_id long, {BEST}")
    joined = met.where(F.size("blocks") > 0).select("point_id", "best").unionByName(more).groupBy("point_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    done = met.where(F.size("blocks") == 0).select("point_id", "best").unionByName(joined)
    return done.select("point_id", F.explode("best").alias("b")).select("point_id", "b.other", "b.d")
