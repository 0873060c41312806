"""Sampling, thinning, neighbour joins, normals and partitioning of point clouds."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .tables import Tables, cut

#: Query vectors that one pass of nearest_vectors() ships to the executors.
QUERY_BLOCK = 5000


def numbered(rows: DataFrame, name: str, *order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with their number from 0 in some columns' order, within each key of ``by``, by a two-level sum: rows are counted by range, then numbered within each range."""
    ranged = cut(rows.drop(name).repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = counts.select(*by, "__part", (F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")).alias("__before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    return ranged.join(before, [*by, "__part"]).select(*ranged.drop("__part").columns, (F.col("__before") + own - 1).alias(name))


def _scattered(n: Column, seed: int = 0) -> Column:
    """A multiplicative hash of whole numbers to 32 bits."""
    return (F.pmod(n, F.lit(1 << 31)) * 2654435761 + seed) % 4294967296


def thinned(points: DataFrame, n: int, seed: int = 42, key: str = "point_id") -> DataFrame:
    """Exactly n points without replacement (all, if fewer), the same ones every time: the first by a multiplicative hash of the id, then by the id.

    A histogram of the hash tells in which of its 65,536 ranges the n-th point lies;
    whole ranges below go in, and only that one is sorted.
    """
    if n <= 0:
        return points.limit(0)
    hashed = points.withColumn("__h", _scattered(F.col(key), seed))
    level = F.shiftright("__h", 16)
    before, border = 0, None
    for r in hashed.groupBy(level.alias("b")).agg(F.count("*").alias("c")).orderBy("b").collect():
        if before + r.c >= n:
            border = r.b
            break
        before += r.c
    if border is None:
        return points
    last = hashed.where(level == border).orderBy("__h", key).limit(n - before)
    return hashed.where(level < border).unionByName(last).drop("__h")


def every_tenth(points: DataFrame, step: int = 10, index: str = "idx") -> DataFrame:
    """Every step-th point with ids renumbered from 0; ``index`` numbers the points."""
    return points.where(F.col(index) % step == 0).withColumn("id", F.floor(F.col(index) / step).cast("long"))


def alpha_masked(pixels: DataFrame, drop: float | Column, seed: int = 0) -> DataFrame:
    """Pixels with alpha set to 0 for about the share ``drop`` of them, the same ones every time: by a multiplicative hash of the place."""
    chance = _scattered(F.col("px").cast("long") * 73856093 + F.col("py").cast("long") * 19349663 + seed) / 4294967296.0
    return pixels.withColumn("a", F.when(chance > drop, F.col("a")).otherwise(0.0))


def masked_levels(pixels: DataFrame, percents: tuple[int, ...] = (50, 80, 90, 95, 99)) -> DataFrame:
    """(percent, px, py, ..): the pixels once for each percentage of them to mask."""
    levels = pixels.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    return alpha_masked(levels, F.col("percent") / 100.0)


def _cell(size: float) -> dict[str, Column]:
    return {f"c{c}": F.floor(F.col(c) / size).cast("long") for c in "xyz"}


def downsampled(points: DataFrame, size: float) -> DataFrame:
    """The mean point of every voxel: (cx, cy, cz, n, x, y, z)."""
    return points.withColumns(_cell(size)).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"))


#: A cell with more than one in so many of the right side's points is hot, so there are fewer hot cells than this; its points are dealt to SALTS tasks.
HOT_CELLS, SALTS = 1000, 16
#: Right points of a neighbour join that are shipped to all tasks, by cell; with more, both sides meet in a shuffle.
FEW_RIGHT = 8192


def _around() -> Column:
    steps = (-1, 0, 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in steps for j in steps for k in steps])


def _candidates(left: DataFrame, right: DataFrame, size: float, reach: float | None = None) -> DataFrame:
    """Pairs (point_id, other, d, cell, rx, ry, rz) of points whose cells touch: an equi-join on cells; the left side probes its 27 cells, and of those only what begins within ``reach``."""
    probe = left.select("point_id", *"xyz").withColumns(_cell(size)).withColumn("o", F.explode(_around()))
    if reach is not None:
        gaps = [F.greatest((F.col(f"c{c}") + F.col(f"o.{o}")) * size - F.col(c), F.col(c) - (F.col(f"c{c}") + F.col(f"o.{o}") + 1) * size, F.lit(0.0)) for c, o in zip("xyz", "ijk")]
        probe = probe.where(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2] <= reach * reach * (1 + 1e-9))
    probe = probe.select("point_id", *"xyz", *((F.col(f"c{c}") + F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip("xyz", "ijk")))
    held = right.withColumns(_cell(size)).select(F.col("point_id").alias("other"), *(F.col(c).alias(f"r{c}") for c in "xyz"), "cx", "cy", "cz")
    counts = held.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
    total, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(total / HOT_CELLS, 4096)
    if most > bound:
        few = F.broadcast(counts.where(F.col("n") > bound).select("cx", "cy", "cz", F.lit(True).alias("hot")))  # fewer than HOT_CELLS rows
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        held = held.join(few, ["cx", "cy", "cz"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        probe = probe.join(few, ["cx", "cy", "cz"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    d2 = sum(((F.col(c) - F.col(f"r{c}")) * (F.col(c) - F.col(f"r{c}")) for c in "xyz"), F.lit(0.0))
    on = [c for c in probe.columns if c in held.columns]
    return probe.join(held.hint("merge"), on).withColumn("d", F.sqrt(d2))  # sizes are guessed before cells are probed: a guess must not broadcast a cloud


def _is_few(right: DataFrame) -> bool:
    return right.select("point_id").limit(FEW_RIGHT + 1).count() <= FEW_RIGHT


def _beside(left: DataFrame, right: DataFrame, size: float, most: int | None, radius: float | None = None) -> DataFrame:
    """left with ``best``: its nearest (d, other, rx, ry, rz) of few right points in the 27 cells around it (within the radius), lower ids first at ties, at most so many; nothing is shuffled but the right side."""
    near = right.select(F.struct(F.col("point_id").alias("other"), *(F.col(c).alias(f"r{c}") for c in "xyz")).alias("p"), *"xyz").withColumns(_cell(size)).withColumn("o", F.explode(_around()))
    near = near.groupBy(*((F.col(f"c{c}") - F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip("xyz", "ijk"))).agg(F.collect_list("p").alias("near"))  # 27 entries for each of FEW_RIGHT points at most

    def measured(p: Column) -> Column:
        d2 = sum(((F.col(c) - p[f"r{c}"]) * (F.col(c) - p[f"r{c}"]) for c in "xyz"), F.lit(0.0))
        return F.struct(F.sqrt(d2).alias("d"), *(p[c].alias(c) for c in ("other", "rx", "ry", "rz")))

    best = F.transform("near", measured)
    best = best if radius is None else F.filter(best, lambda p: p["d"] <= radius)
    best = F.filter(F.array(F.array_min(best)), lambda p: p.isNotNull()) if most == 1 else best if most is None else F.slice(F.sort_array(best), 1, most)
    return left.withColumns(_cell(size)).join(F.broadcast(near), ["cx", "cy", "cz"], "left").select(*left.columns, F.coalesce(best, F.array()).alias("best"))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Of each point the k nearest pairs, lower ids first at ties: first of each (point, cell), where the join left them, then of what is left of a point."""
    on = [c for c in ("cx", "cy", "cz", "salt") if c in pairs.columns]
    for keys in ([*on, "point_id"], ["point_id"]):
        w = Window.partitionBy(*keys).orderBy("d", "other")
        pairs = pairs.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    return pairs


def _extent(*clouds: DataFrame) -> float:
    """The longest side of the joint box of the clouds' finite points; 0 without any."""
    every = reduce(DataFrame.unionByName, [c.select(*(F.col(c_).cast("double").alias(c_) for c_ in "xyz")) for c in clouds])
    finite = reduce(lambda a, b: a & b, [F.abs(F.col(c)) < float("inf") for c in "xyz"])
    sides = every.where(finite).agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
    return max((v for v in sides if v is not None), default=0.0)


def spacing(points: DataFrame, k: int) -> float:
    """The side of cells of which a ball of that radius holds about k points, if they were spread evenly over their box."""
    n = points.count()
    sides = points.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
    volume = 1.0
    for v in sides:
        volume *= max(v or 0.0, 1e-3)
    return max((k * volume / (max(n, 1) * 4.19)) ** (1 / 3), 1e-6)


def nearest(left: DataFrame, right: DataFrame, size: float, k: int = 1) -> DataFrame:
    """(point_id, other, d): the k nearest right points of every left point, the lowest ids at ties.

    A point whose k-th distance within the 27 cells around is at most the cell size
    is done; the others go on with cells twice as large (eight times where none of them
    has a candidate), until none is left.  Cells larger than the joint box end the
    search, as 27 of them hold every right point.  Fewer right points than k give as many as there are.
    Where at least half of many left points share a place with another, or a place has more
    than a block's, each place is searched once, among the k lowest ids of each right place.
    A large cloud is searched in itself by blocks, where no probes are shuffled.
    """
    tables, itself = Tables(left.sparkSession), left is right
    todo, right = (tables.cut(name, df.select("point_id", *"xyz")) for name, df in (("todo", left), ("right", right)))
    extent, few, done, members, places, rest_of = _extent(todo, right), _is_few(right), None, None, None, "todo"
    if not few:
        places = tables.cut("places", todo.groupBy(*"xyz").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")).select("point_id", *"xyz", "n"))
        alone, every, most = places.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        places = places.drop("n")
        if 2 * alone <= every or most > blocks.BLOCK:
            members, todo, rest_of = todo, places, "open"
            lowest = Window.partitionBy(*"xyz").orderBy("point_id")
            right = tables.cut("right", right.withColumn("__k", F.row_number().over(lowest)).where(F.col("__k") <= k).withColumn("asks", F.col("__k") == 1).drop("__k"))
        else:
            tables.drop("places")
        if itself and every > blocks.BLOCK and todo.where(_odd()).isEmpty():
            done = blocks.searched(tables, right if members is not None else right.withColumn("asks", F.lit(True)), k)
            return done if members is None else _of_members(members, places, done)
    for n in count():
        whole = size > 1.001 * extent
        if few:
            met = _beside(todo, right, size, k)
            sure = F.lit(True) if whole else F.coalesce((F.size("best") == k) & (F.get("best", F.lit(k - 1))["d"] <= size), F.lit(False))
            met = tables.cut(f"best{n}", met.select("point_id", *"xyz", F.transform("best", lambda p: F.struct(p["d"].alias("d"), p["other"].alias("other"))).alias("best"), sure.alias("sure")))
            found = met.where("sure").select("point_id", F.explode("best").alias("b")).select("point_id", "b.other", "b.d")
            none, rest = not whole and met.where(F.size("best") > 0).isEmpty(), met.where("NOT sure").select("point_id", *"xyz")
        else:
            met = _best(_candidates(todo, right, size, None if whole else size), k)
            sure = F.lit(True) if whole else F.max((F.col("k") == k) & (F.col("d") <= size)).over(Window.partitionBy("point_id"))
            met = tables.cut(f"best{n}", met.select("point_id", "other", "d", "k", sure.alias("sure")))
            found = met.where("sure").select("point_id", "other", "d")
            none, rest = not whole and met.isEmpty(), todo.join(met.where("sure AND k = 1").select("point_id").hint("merge"), "point_id", "left_anti")
        done = found if done is None else done.unionByName(found)
        if none:  # nothing near anyone who is left: a wide gap
            size *= 8
            continue
        if not whole:
            todo = tables.cut(rest_of, rest)
            size *= 2
        if whole or todo.isEmpty():
            tables.drop("right", *({rest_of} & tables.versions.keys()))
            return done if members is None else _of_members(members, places, done)


def _odd() -> Column:
    """Whether a point has a coordinate that is infinite or no number."""
    return reduce(lambda a, b: a | b, [~F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(True)) for c in "xyz"])


def _of_members(members: DataFrame, places: DataFrame, done: DataFrame) -> DataFrame:
    """What was found for the point that stands for each place, for all points there."""
    found = places.join(done.hint("merge"), "point_id").select(*"xyz", "other", "d")
    return members.join(found.hint("merge"), [*"xyz"]).select("point_id", "other", "d")


def _near(left: DataFrame, right: DataFrame, radius: float, most: int | None) -> DataFrame:
    if _is_few(right):
        return _beside(left.select("point_id", *"xyz"), right, radius, most, radius).select("point_id", *"xyz", F.explode("best").alias("b")).select("point_id", *"xyz", "b.*")
    pairs = _candidates(left, right, radius, radius).where(F.col("d") <= radius)
    return pairs if most is None else _best(pairs, most)


def within(left: DataFrame, right: DataFrame, radius: float, most: int | None = None) -> DataFrame:
    """(point_id, other, d) of all pairs within the radius, at most the ``most`` nearest of a point; cells have the radius's size."""
    return _near(left, right, radius, most).select("point_id", "other", "d")


def without_outliers(points: DataFrame, neighbours: int = 64, sigmas: float = 5.0, size: float | None = None) -> DataFrame:
    """Points whose mean distance to their nearest neighbours, themselves included, is above 0 and below the mean of all by so many sample deviations; ``size`` is that of the first search's cells, in which nearly all find theirs if points are spread evenly."""
    mean = cut(nearest(points, points, size or spacing(points, 2 * neighbours), neighbours).groupBy("point_id").agg(F.avg("d").alias("m")))
    bound = F.broadcast(mean.agg((F.avg("m") + sigmas * F.coalesce(F.stddev_samp("m"), F.lit(0.0))).alias("top")))  # one row
    return points.join(mean.crossJoin(bound).where("m > 0 AND m < top").select("point_id").hint("merge"), "point_id", "left_semi")


def covariances(points: DataFrame, radius: float, most: int = 512) -> DataFrame:
    """(point_id, n, xx, xy, xz, yy, yz, zz): how many neighbours a point has, itself included, and their covariances."""
    terms = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return _near(points, points, radius, most).groupBy("point_id").agg(F.count("*").alias("n"), *(F.covar_pop(f"r{a}", f"r{b}").alias(a + b) for a, b in terms))


def normals(points: DataFrame, radius: float, most: int = 512) -> DataFrame:
    """(point_id, nx, ny, nz): the direction of least spread of each point's neighbourhood.

    The covariance is an aggregate; only the eigenvector of a 3 x 3 matrix is worked
    out in Python, vectorised over a batch.  Fewer than three neighbours give 0.
    """
    terms = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]

    def least(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), 3, 3))
            for a, b in terms:
                m[:, "xyz".index(a), "xyz".index(b)] = m[:, "xyz".index(b), "xyz".index(a)] = pdf[a + b].fillna(0.0)
            v = np.linalg.eigh(m)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            v = np.where((pdf.n.to_numpy() >= 3)[:, None], v, 0.0)
            yield pd.DataFrame({"point_id": pdf.point_id, "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    return covariances(points, radius, most).mapInPandas(least, "point_id long, nx double, ny double, nz double")


#: Edges between parts that one task can finish a spanning tree of.
FEW_EDGES = 100_000


def oriented(normal: DataFrame, points: DataFrame, radius: float, most: int = 10, few: int = FEW_EDGES) -> DataFrame:
    """Normals with neighbours on one side, over each connected group of the neighbour graph; a group's lowest id keeps its sign.

    Signs follow the group's minimum spanning tree, where an edge weighs less the more
    parallel its normals are, ties by the ids.  In a round every part takes its lightest
    edge to another part, all parts that hang together so become one, and of the edges
    between two parts the lightest stays.  Parts halve at least in a round, so the rounds
    grow with the logarithm of the points, not with the group's width.  What is left of a
    graph with at most ``few`` edges is done in one task, with the same tree.
    """
    tables = Tables(points.sparkSession)
    normal = tables.cut("normal", normal)
    near = within(points, points, radius, most + 1).where("point_id <> other")
    pairs = near.select(F.least("point_id", "other").alias("a"), F.greatest("point_id", "other").alias("b")).distinct()
    dots = pairs
    for end, n in (("a", "n"), ("b", "m")):
        dots = dots.join(normal.select(F.col("point_id").alias(end), *(F.col(f"n{c}").alias(f"{n}{c}") for c in "xyz")), end)
    dot = F.expr("nx * mx + ny * my + nz * mz")
    lightest = F.struct((-F.abs(dot)).alias("w"), F.col("a").alias("lo"), F.col("b").alias("hi"), F.when(dot < 0, -1).otherwise(1).alias("flip"))
    edges = tables.cut("edges", dots.select("a", "b", lightest.alias("m")))
    state = normal.select("point_id", F.col("point_id").alias("root"), F.lit(1).alias("sign"))
    while left := edges.count():
        hooks = _finished(edges) if left <= few else _hooked(tables, edges)
        hooks = tables.cut("roots", hooks)
        state = tables.cut("state", state.join(hooks, "root", "left").select("point_id", F.coalesce("up", "root").alias("root"), (F.col("sign") * F.coalesce("flip", F.lit(1))).alias("sign")))
        if left <= few:
            break
        moved = edges
        for end in "ab":
            moved = moved.join(hooks.select(F.col("root").alias(end), F.col("up").alias(f"{end}_up"), F.col("flip").alias(f"{end}_flip")), end)
        moved = moved.where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"), F.col("m").withField("flip", F.expr("m.flip * a_flip * b_flip")).alias("m"))
        edges = tables.cut("edges", moved.groupBy("a", "b").agg(F.min("m").alias("m")))
    first = state.groupBy("root").agg(F.min_by("sign", "point_id").alias("first"))
    signs = state.join(first, "root").select("point_id", (F.col("sign") * F.col("first")).alias("sign"))
    tables.drop("edges")
    return normal.join(signs, "point_id").select("point_id", *((F.col(f"n{c}") * F.col("sign")).alias(f"n{c}") for c in "xyz"))


def _hooked(tables: Tables, edges: DataFrame) -> DataFrame:
    """(root, up, flip): of every part at an edge, the part that it and all that hang together by their lightest edges become, and the sign between the two."""
    ends = edges.select(F.col("a").alias("root"), F.col("b").alias("up"), "m").unionByName(edges.select(F.col("b").alias("root"), F.col("a").alias("up"), "m"))
    best = tables.cut("best", ends.groupBy("root").agg(F.min(F.struct("m", "up")).alias("e")).select("root", "e.up", "e.m.flip"))
    # Edges are ordered, so the only rings are two parts that took the same edge: the lower of them is a root.
    mutual = best.select(F.col("root").alias("up"), F.col("up").alias("root"), F.lit(True).alias("mutual"))
    stays = F.coalesce("mutual", F.lit(False)) & (F.col("root") < F.col("up"))
    hooks = tables.cut("hooks", best.join(mutual, ["root", "up"], "left").select("root", F.when(stays, F.col("root")).otherwise(F.col("up")).alias("up"), F.when(stays, 1).otherwise(F.col("flip")).alias("flip"), F.lit(True).alias("moved")))
    while not hooks.where("moved").isEmpty():
        above = hooks.select(F.col("root").alias("up"), F.col("up").alias("top"), F.col("flip").alias("more"))
        hooks = tables.cut("hooks", hooks.join(above, "up").select("root", F.col("top").alias("up"), (F.col("flip") * F.col("more")).alias("flip"), (F.col("top") != F.col("up")).alias("moved")))
    return hooks.drop("moved")


def _finished(edges: DataFrame) -> DataFrame:
    """(root, up, flip) of every part at an edge, by the spanning tree of all edges that are left; for a bounded number of them."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        up, flip = {}, {}

        def top(v: int) -> tuple[int, int]:
            way, sign = [], 1
            while up.get(v, v) != v:
                way.append(v)
                v = up[v]
            for u in reversed(way):  # later calls take one step
                sign *= flip[u]
                up[u], flip[u] = v, sign
            return v, sign

        for a, b, s in pdf.sort_values(["w", "lo", "hi"])[["a", "b", "flip"]].itertuples(index=False):
            (p, p_sign), (q, q_sign) = top(a), top(b)
            if p != q:
                up[q], flip[q] = p, p_sign * q_sign * s
        parts = pd.unique(pdf[["a", "b"]].to_numpy().ravel())
        ends = [top(int(v)) for v in parts]
        return pd.DataFrame({"root": parts, "up": [p for p, _ in ends], "flip": [s for _, s in ends]})

    return edges.select("a", "b", "m.*").groupBy().applyInPandas(tree, "root long, up long, flip int")


def flipped_up(normal: DataFrame, up: str) -> DataFrame:
    """All normals turned over if they point down on average."""
    mean = F.broadcast(normal.agg(F.avg(f"n{up}").alias("m")))  # one row
    sign = F.when(F.col("m") < 0, -1.0).otherwise(1.0)
    return normal.crossJoin(mean).select("point_id", *((F.col(f"n{c}") * sign).alias(f"n{c}") for c in "xyz"))


def transferred(full: DataFrame, sampled: DataFrame, normal: DataFrame, size: float) -> DataFrame:
    """(point_id, nx, ny, nz) of a full cloud: each point takes its nearest sampled point's normal."""
    held = cut(normal.withColumnRenamed("point_id", "other"))
    return nearest(full, sampled, size).join(F.broadcast(held) if held.count() <= FEW_RIGHT else held.hint("merge"), "other").select("point_id", "nx", "ny", "nz")


def normal_stats(normal: DataFrame) -> DataFrame:
    """One row: mean normal, and the range of lengths."""
    length = F.sqrt(F.expr("nx * nx + ny * ny + nz * nz"))
    return normal.agg(*(F.avg(f"n{c}").alias(f"n{c}") for c in "xyz"), F.min(length).alias("shortest"), F.max(length).alias("longest"))


#: Open cells of which a level's plan is broadcast at most; a join by cell beyond.
FEW_CELLS = 100_000


def adaptive_cells(points: DataFrame, most: int) -> DataFrame:
    """(point_id, cell_id): cells of at most ``most`` points, split on x or z at the middle of the longer side, left before right.

    A cell whose middle leaves one side empty (equal points, or neighbouring
    numbers whose middle is one of them) is halved by rank of the id.  Every level
    is one aggregate over the open cells and one map of their points; a cell's path
    of 0s and 1s orders the cells depth first.
    """
    if most < 1:
        raise ValueError("a cell holds one point or more")
    tables, leaves = Tables(points.sparkSession), []
    open_ = tables.cut("open0", points.select("point_id", "x", "z", F.lit("").alias("path")))
    for level in count(1):
        stats = open_.groupBy("path").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("z").alias("z0"), F.max("z").alias("z1"))
        on_x = F.coalesce((F.col("x1") - F.col("x0")) >= (F.col("z1") - F.col("z0")), F.lit(False))
        low, high = (F.when(on_x, F.col(f"x{k}")).otherwise(F.col(f"z{k}")) for k in (0, 1))
        plans = stats.select("path", "n", (F.col("n") <= most).alias("small"), on_x.alias("on_x"), low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid"))
        plans = tables.cut(f"plans{level}", plans.withColumn("flat", ~F.coalesce((F.col("low") < F.col("mid")) & (F.col("high") >= F.col("mid")), F.lit(False))).drop("low", "high"))
        joined = open_.join(F.broadcast(plans) if plans.count() <= FEW_CELLS else plans, "path")
        leaves.append(joined.where("small").select("point_id", "path"))
        if plans.where("NOT small").isEmpty():
            break
        right = F.coalesce(F.when(F.col("on_x"), F.col("x")).otherwise(F.col("z")) < F.col("mid"), F.lit(False))
        parts = joined.where("NOT small AND NOT flat").withColumn("half", F.when(right, "0").otherwise("1"))
        if not plans.where("NOT small AND flat").isEmpty():
            ranked = numbered(joined.where("NOT small AND flat"), "rank", "point_id", by=("path",))
            parts = parts.unionByName(ranked.withColumn("half", F.when(F.col("rank") < F.floor(F.col("n") / 2), "0").otherwise("1")).drop("rank"))
        open_ = tables.cut(f"open{level}", parts.select("point_id", "x", "z", F.concat("path", "half").alias("path")))
    done = reduce(DataFrame.unionByName, leaves)
    return done.join(numbered(done.select("path").distinct(), "cell_id", "path"), "path").select("point_id", "cell_id")


def missing(expected: DataFrame, received: DataFrame, key: str = "image_id") -> DataFrame:
    """Expected rows that weren't received."""
    return expected.join(received.select(key).distinct(), key, "left_anti")


def queue(items: DataFrame) -> DataFrame:
    """Items by distance, first come first at ties (distance, seq)."""
    return items.orderBy("distance", "seq")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, rk, d2): the k nearest vectors of each query, exactly, however many queries there are.

    The queries are dealt by a hash into blocks of about ``block`` rows; each block is
    broadcast and takes one pass over the vectors, so the driver holds one block at a
    time.  Each task hands out its own k best of every query.  Repeated query rows
    are one query.
    """
    asked = cut(queries.select("vec_id", "embedding").distinct())
    n = max(1, -(-asked.count() // block))
    w = Window.partitionBy("query_id").orderBy("d2", "vec_id")

    def found(b: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)) == b).collect()
        shared = vectors.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in rows], np.int64), np.array([r.embedding for r in rows], np.float64)))

        def best(batches):
            """A task's own k + 1 best of each query, over all its batches."""
            ids, q = shared.value
            kept = pd.DataFrame({"row": np.empty(0, np.int64), "d2": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64)})
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                v, names = np.stack(pdf.embedding.to_numpy()).astype(np.float64), pdf.vec_id.to_numpy()
                found = [kept]
                for at in range(0, len(ids), 256):
                    part = q[at : at + 256]
                    d2 = (part * part).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * part @ v.T
                    d2 = np.floor(d2 * 1e6 + 0.5).astype(np.int64)
                    last = np.partition(d2, min(k, d2.shape[1] - 1), axis=1)[:, min(k, d2.shape[1] - 1)]
                    rows, cols = np.nonzero(d2 <= last[:, None])
                    found.append(pd.DataFrame({"row": rows + at, "d2": d2[rows, cols], "vec_id": names[cols]}))
                kept = pd.concat(found).sort_values(["row", "d2", "vec_id"]).groupby("row").head(k + 1)
            yield pd.DataFrame({"query_id": ids[kept["row"].to_numpy()], "vec_id": kept.vec_id.to_numpy(), "d2": kept.d2.to_numpy()})

        pairs = vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, d2 long").where("query_id <> vec_id")
        top = pairs.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("query_id", "vec_id", "rk", "d2")
        if n == 1:
            return top
        top = cut(top)
        shared.unpersist()
        return top

    parts = reduce(DataFrame.unionByName, [found(b) for b in range(n)])
    return parts if n == 1 else parts.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
