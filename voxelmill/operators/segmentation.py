"""Labelling points by votes of segmentation masks, with refinement over voxel neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_COUNT, TOP, CELL, GRID_LIMIT, VOTE_BYTES = 65535, 3, 0.5, 64, 256 << 20


def vote_histogram(hits: DataFrame, n_classes: int | DataFrame | None = None) -> DataFrame:
    """(point_id, class_id, cnt) of hits with a class above 0, and below n_classes where it's given as a number or as the row of n_classes(); counted on the map side before the shuffle."""
    if isinstance(n_classes, DataFrame):
        hits = hits.crossJoin(F.broadcast(n_classes.select(F.col("n_classes").alias("bound")))).where(F.col("class_id") < F.col("bound"))  # one row
    elif n_classes is not None:
        hits = hits.where(F.col("class_id") < n_classes)
    return hits.where(F.col("class_id") > 0).groupBy("point_id", "class_id").agg(F.count("*").alias("cnt"))


def n_classes(mapping: DataFrame) -> DataFrame:
    """Number of classes of a class mapping (class_id): the largest id and one, 128 at least."""
    return mapping.agg(F.greatest(F.lit(128), F.coalesce(F.max("class_id"), F.lit(0)) + 1).cast("long").alias("n_classes"))


def ranked(votes: DataFrame, top: int = TOP) -> DataFrame:
    """Each point's ``top`` classes by votes, capped at 65535; ties go to the lower class.

    A point's votes are counted by class before, so what is gathered for a point is
    one entry for each class, n_classes at most, however many hits it has.
    """
    best = votes.groupBy("point_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("minus"), "class_id"))), 1, top).alias("best"))
    return best.select("point_id", F.posexplode("best").alias("k", "b")).select("point_id", F.col("b.class_id").alias("class_id"), F.least(-F.col("b.minus"), F.lit(MAX_COUNT)).cast("long").alias("cnt"), (F.col("k") + 1).alias("rk"))


def argmax(votes: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, class_id): the class with most votes, the lower one at ties."""
    return votes.groupBy(key).agg(F.max(F.struct("cnt", (-F.col("class_id")).alias("minus"))).alias("m")).select(key, (-F.col("m.minus")).cast("int").alias("class_id"))


def label_simple(points: DataFrame, votes: DataFrame) -> DataFrame:
    """(point_id, class_id) of every point; 0 where it has no vote."""
    return points.select("point_id").join(argmax(votes), "point_id", "left").select("point_id", F.coalesce("class_id", F.lit(0)).alias("class_id"))


def _grid(points: DataFrame, cell: float) -> DataFrame:
    """One row: lower corner, extent and cells of each axis."""
    box = points.agg(*[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))])
    cells = {f"g{c}": F.greatest(F.lit(1), F.least(F.lit(GRID_LIMIT), F.floor((F.col(f"{c}1") - F.col(f"{c}0")) / cell + 0.5))).cast("long") for c in "xyz"}
    return box.withColumns(cells)


def shrunk_grid(grid: DataFrame, classes: int | Column = 128, budget: int = VOTE_BYTES) -> DataFrame:
    """The grid scaled down by a cube root where its vote table (4 bytes for each class and voxel) would exceed the budget."""
    size = F.col("gx") * F.col("gy") * F.col("gz") * classes * 4
    scale = F.when(size > budget, F.cbrt(F.lit(float(budget)) / size)).otherwise(1.0)
    return grid.withColumns({g: F.greatest(F.lit(1), F.floor(F.col(g) * scale)).cast("long") for g in ("gx", "gy", "gz")})


def voxel_of(points: DataFrame, cell: float = CELL, classes: int | DataFrame = 128) -> DataFrame:
    """points with voxel coordinates vx, vy, vz; an axis without extent has coordinate 0; ``classes`` is a number or the row of n_classes()."""
    grid = _grid(points, cell)
    if isinstance(classes, DataFrame):
        grid = shrunk_grid(grid.crossJoin(F.broadcast(classes.select("n_classes"))), F.col("n_classes")).drop("n_classes")  # one row
    else:
        grid = shrunk_grid(grid, classes)
    inside = points.crossJoin(F.broadcast(grid))  # the grid is one row

    def coordinate(c: str) -> Column:
        t = (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0"))
        return F.when(F.col(f"{c}1") > F.col(f"{c}0"), F.least(F.floor(t * F.col(f"g{c}")), F.col(f"g{c}") - 1)).otherwise(0).cast("long")

    return inside.withColumns({f"v{c}": coordinate(c) for c in "xyz"}).select(*points.columns, "vx", "vy", "vz")


def voxel_votes(placed: DataFrame, top: DataFrame) -> DataFrame:
    """(vx, vy, vz, class_id, cnt): one vote of each labelled point, for its first class."""
    return placed.join(top.where("rk = 1").select("point_id", "class_id"), "point_id").groupBy("vx", "vy", "vz", "class_id").agg(F.count("*").alias("cnt"))


def voxel_winner(votes: DataFrame) -> DataFrame:
    """(vx, vy, vz, class_id): a voxel's most frequent class, the lower one at ties."""
    best = votes.groupBy("vx", "vy", "vz").agg(F.max(F.struct("cnt", (-F.col("class_id")).alias("minus"))).alias("m"))
    return best.select("vx", "vy", "vz", (-F.col("m.minus")).cast("int").alias("class_id"))


def spatial_refine(points: DataFrame, votes: DataFrame, cell: float = CELL, classes: int | DataFrame | None = None) -> DataFrame:
    """(point_id, class_id): of a point's three classes, the best by vote share times support in the 27 voxels around.

    The support of a voxel and class is counted once for the voxels, which are
    bounded in number, not once for each point: winners spread to their 27
    neighbours and are summed, and points then look up one row.  The grid is made for
    ``classes``, or for those of the votes where they aren't given.
    """
    placed = voxel_of(points, cell, n_classes(votes) if classes is None else classes)
    top = ranked(votes)
    winners = voxel_winner(voxel_votes(placed, top))
    steps = F.array(*[F.struct(*(F.lit(d).alias(a) for d, a in zip((i, j, k), "xyz"))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    spread = winners.select("*", F.explode(steps).alias("o")).select(*((F.col(f"v{c}") + F.col(f"o.{c}")).alias(f"v{c}") for c in "xyz"), "class_id")
    support = spread.groupBy("vx", "vy", "vz", "class_id").agg(F.count("*").alias("s"))
    total = top.groupBy("point_id").agg((F.sum("cnt") + 1).alias("tot"))
    cand = placed.select("point_id", "vx", "vy", "vz").join(top, "point_id").join(total, "point_id").join(support, ["vx", "vy", "vz", "class_id"], "left")
    score = F.col("cnt").cast("double") / F.col("tot").cast("double") * (F.coalesce("s", F.lit(0)) + 1).cast("double")
    best = cand.groupBy("point_id").agg(F.max(F.struct(score.alias("score"), (-F.col("rk")).alias("minus"), "class_id")).alias("m")).select("point_id", F.col("m.class_id").alias("class_id"))
    return points.select("point_id").join(best, "point_id", "left").select("point_id", F.coalesce("class_id", F.lit(0)).alias("class_id"))


# Segmentation class to survey class; any other class is 1.
SURVEY_CLASSES = {
    2: [48, 49, 50, 58, 71, 97, 110, 150, 92, 155, 86, 91, 133, 90, 113, 84, 87, 57, 118, 121, 122, 75, 76],
    3: [60, 105, 104, 70, 130, 134, 16],
    4: [47],
    5: [171, 80],
    6: [1, 63, 62, 59, 73, 112, 119, 120, 136, 174, 68, 74, 81, 82, 184, 51, 107, 117, 149, 156, 157, 187, 181, 182],
    9: [61, 94],
    18: [40, 41, 83, 185],
}


def survey_class(class_id: Column) -> Column:
    """Survey class of a segmentation class."""
    return reduce(lambda rest, item: F.when(class_id.isin(item[1]), item[0]).otherwise(rest), SURVEY_CLASSES.items(), F.lit(1)).cast("int")


def present_classes(mapping: DataFrame, masks: DataFrame) -> DataFrame:
    """(class_id, name) of mapped classes that occur in the masks, by name."""
    return mapping.join(masks.select("class_id").distinct(), "class_id", "left_semi").orderBy("name")


def votes_of_masks(raster: DataFrame, masks: DataFrame, images: DataFrame, cameras: DataFrame) -> DataFrame:
    """(point_id, class_id) hits: pixels of a point-index raster (view name, px, py, point_id) under mask pixels, of views with a known image and camera."""
    views = images.join(cameras, "camera_id", "left_semi").select("name")
    return masks.join(views, "name", "left_semi").join(raster, ["name", "px", "py"]).select("point_id", "class_id")


def first_class_of_color(winners: DataFrame, palette: DataFrame) -> DataFrame:
    """Winners renamed to the lowest class with the same palette colour (classes that share a colour can't be told apart by it)."""
    w = Window.partitionBy("rgba")
    return winners.join(F.broadcast(palette.select("class_id", F.min("class_id").over(w).alias("first"))), "class_id").select("point_id", F.col("first").alias("class_id"))


def shown_classes(labels: DataFrame, palette: DataFrame) -> DataFrame:
    """labels with the palette's word of their class; a class beyond the palette's 256 takes that of its low byte."""
    words = F.broadcast(palette.select(F.col("class_id").alias("low"), "rgba"))
    return labels.withColumn("low", F.col("class_id").bitwiseAND(F.lit(255))).join(words, "low").drop("low")
