"""Camera generators: rows of poses, their depth ranges and matrices."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matrix as M
from .cloud import numbered


def fibonacci(spark: SparkSession, n: int, radius: float = 1.0, target: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(i, x, y, z) of the upper half of n points spread over a sphere; needs two points or more."""
    if n < 2:
        raise ValueError("a sphere needs 2 samples or more")
    y = 1.0 - F.col("id").cast("double") / (n - 1) * 2.0
    turn = F.col("id") * F.lit(math.pi * (3.0 - math.sqrt(5.0)))
    r = F.sqrt(1.0 - y * y)
    return spark.range(n).where(y >= 0).select(F.col("id").alias("i"), (target[0] + radius * r * F.cos(turn)).alias("x"), (target[1] + radius * y).alias("y"), (target[2] + radius * r * F.sin(turn)).alias("z"))


def hemispheres(targets: DataFrame) -> DataFrame:
    """(target_id, i, x, y, z): around each target (target_id, tx, ty, tz, n, radius) the upper half of its n points on a sphere; a target that asks for fewer than two has none."""
    y = 1.0 - F.col("i") / (F.col("n") - 1) * 2.0
    turn = F.col("i") * F.lit(math.pi * (3.0 - math.sqrt(5.0)))
    r = F.sqrt(1.0 - F.col("up") * F.col("up"))
    rows = targets.where("n >= 2").withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 2).cast("int")))).withColumn("up", y)
    placed = {"x": F.col("tx") + F.col("radius") * r * F.cos(turn), "y": F.col("ty") + F.col("radius") * F.col("up"), "z": F.col("tz") + F.col("radius") * r * F.sin(turn)}
    return rows.select("target_id", "i", *(v.alias(c) for c, v in placed.items()))


def overhead(targets: DataFrame) -> DataFrame:
    """(target_id, i, x, y, z): for each target (target_id, tx, ty, tz, n, radius) n equal poses straight above it, for trials."""
    rows = targets.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("target_id", "i", F.col("tx").alias("x"), (F.col("ty") + F.col("radius")).alias("y"), F.col("tz").alias("z"))


def tasks(spark: SparkSession, targets: DataFrame, n: int, radius: float = 1.0) -> DataFrame:
    """(task_id, target_id, i, eye): the first n poses of an oversampled hemisphere around every target (target_id, tx, ty, tz)."""
    poses = fibonacci(spark, max(2 * n, n + 1), radius).where(F.col("i") < n)
    every = targets.crossJoin(F.broadcast(poses)).select("target_id", "i", *((F.col(f"t{c}") + F.col(c)).alias(f"e{c}") for c in "xyz"))  # n poses of each target, as asked for
    return numbered(every, "task_id", "target_id", "i")


def _corners(box: str) -> list[list[Column]]:
    return [[F.col(f"{c}{b}") for c, b in zip("xyz", bits)] for bits in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1))]


def tight_range(eye: list[Column], target: list[Column], padding: float = 1.1) -> tuple[Column, Column]:
    """near and far from the box's corners (columns x0 .. z1) along the view ray."""
    ray = M.normalize(M.minus(target, eye))
    along = [M.dot(M.minus(corner, eye), ray) for corner in _corners("")]
    near = F.greatest(F.least(*along) / padding, F.lit(0.001))
    return near, F.greatest(F.greatest(*along) * padding, near + 0.01)


def up_vector(eye: list[Column], target: list[Column]) -> list[Column]:
    """+y, or +z where the ray is nearly vertical."""
    steep = F.abs(M.normalize(M.minus(target, eye))[1]) > 0.99
    return [F.lit(0.0), F.when(steep, 0.0).otherwise(1.0), F.when(steep, 1.0).otherwise(0.0)]


def perspective_camera(df: DataFrame, eye: list[Column], target: list[Column], width: int, height: int, fov: float = 45.0) -> tuple[DataFrame, dict]:
    """df with the columns of a camera in each row, and that camera: view, projection, their product, near and far; needs the box's columns x0 .. z1."""
    df, (near, far) = M.held(df, "range", list(tight_range(eye, target)))
    df, up = M.held(df, "up", up_vector(eye, target))
    df, z = M.held(df, "back", M.normalize(M.minus(eye, target)))
    df, x = M.held(df, "right", M.normalize(M.cross(up, z)))
    df, y = M.held(df, "over", M.cross(z, x))
    zero, one = M.lit(0, 1)
    view = [x[0], y[0], z[0], zero, x[1], y[1], z[1], zero, x[2], y[2], z[2], zero, -M.dot(x, eye), -M.dot(y, eye), -M.dot(z, eye), one]
    projection = M.perspective(F.lit(math.radians(fov)), F.lit(width / height), near, far)
    return df, {"view": view, "projection": projection, "both": M.multiply(projection, view), "near": near, "far": far, "eye": eye}


def ortho_camera(eye_y: Column, pan_x: Column, pan_z: Column, zoom: Column, width: int, height: int) -> dict:
    """A camera straight down, +z at the top; needs the box's column y0."""
    eye, target = [pan_x, eye_y, pan_z], [pan_x, eye_y - 1, pan_z]
    view = M.look_at(eye, target, M.lit(0, 0, 1))
    near, far = F.lit(0.1), F.greatest(F.lit(1.0), eye_y - F.col("y0") + 1.0)
    aspect = width / height
    half_w, half_h = (zoom, zoom / aspect) if width <= height else (zoom * aspect, zoom)
    projection = M.orthographic(-half_w, half_w, -half_h, half_h, near, far)
    return {"view": view, "projection": projection, "both": M.multiply(projection, view), "near": near, "far": far}


def spherical_camera(eye: list[Column], yaw: float = 0.0) -> dict:
    """A camera on all directions, turned by ``yaw`` degrees; far reaches 5 % beyond the farthest corner of the box."""
    ahead = [eye[0], eye[1], eye[2] - 1]
    view = M.look_at(eye, ahead, M.lit(0, 1, 0))
    if yaw:
        view = M.multiply(M.rotation("y", F.lit(math.radians(yaw))), view)
    reach = [F.sqrt(M.dot(v, v)) for v in (M.minus(c, eye) for c in _corners(""))]
    return {"view": view, "far": F.greatest(F.greatest(*reach) * 1.05, F.lit(0.01))}


def frustum_mesh(q: list[Column], t: list[Column], scale: float = 0.1) -> list[list[Column]]:
    """The five vertices of a camera's pyramid: its centre and the turned corners around it."""
    r, c = M.rotation_of(q), M.camera_center(q, t)
    local = [M.lit(0, 0, 0), *(M.lit(x * scale, y * scale, 2 * scale) for x, y in ((1, 1), (1, -1), (-1, -1), (-1, 1)))]
    return [[M.dot(r[i], p) + c[i] for i in range(3)] for p in local]


def orbit(target: list[Column], radius: Column, yaw: Column, pitch: Column) -> list[Column]:
    """The eye on a sphere around a target."""
    return [target[0] + radius * F.cos(pitch) * F.sin(yaw), target[1] + radius * F.sin(pitch), target[2] + radius * F.cos(pitch) * F.cos(yaw)]


#: Columns of a table of cameras: a view's name, its matrices (16 numbers, column by column: view, projection, their product) and its eye.
CAMERA_SCHEMA = "view int, view_matrix array<double>, projection array<double>, both array<double>, ex double, ey double, ez double"


def fixed_matrices(eye: tuple[float, ...], target: tuple[float, ...], width: int, height: int, fov: float = 45.0, near: float = 0.1, far: float = 1000.0) -> tuple[list[float], list[float], list[float]]:
    """The view matrix, the projection and projection x view of a camera whose numbers are known when a query is built: no job is needed for them."""
    e, t = np.array(eye, float), np.array(target, float)
    z = (e - t) / np.linalg.norm(e - t)
    x = np.cross([0.0, 0.0, 1.0] if abs(z[1]) > 0.99 else [0.0, 1.0, 0.0], z)
    x /= np.linalg.norm(x)
    y = np.cross(z, x)
    view = np.eye(4)
    view[:3, :3], view[:3, 3] = [x, y, z], [-x @ e, -y @ e, -z @ e]
    f = 1 / math.tan(math.radians(fov) / 2)
    projection = np.array([[f / (width / height), 0, 0, 0], [0, f, 0, 0], [0, 0, far / (near - far), far * near / (near - far)], [0, 0, -1, 0]])
    return view.T.ravel().tolist(), projection.T.ravel().tolist(), (projection @ view).T.ravel().tolist()


def fixed_camera(eye: tuple[float, ...], target: tuple[float, ...], width: int, height: int, fov: float = 45.0, near: float = 0.1, far: float = 1000.0) -> dict:
    """One such camera with literal matrices."""
    view, projection, both = fixed_matrices(eye, target, width, height, fov, near, far)
    return {"view": M.lit(*view), "projection": M.lit(*projection), "both": M.lit(*both), "eye": M.lit(*eye)}


def camera_rows(spark: SparkSession, eyes: dict[int, tuple[float, ...]], target: tuple[float, ...], width: int, height: int, fov: float = 45.0, near: float = 0.1, far: float = 1000.0) -> DataFrame:
    """A row of CAMERA_SCHEMA for each view and its eye, all looking at one target."""
    return spark.createDataFrame([(k, *fixed_matrices(e, target, width, height, fov, near, far), *map(float, e)) for k, e in eyes.items()], CAMERA_SCHEMA)


def camera_table(poses: DataFrame, camera: dict, eye: list[Column], view: str = "view") -> DataFrame:
    """A row of CAMERA_SCHEMA for each row of ``poses``, from a camera of columns."""
    return poses.select(F.col(view).cast("int").alias("view"), F.array(*camera["view"]).alias("view_matrix"), F.array(*camera["projection"]).alias("projection"), F.array(*camera["both"]).alias("both"), *(c.alias(f"e{n}") for n, c in zip("xyz", eye)))


def camera_of_row() -> dict:
    """The camera of a row that has the columns of CAMERA_SCHEMA."""
    return {"view": [F.col("view_matrix")[i] for i in range(16)], "projection": [F.col("projection")[i] for i in range(16)], "both": [F.col("both")[i] for i in range(16)], "eye": [F.col(f"e{c}") for c in "xyz"]}


def colmap_pose_rows(cameras: DataFrame) -> DataFrame:
    """(view, q0 .. q3, t0 .. t2): each camera's pose with y down and z forward."""
    df, _, _ = M.colmap_pose(cameras, [F.col("view_matrix")[i] for i in range(16)], [F.col(f"e{c}") for c in "xyz"])
    return df.select("view", *(f"q{i}" for i in range(4)), *(f"t{i}" for i in range(3)))
