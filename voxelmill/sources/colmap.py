"""COLMAP text models: cameras, images and sampled points, read and written as DataFrames; class maps and capture configs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _words(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("v"))
    return lines.where("v <> '' AND NOT v LIKE '#%'").select(F.split("v", r"\s+").alias("w"))


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Pinhole cameras: camera_id, width, height, fx, fy, cx, cy."""
    w = _words(spark, path).where("w[1] = 'PINHOLE' AND size(w) >= 8")
    return w.select(F.col("w")[0].alias("camera_id"), *(F.col("w")[i + 2].cast("double").alias(c) for i, c in enumerate(("width", "height", "fx", "fy", "cx", "cy"))))


_POSE = "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id string, name string"


def _poses(spark: SparkSession, path: str, each: Callable[[str], Iterator[list[str]]]) -> DataFrame:
    """A row for each pose that ``each`` finds in a file's text, with its file and place; a file is a task."""
    columns = [c.split() for c in _POSE.split(", ")]
    cast = {"int": int, "double": float, "string": str}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [dict(zip([c for c, _ in columns], (cast[k](v) for (_, k), v in zip(columns, w)))) | {"file": file, "place": i} for i, w in enumerate(each(text))]
                kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("place", pa.int64()), *((c, kinds[k]) for c, k in columns)]))

    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return texts.mapInArrow(parse, f"file string, place long, {_POSE}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image poses: every line of ten words or more whose line before isn't one (that would make it a list of 2-D points); of equal names in a file the last."""

    def each(text: str) -> Iterator[list[str]]:
        skip = False
        for line in text.split("\n"):
            line = line.strip()
            if line.startswith("#"):
                continue
            words = line.split()
            if skip:
                skip = False
            elif len(words) >= 10:
                skip = True
                yield words

    columns = [c.split()[0] for c in _POSE.split(", ")]
    rows = _poses(spark, path, each)
    return rows.groupBy("file", "name").agg(F.max_by(F.struct(*columns[:-1]), "place").alias("v")).select("v.*", "name")


def read_images_plain(spark: SparkSession, path: str) -> DataFrame:
    """The poses by the plain rule, with the camera's centre (x, y, z): every line of ten fields or more between single spaces counts, comments aside, and 2-D points aren't told apart.

    A line whose first eight fields aren't numbers is no pose.
    """
    from ..functions import matrix as M

    def each(text: str) -> Iterator[list[str]]:
        for line in text.split("\n"):
            words = line.split(" ")
            if line.startswith("#") or len(words) < 10:
                continue
            try:
                yield [str(int(words[0])), *(str(float(v)) for v in words[1:8]), *words[8:]]
            except ValueError:
                continue

    centre = M.camera_center([F.col(f"q{c}") for c in "wxyz"], [F.col(f"t{c}") for c in "xyz"])
    return _poses(spark, path, each).drop("file", "place").withColumns(dict(zip("xyz", centre)))


def camera_line(camera_id: int | Column, width: Column, height: Column, fx: Column, cx: Column, cy: Column) -> Column:
    return F.concat_ws(" ", camera_id if isinstance(camera_id, Column) else F.lit(camera_id), F.lit("PINHOLE"), width, height, fx, fx, cx, cy)


def image_lines(poses: DataFrame) -> DataFrame:
    """(line) pairs of each pose in id order: the pose, then an empty line."""
    return image_text(poses).orderBy("image_id").select(F.explode(F.array("line", F.lit(""))).alias("line"))


def image_text(poses: DataFrame) -> DataFrame:
    """poses with the ``line`` of each."""
    return poses.withColumn("line", F.concat_ws(" ", "image_id", *(F.col(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")), F.lit(1), "name"))


#: Images whose lines are one piece of a model's file.
BLOCK = 10_000


def image_files(poses: DataFrame, model: str, ending: str = "_images.txt") -> DataFrame:
    """(name, piece, content) of a text of image_lines() for each ``model`` of poses, for format("pieces")."""
    block = F.floor(F.col("image_id") / BLOCK)
    lines = F.sort_array(F.collect_list(F.struct("image_id", "line")))  # as many as a block has ids
    whole = F.concat(F.array_join(F.transform(lines, lambda v: v["line"]), "\n\n"), F.lit("\n\n"))
    return image_text(poses).groupBy(F.concat(F.col(model), F.lit(ending)).alias("name"), block.alias("piece")).agg(F.encode(whole, "utf-8").alias("content"))


def points3d_lines(points: DataFrame, step: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, line) of every step-th point (idx, x, y, z, r, g, b), colours as bytes, error 0."""
    byte = [F.floor(F.col(c) * 255 + 0.5).cast("int") for c in "rgb"]
    kept = points.where(F.col("idx") % step == 0).withColumn("id", F.floor(F.col("idx") / step).cast("long"))
    return kept.select(*keys, "id", F.concat_ws(" ", "id", "x", "y", "z", *byte, F.lit(0)).alias("line"))


def class_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, class_id) of a class map, bare or under label_to_id; values that aren't whole numbers are passed over."""
    text = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", "map<string, string>")
    inner = F.from_json(F.get_json_object("value", "$.label_to_id"), "map<string, string>")
    pairs = text.select(F.explode(F.coalesce(inner, bare)).alias("name", "id"))
    return pairs.where(F.col("id").rlike(r"^-?\d+$")).select("name", F.col("id").cast("int").alias("class_id"))


CONFIG = """canvasWidth int, canvasHeight int, outputZipName string, models array<struct<lasFile: string, cameras: array<struct<
    eye: array<double>, target: array<double>, projection: string, technique: string, eyeY: double, panX: double, panZ: double, zoom: double,
    yawDeg: double, fovDeg: double, pointSize: double, useReconstruction: boolean>>>>"""


def capture_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each camera of each model of a capture config, with defaults filled in."""
    c = spark.read.schema(CONFIG).option("multiLine", True).json(path)
    rows = c.select("canvasWidth", "canvasHeight", F.posexplode("models").alias("model", "m")).select("*", F.posexplode("m.cameras").alias("camera", "c")).select("canvasWidth", "canvasHeight", "model", F.col("m.lasFile").alias("lasFile"), "camera", "c.*")
    filled = {"canvasWidth": 1024, "canvasHeight": 512, "projection": "PERSPECTIVE", "technique": "POINTS", "pointSize": 0.2, "useReconstruction": True, "fovDeg": 45.0}
    return rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in filled.items()})


def image_name(index: Column, target: Column) -> Column:
    """image_{index + 1}_{target, joined by _}.png"""
    return F.concat(F.lit("image_"), (index + 1).cast("string"), F.lit("_"), F.array_join(target.cast("array<string>"), "_"), F.lit(".png"))


def classified_name(path: Column) -> Column:
    return F.regexp_replace(path, r"\.la[sz]$", "_classified.las")
