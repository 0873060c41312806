"""Queries that write files and read them back: clouds, models, images, archives."""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import cloud
from ..operators.tables import shared_folder
from ..sources import archives, bitmaps, colmap, files, jpeg, las, ply, png
from .views import POINTS, RASTER, micro, micros, points, raster, table


def _folder(spark) -> str:
    files.register(spark)
    las.register(spark)
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _survey(spark, d):
    whole = {c.upper(): F.rint(F.col(c) * 1000).cast("int") for c in "xyz"}
    return points(spark, d).withColumns({**whole, "red": (F.col("point_id") % 65536).cast("int"), "green": F.lit(7), "blue": F.lit(65535)})


def _written(spark, d, **options):
    path = _folder(spark)
    _survey(spark, d).write.format("las").mode("append").options(**options).save(path)
    return path


def las_files(spark, d):
    """Colours, classes and decoded coordinates of a cloud that was written as survey files, several at once."""
    path = _written(spark, d, pointformat="7", scale="0.001,0.001,0.001")
    raw = las.read_ranges(spark, path, rows=1000).withColumns({f"i{c}": F.col(c.upper()) for c in "xyz"})
    back = geometry.decoded(raw, (0.001,) * 3, (0.0,) * 3)
    return back.select("ix", "iy", "iz", "las_class", "red", "blue", *(micros(F.col(c)).alias(f"scene_{c}") for c in "xyz"))


def las_anywhere(spark, d):
    """The same files by Spark's own reader, with as many different ids as points."""
    back = las.read_anywhere(spark, _written(spark, d, pointformat="3"))
    return back.groupBy("las_class").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.sum("X").alias("x"), F.sum("red").alias("red"))


def las_normals(spark, d):
    """Normals that were written as extra bytes."""
    path = _folder(spark)
    _survey(spark, d).withColumns({f"n{c}": (F.col(c.upper()) / 1000.0).cast("float") for c in "xyz"}).write.format("las").mode("append").option("normals", "true").save(path)
    return spark.read.format("las").load(path).select("X", "Y", "Z", "las_class", *(micros(F.col(c).cast("double")).alias(c) for c in ("nx", "ny", "nz")))


def las_repaired(spark, d):
    """Normals of files whose description of extra bytes stands twice, as they are and mended: both read by ranges."""
    path, broken, mended = _folder(spark), _folder(spark), _folder(spark)
    _survey(spark, d).withColumns({f"n{c}": (F.col(c.upper()) / 1000.0).cast("float") for c in "xyz"}).write.format("las").mode("append").option("normals", "true").save(path)

    def twice(head):
        body = head[las.HEADER_BYTES :]
        return head[:96] + struct.pack("<II", len(head) + len(body), 2) + head[104:] + body

    def put(raw, change, out):
        def pieces(batches):
            for b in batches:
                heads = [change(bytes(v)) if v is not None else b"" for v in b["head"]]
                yield pd.DataFrame({"name": [os.path.basename(p) for p in b.path], "piece": b["first"], "content": [h + bytes(r) + bytes(t or b"") for h, r, t in zip(heads, b.records, b["tail"])]})

        raw.mapInPandas(pieces, "name string, piece long, content binary").transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)

    put(spark.read.format("las_raw").load(path), twice, broken)
    put(spark.read.format("las_raw").option("repair", "").load(broken), bytes, mended)

    def records(raw):
        """How many records each file's header says to stand before its points (below 256)."""
        return raw.where("head IS NOT NULL").select(F.conv(F.hex(F.substring("head", 101, 1)), 16, 10).cast("int").alias("described"))

    out = None
    for kind, folder in (("broken", broken), ("mended", mended)):
        n = records(spark.read.format("las_raw").load(folder)).agg(F.min("described").alias("described"))
        back = spark.read.format("las").load(folder).crossJoin(F.broadcast(n))  # one row
        back = back.select(F.lit(kind).alias("kind"), "described", "X", "Y", "Z", *(micros(F.col(c).cast("double")).alias(c) for c in ("nx", "ny", "nz")))
        out = back if out is None else out.unionByName(back)
    return out


def las_classified(spark, d):
    """Files whose class bytes were overwritten, all other bytes kept; every ninth point keeps its class."""
    path, out = _written(spark, d, pointformat="3"), _folder(spark)
    labels = spark.read.format("las").load(path).where("X % 9 > 0").select("point_id", (F.col("X") % 31).cast("int").alias("class_id"))
    raw = spark.read.format("las_raw").load(path)
    las.classified(raw, labels).transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    return spark.read.format("las").load(out).select("X", "Y", "Z", "las_class", "red")


def las_thinned(spark, d):
    """Files with some of their points under their own header."""
    path, out = _written(spark, d, pointformat="3"), _folder(spark)
    kept = spark.read.format("las").load(path).where("X % 3 = 0").select("point_id")
    las.thinned(spark.read.format("las_raw").load(path), kept).transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    return spark.read.format("las").load(out).select("X", "Y", "Z", "las_class", "red")


def ply_files(spark, d):
    """Two vertex files with byte colours, written piece by piece."""
    out = _folder(spark)
    k = F.col("point_id")
    named = points(spark, d).withColumns({"name": F.format_string("part%d.ply", k % 2), "red": (k % 256).cast("int"), "green": F.lit(3), "blue": (k % 7).cast("int")})
    ply.pieces(named, True).transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    return ply.read_ranges(spark, out, 1000).select(*(micros(F.col(c)).alias(c) for c in "xyz"), "red", "green", "blue")


def ply_texts(spark, d):
    """A text file of vertices and faces, read in ranges of 10,000 bytes: as many ids as vertices, from 0."""
    out, n = _folder(spark), points(spark, d).count()
    lines = points(spark, d).select(F.concat_ws(" ", "x", "y", "z", (F.col("point_id") % 256), F.lit(1), F.lit(2)).alias("line"), F.col("point_id").alias("piece"))
    head_ = f"ply\nformat ascii 1.0\nelement vertex {n}\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "element face 2\nproperty list uchar int vertex_indices\nend_header\n"
    ends = spark.createDataFrame([(head_, -1), ("3 0 1 2\n3 1 2 3\n", 1 << 40)], "line string, piece long")
    pieces = ply.text_pieces(lines, "cloud.ply").unionByName(ends.select(F.lit("cloud.ply").alias("name"), "piece", F.encode("line", "utf-8").alias("content")))
    pieces.transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    back = ply.read_ranges(spark, out, range_bytes=10_000)
    return back.groupBy("red", "green", "blue").agg(F.count("*").alias("n"), F.countDistinct("point_id").alias("ids"), F.max(F.col("point_id") < n).alias("within"), *(micros(F.sum(c)).alias(c) for c in "xyz"))


def ply_to_las(spark, d):
    """Vertices as survey files, colours in 16 bits."""
    out, to = _folder(spark), _folder(spark)
    named = points(spark, d).withColumns({"name": F.format_string("part%d.ply", F.col("point_id") % 4), "red": (F.col("point_id") % 256).cast("int"), "green": F.lit(3), "blue": F.lit(255)})
    ply.pieces(named, True).transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    ply.to_survey(ply.read_ranges(spark, out)).write.format("las").mode("append").option("pointformat", "3").save(to)
    return spark.read.format("las").load(to).select("X", "Y", "Z", "las_class", "red", "green", "blue")


def _put(spark, pieces, ending: str) -> str:
    """Pieces written as files of a folder; where they are."""
    out = _folder(spark)
    pieces.transform(files.by_file("name", "piece")).write.format("pieces").mode("append").save(out)
    return f"{out}/*{ending}"


def _texts(rows, name, text):
    """Pieces of a file for each row."""
    return rows.select(name.alias("name"), F.lit(0).cast("long").alias("piece"), F.encode(text, "utf-8").alias("content"))


def side_cars(spark, d):
    """Origin and scale of each survey class's part of the cloud, as they were written beside it."""
    clouds = points(spark, d).groupBy("las_class").agg(F.array(*(F.min(c) for c in "xyz")).alias("origin"))
    clouds = clouds.select(F.format_string("class%d", "las_class").alias("cloud"), "origin", (F.lit(1000.0) + F.col("las_class")).alias("position_scale"), (F.col("las_class") % 2 == 1).alias("has_color"))
    back = ply.read_side_car(spark, _put(spark, ply.side_cars(clouds, "cloud"), ".json"))
    return back.select(*(micros(F.col("origin")[i]).alias(c) for i, c in enumerate("xyz")), "position_scale", "has_color")


def model_cameras(spark, d):
    """The pinhole camera of each customer's model; other models and comments are passed over."""
    path, k = f"{_folder(spark)}/cameras", F.col("c_custkey")
    pinhole = colmap.camera_line(k, *(F.lit(v) for v in (1024, 512)), F.lit(600.0) + k / 4, F.lit(512.0), F.lit(256.0))
    lines = F.array(pinhole, F.lit("# cameras"), F.lit(""), F.concat_ws(" ", k, F.lit("RADIAL 1 1 1 1 1 1")))
    table(spark, d, "customer").select(F.explode(lines).alias("value")).write.text(path)
    return colmap.read_cameras(spark, path)


def _images(spark, d):
    """A pose for each customer, in a model for each nation."""
    k = F.col("c_custkey")
    poses = table(spark, d, "customer").select(
        F.format_string("nation%d", "c_nationkey").alias("model"), (k + 1).cast("int").alias("image_id"), F.lit(1.0).alias("qw"), *(F.lit(0.0).alias(f"q{c}") for c in "xyz"),
        (k * 0.5).alias("tx"), (k * 0.25).alias("ty"), (-k).cast("double").alias("tz"), F.format_string("v%d.png", k % 30).alias("name"),
    )
    return _put(spark, colmap.image_files(poses, "model"), "_images.txt")


def model_images(spark, d):
    """Poses of written models; of equal names in a model the last."""
    return colmap.read_images(spark, _images(spark, d)).select("image_id", "camera_id", "name", *(micros(F.col(f"t{c}")).alias(f"t{c}") for c in "xyz"))


def model_centres(spark, d):
    """Camera centres of the same files by the plain rule."""
    return colmap.read_images_plain(spark, _images(spark, d)).select("image_id", "name", *(micros(F.col(c)).alias(c) for c in "xyz"))


def model_points(spark, d):
    """Every tenth point of a written model."""
    path = f"{_folder(spark)}/points"
    p = points(spark, d).select(F.col("point_id").alias("idx"), *"xyz", (F.col("x") / 6).alias("r"), (F.col("y") / 5).alias("g"), (F.col("z") / 5).alias("b"))
    colmap.points3d_lines(p).select(F.col("line").alias("value")).write.text(path)
    w = spark.read.text(path).select(F.split("value", " ").alias("w"))
    return w.select(F.col("w")[0].cast("long").alias("id"), *(micros(F.col("w")[i + 1].cast("double")).alias(c) for i, c in enumerate("xyz")), *(F.col("w")[i + 4].cast("int").alias(c) for i, c in enumerate("rgb")), F.col("w")[7].cast("int").alias("error"))


def class_maps(spark, d):
    """Whole class numbers of a map for each region, bare or not, and how many classes there are."""
    from ..operators import segmentation as S

    number = F.when(F.col("n_nationkey") % 7 == 3, "1.5").otherwise((F.col("n_nationkey") * 8).cast("string"))
    maps = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", number))).alias("m"))  # a region's nations
    text = F.when(F.col("n_regionkey") % 2 == 0, F.to_json("m")).otherwise(F.to_json(F.struct(F.col("m").alias("label_to_id"))))
    found = colmap.class_mapping(spark, _put(spark, _texts(maps, F.format_string("map%d.json", "n_regionkey"), text), ".json"))
    return found.crossJoin(F.broadcast(S.n_classes(found)))  # one row


def capture_tasks(spark, d):
    """Cameras of a capture config for each nation, its suppliers', with defaults."""
    k = F.col("s_suppkey")
    camera = F.struct(k, F.when(k % 2 == 0, F.array(k.cast("double"), F.lit(2.0), F.lit(3.0))).alias("eye"), F.when(k % 3 == 0, "DISKS").alias("technique"), F.when(k % 5 == 0, k / 8).alias("pointSize"), F.when(k % 7 == 0, False).alias("useReconstruction"))
    own = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.sort_array(F.collect_list(camera)).alias("cameras"))  # a config's cameras
    models = F.array(F.struct(F.format_string("n%d.las", "s_nationkey").alias("lasFile"), F.transform("cameras", lambda c: c.dropFields("s_suppkey")).alias("cameras")))
    text = F.to_json(F.struct(F.when(F.col("s_nationkey") % 2 == 0, 640).alias("canvasWidth"), models.alias("models")))
    path = _put(spark, _texts(own, F.format_string("config%d.json", "s_nationkey"), text), ".json")
    return colmap.capture_tasks(spark, path).select("model", "camera", "lasFile", "canvasWidth", "canvasHeight", "projection", "technique", "pointSize", "useReconstruction", micros(F.col("eye")[0]).alias("ex"))


def image_archives(spark, d):
    """Masks of five levels as images in an archive of each level, and read back from there; other members are passed over."""
    out = _folder(spark)
    r = raster(spark, d).select("px", "py", F.col("v").alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"), F.col("al").alias("a"))
    drawn = png.images(cloud.masked_levels(r), ("percent",))
    members = drawn.select(F.format_string("level%d.zip", "percent").alias("archive"), F.explode(F.array(F.lit("images/a.png"), F.lit("notes.txt"))).alias("name"), "content")
    members.transform(files.by_file("archive", "name")).write.format("zips").mode("append").save(out)
    found = png.mask_pixels(png.zip_members(spark, f"{out}/*.zip", (".png", ".jpg")).withColumn("name", F.regexp_extract("archive", r"level(\d+)", 1)))
    return found.select(F.col("name").cast("int").alias("percent"), "px", "py", F.col("class_id").alias("red"))


#: Bits, colours in a palette, interlacing and filters of the files that mask_kinds writes.
KINDS = {"grey1": (1, 0, False, (0,)), "grey2": (2, 0, True, (1, 2)), "grey4": (4, 0, False, (4,)), "colour2": (2, 4, False, (0,)), "colour8": (8, 256, True, (3,)), "grey8": (8, 0, False, (0, 1, 2, 3, 4)), "grey16": (16, 0, True, (4, 3, 2, 1, 0))}


def mask_kinds(spark, d):
    """Masks of the raster's values in files of several depths, palettes and filters, plain and interlaced, read back."""
    values = raster(spark, d).select("px", "py", F.floor(F.col("v") * 8 + F.col("px") * F.col("py")).cast("int").alias("n"))
    kinds = spark.createDataFrame([(k, depth) for k, (depth, *_) in KINDS.items()], "kind string, depth int")

    def write(pdf):
        depth, colours, interlaced, filters = KINDS[pdf.kind.iloc[0]]
        mask = np.zeros((int(pdf.py.max()) + 1, int(pdf.px.max()) + 1), np.int64)
        mask[pdf.py, pdf.px] = pdf.n % (1 << depth)
        palette = np.stack([255 - np.arange(colours), np.arange(colours), np.zeros(colours)], axis=1) if colours else None
        return pd.DataFrame({"name": pdf.kind.iloc[:1], "content": [png.encode(mask, depth, palette, interlaced, filters)]})

    drawn = values.crossJoin(F.broadcast(kinds)).groupBy("kind").applyInPandas(write, "name string, content binary")  # seven kinds of one image
    return png.mask_pixels(drawn)


def photo_pixels(spark, d):
    """Five grey photos of the raster, darker by the first, each 8 x 8 pixels as its first one (which a photo's coding keeps), in an archive of photos and drawings, and read back."""
    values = raster(spark, d).select("px", "py", F.col("v")).crossJoin(F.broadcast(spark.range(1, 6).withColumnRenamed("id", "k")))  # five photos of one image

    def draw(pdf):
        grey = np.zeros((int(pdf.py.max()) + 1, int(pdf.px.max()) + 1), np.uint8)
        grey[pdf.py, pdf.px] = np.floor(pdf.v * 51.0 * pdf.k)
        blocks = grey[::8, ::8].repeat(8, axis=0).repeat(8, axis=1)
        k = int(pdf.k.iloc[0])
        kinds = [(f"photo{k}.JPG", jpeg.encode(blocks, restart=k)), (f"drawing{k}.png", png.encode(grey))]
        return pd.DataFrame({"archive": "all.zip", "name": [n for n, _ in kinds], "piece": 0, "content": [c for _, c in kinds]})

    out = _folder(spark)
    archives.write(values.groupBy("k").applyInPandas(draw, "archive string, name string, piece long, content binary"), out)
    found = bitmaps.pixels(archives.contents(archives.entries(spark, f"{out}/*.zip", (".jpg", ".png"))))
    return found.select(F.split("name", r"\.")[0].alias("name"), "px", "py", *(F.rint(F.col(c) * 255).cast("int").alias(c) for c in "rgba"))


def model_bundles(spark, d):
    """An archive for each nation's model, of an image of the raster and the texts of its cameras, poses and points, read back by their directories: members, lines and, for images, lit pixels."""
    k, model = F.col("c_custkey"), lambda c: F.format_string("nation%d", c)
    nations = table(spark, d, "nation").select("n_nationkey", model("n_nationkey").alias("model"))
    r = raster(spark, d).select("px", "py", F.col("v").alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"), F.col("al").alias("a"))
    images = png.images(r.withColumn("view_id", F.lit(0))).crossJoin(F.broadcast(nations)).select("model", F.concat("model", F.lit(".png")).alias("name"), "content")  # 25 nations
    cameras = nations.select("model", colmap.camera_line(F.col("n_nationkey"), F.lit(64), F.lit(64), F.lit(50.5), F.lit(32.0), F.lit(32.0)).alias("line"))
    poses = table(spark, d, "customer").select(model("c_nationkey").alias("model"), (k + 1).cast("int").alias("image_id"), F.lit(1.0).alias("qw"), *(F.lit(0.0).alias(f"q{c}") for c in "xyz"), *((k * m).cast("double").alias(f"t{c}") for c, m in zip("xyz", (1, 2, 3))), F.format_string("v%d.png", k).alias("name"))
    cloud_ = points(spark, d).select(model(F.col("point_id") % 25).alias("model"), F.col("point_id").alias("idx"), *"xyz", *(F.lit(0.5).alias(c) for c in "rgb"))
    out = _folder(spark)
    archives.write(archives.bundles(images, cameras, poses, cloud_), out)
    found = archives.contents(archives.entries(spark, f"{out}/*.zip", (".txt", ".png"))).withColumn("model", F.regexp_extract("archive", r"(\w+)\.zip", 1))
    texts = found.where("name LIKE '%.txt'").select("model", "name", F.size(F.filter(F.split(F.decode("content", "utf-8"), "\n"), lambda v: v != "")).cast("long").alias("n"))
    lit = png.mask_pixels(found.where("name LIKE '%.png'").select(F.concat_ws("/", "model", "name").alias("name"), "content")).where("class_id > 0").groupBy("name").agg(F.count("*").alias("n"))
    return texts.unionByName(lit.select(F.split("name", "/")[0].alias("model"), F.expr("substr(name, instr(name, '/') + 1)").alias("name"), "n"))


def debug_images(spark, d):
    """A debugging image's green channel, by its own scale."""
    r = raster(spark, d).select("px", "py", F.col("v").alias("r"), (F.col("px") / 64.0).alias("g"), F.col("al").alias("b"))
    shown = png.debug_pixels(r, "normalised").withColumns({"r": F.col("g"), "view_id": F.lit(0)})
    return png.mask_pixels(png.images(shown).withColumn("name", F.lit("debug"))).select("px", "py", F.col("class_id").alias("green"))


QUERIES = {f.__name__: f for f in (las_files, las_anywhere, las_normals, las_repaired, las_classified, las_thinned, ply_files, ply_texts, ply_to_las, side_cars, model_cameras, model_images, model_centres, model_points, class_maps, capture_tasks, image_archives, mask_kinds, photo_pixels, model_bundles, debug_images)}
_S = f"{POINTS}, s AS (SELECT point_id, {', '.join(f'CAST(round_even({c} * 1000, 0) AS INT) AS i{c}' for c in 'xyz')}, x, y, z, las_class, CAST(point_id % 65536 AS INT) AS red FROM points)"
_XYZ = "ix AS X, iy AS Y, iz AS Z"
ORACLE_SQL = {
    "las_files": f"WITH {_S} SELECT ix, iy, iz, las_class, red, 65535 AS blue, {micro('ix * 0.001e0')} AS scene_x, {micro('iz * 0.001e0')} AS scene_y, {micro('-iy * 0.001e0')} AS scene_z FROM s",
    "las_anywhere": f"WITH {_S} SELECT las_class, COUNT(*) AS n, COUNT(*) AS ids, CAST(SUM(ix) AS BIGINT) AS x, CAST(SUM(red) AS BIGINT) AS red FROM s GROUP BY las_class",
    "las_normals": f"WITH {_S} SELECT {_XYZ}, las_class, {', '.join(micro(f'CAST(CAST(i{c} / 1000e0 AS FLOAT) AS DOUBLE)') + f' AS n{c}' for c in 'xyz')} FROM s",
    "las_repaired": f"WITH {_S} SELECT kind, described, {_XYZ}, {', '.join(micro(f'CAST(CAST(i{c} / 1000e0 AS FLOAT) AS DOUBLE)') + f' AS n{c}' for c in 'xyz')} FROM s, (VALUES ('broken', 2), ('mended', 1)) k(kind, described)",
    "ply_texts": f"WITH {POINTS} SELECT CAST(point_id % 256 AS INT) AS red, 1 AS green, 2 AS blue, COUNT(*) AS n, COUNT(*) AS ids, TRUE AS within, {', '.join(f'{micro(f'SUM({c})')} AS {c}' for c in 'xyz')} FROM points GROUP BY 1",
    "las_classified": f"WITH {_S} SELECT {_XYZ}, CASE WHEN ix % 9 > 0 THEN ix % 31 ELSE las_class END AS las_class, red FROM s",
    "las_thinned": f"WITH {_S} SELECT {_XYZ}, las_class, red FROM s WHERE ix % 3 = 0",
    "ply_files": f"WITH {POINTS} SELECT {', '.join(micro(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)') + f' AS {c}' for c in 'xyz')}, CAST(point_id % 256 AS INT) AS red, 3 AS green, CAST(point_id % 7 AS INT) AS blue FROM points",
    "ply_to_las": f"WITH {POINTS} SELECT {', '.join(f'CAST(round_even(CAST(CAST({c} AS FLOAT) AS DOUBLE) / 0.001e0, 0) AS INT) AS {c.upper()}' for c in 'xyz')}, 0 AS las_class, CAST(point_id % 256 * 257 AS INT) AS red, 771 AS green, 65535 AS blue FROM points",
    "side_cars": f"WITH {POINTS} SELECT {', '.join(micro(f'MIN({c})') + f' AS {c}' for c in 'xyz')}, 1000e0 + las_class AS position_scale, las_class % 2 = 1 AS has_color FROM points GROUP BY las_class",
    "model_cameras": "SELECT CAST(c_custkey AS VARCHAR) AS camera_id, 1024e0 AS width, 512e0 AS height, 600e0 + c_custkey / 4e0 AS fx, 600e0 + c_custkey / 4e0 AS fy, 512e0 AS cx, 256e0 AS cy FROM customer",
    "model_images": "SELECT CAST(max(k) + 1 AS INT) AS image_id, '1' AS camera_id, name, CAST(max(k) * 500000 AS BIGINT) AS tx, CAST(max(k) * 250000 AS BIGINT) AS ty, CAST(-max(k) * 1000000 AS BIGINT) AS tz FROM (SELECT c_custkey AS k, c_nationkey, 'v' || (c_custkey % 30) || '.png' AS name FROM customer) c GROUP BY c_nationkey, name",
    "model_centres": "SELECT CAST(c_custkey + 1 AS INT) AS image_id, 'v' || (c_custkey % 30) || '.png' AS name, CAST(-c_custkey * 500000 AS BIGINT) AS x, CAST(-c_custkey * 250000 AS BIGINT) AS y, CAST(c_custkey * 1000000 AS BIGINT) AS z FROM customer",
    "model_points": f"WITH {POINTS} SELECT point_id // 10 AS id, {', '.join(f'{micro(c)} AS {c}' for c in 'xyz')}, {', '.join(f'CAST(FLOOR({c} / {m}e0 * 255 + 0.5e0) AS INT) AS {n}' for c, m, n in (('x', 6, 'r'), ('y', 5, 'g'), ('z', 5, 'b')))}, 0 AS error FROM points WHERE point_id % 10 = 0",
    "class_maps": "SELECT n_name AS name, CAST(n_nationkey * 8 AS INT) AS class_id, GREATEST(128, (SELECT max(n_nationkey * 8) + 1 FROM nation WHERE n_nationkey % 7 <> 3)) AS n_classes FROM nation WHERE n_nationkey % 7 <> 3",
    "capture_tasks": """SELECT 0 AS model, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS camera, 'n' || s_nationkey || '.las' AS lasFile, CASE WHEN s_nationkey % 2 = 0 THEN 640 ELSE 1024 END AS canvasWidth, 512 AS canvasHeight, 'PERSPECTIVE' AS projection,
        CASE WHEN s_suppkey % 3 = 0 THEN 'DISKS' ELSE 'POINTS' END AS technique, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey / 8e0 ELSE 0.2e0 END AS pointSize, s_suppkey % 7 <> 0 AS useReconstruction, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 1000000 AS BIGINT) END AS ex FROM supplier""",
    "mask_kinds": f"""WITH {RASTER}, n AS (SELECT px, py, CAST(FLOOR(v * 8 + px * py) AS BIGINT) AS n FROM raster)
        SELECT name, px, py, CAST(CASE WHEN colours > 0 THEN 255 - n % (1 << depth) WHEN depth < 8 THEN n % (1 << depth) * (255 // ((1 << depth) - 1)) ELSE n % (1 << depth) END AS INT) AS class_id
        FROM n, (VALUES {', '.join(f"('{k}', {depth}, {colours})" for k, (depth, colours, *_) in KINDS.items())}) k(name, depth, colours)""",
    "photo_pixels": f"""WITH {RASTER}, g AS (SELECT px, py, k.range AS k, CAST(FLOOR(v * 51e0 * k.range) AS INT) AS v FROM raster, range(1, 6) k)
        SELECT 'drawing' || k AS name, px, py, v AS r, v AS g, v AS b, 255 AS a FROM g UNION ALL SELECT 'photo' || g.k, g.px, g.py, f.v, f.v, f.v, 255 FROM g JOIN g f ON f.k = g.k AND f.px = g.px // 8 * 8 AND f.py = g.py // 8 * 8""",
    "model_bundles": f"""WITH {RASTER}, m AS (SELECT 'nation' || n_nationkey AS model, n_nationkey FROM nation) SELECT model, 'cameras.txt' AS name, CAST(1 AS BIGINT) AS n FROM m
        UNION ALL SELECT 'nation' || c_nationkey, 'images.txt', COUNT(*) FROM customer GROUP BY c_nationkey UNION ALL SELECT 'nation' || (point_id % 25), 'points3D.txt', COUNT(*) FROM points WHERE point_id % 10 = 0 GROUP BY point_id % 25
        UNION ALL SELECT model, 'images/' || model || '.png', (SELECT COUNT(*) FROM raster WHERE FLOOR(v * 255e0) > 0) FROM m""",
    "image_archives": f"WITH {RASTER} SELECT CAST(p.percent AS INT) AS percent, px, py, CAST(FLOOR(v * 255e0) AS INT) AS red FROM raster, (VALUES (50), (80), (90), (95), (99)) p(percent)",
    "debug_images": f"WITH {RASTER} SELECT px, py, CAST(FLOOR(FLOOR(px / 64e0 * 100e0) / 255e0 * 255e0) AS INT) AS green FROM raster",
}
