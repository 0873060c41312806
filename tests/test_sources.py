"""Round trips of the file formats."""

import struct
import zipfile

import numpy as np
import pandas as pd
import pytest

from voxelmill.sources import colmap, las, ply, png


def test_las_round_trip(spark, tmp_path):
    las.register(spark)
    rows = [(i, 10 * i, -i, i % 19, i * 7 % 65536, 65535, 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, las_class int, red int, green int, blue int")
    df.repartition(3).write.format("las").mode("append").option("pointformat", "7").option("scale", "0.01,0.01,0.01").save(str(tmp_path / "c"))
    back = spark.read.format("las").load(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in back.select("X", "Y", "Z", "las_class", "red", "green", "blue").collect()) == sorted(rows)
    assert back.where("nx IS NOT NULL").count() == 0


@pytest.mark.parametrize("kind", ["0", "3", "7"])
def test_las_normals(spark, tmp_path, kind):
    las.register(spark)
    rows = [(i, -i, 3 * i, i % 19, 1, 2, 3, 0.5, -0.25, i / 8) for i in range(50)]
    df = spark.createDataFrame(rows, "X int, Y int, Z int, las_class int, red int, green int, blue int, nx float, ny float, nz float")
    df.write.format("las").mode("append").option("pointformat", kind).option("normals", "true").save(str(tmp_path / "n"))
    back = spark.read.format("las").load(str(tmp_path / "n")).select("X", "Y", "Z", "las_class", "nx", "ny", "nz")
    assert sorted(tuple(r) for r in back.collect()) == sorted((*r[:4], *r[7:]) for r in rows)


def test_las_header_is_checked():
    with pytest.raises(ValueError):
        las.parse_header(b"LASF" + b"\0" * 100)


def test_repeated_extra_bytes():
    def entry(name):
        return b"\0\0\x09\0" + name.encode().ljust(32, b"\0") + b"\0" * 156

    def record(*names):
        body = b"".join(map(entry, names))
        return struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"") + body

    head = bytearray(las.header_bytes(0, 1, (1,) * 3, (0,) * 3, (0,) * 3, (0,) * 3))
    described = record("nx", "height") + record("height", "ny")
    struct.pack_into("<II", head, 96, len(head) + len(described), 2)
    fixed = las.repaired(bytes(head) + described + b"P" * 20)
    h = las.parse_header(fixed)
    assert list(las.extra_dimensions(fixed)) == ["height"] and fixed[h.data_offset :] == b"P" * 20


@pytest.mark.parametrize("color", [True, False])
def test_ply_round_trip(spark, tmp_path, color):
    pts = pd.DataFrame({"x": [1.0, 2.5], "y": [0.0, -1.0], "z": [3.0, 4.0], "red": [1, 2], "green": [3, 4], "blue": [255, 0]})
    (tmp_path / "a.ply").write_bytes(ply.encode(pts, color))
    rows = ply.read(spark, str(tmp_path)).orderBy("point_id").collect()
    assert [(r.x, r.y, r.z, r.blue) for r in rows] == [(1.0, 0.0, 3.0, 255 if color else None), (2.5, -1.0, 4.0, 0 if color else None)]


def test_ascii_ply():
    raw = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert ply.parse(raw)["z"].tolist() == [3.0, 6.0]


def test_colmap(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 64 48 10 11 32 24\n2 RADIAL 1 1 1 1 1 1\n")
    pose = "{} 1 0 0 0 {} 0 0 1 {}\n"
    (tmp_path / "images.txt").write_text("# i\n" + pose.format(1, 5, "a.png") + "1 2 3 4 5 6 7 8 9 10 11 12\n" + pose.format(2, 6, "b.png") + "\n" + pose.format(3, 7, "a.png") + "\n")
    assert [tuple(r) for r in colmap.read_cameras(spark, str(tmp_path / "cameras.txt")).collect()] == [("1", 64.0, 48.0, 10.0, 11.0, 32.0, 24.0)]
    assert sorted((r.name, r.tx) for r in colmap.read_images(spark, str(tmp_path / "images.txt")).collect()) == [("a.png", 7.0), ("b.png", 6.0)]


def test_sampled_points(spark):
    rows = spark.range(25).selectExpr("id AS idx", "id * 1.0D AS x", "0D AS y", "0D AS z", "1D AS r", "0D AS g", "0D AS b")
    out = colmap.points3d_lines(rows).orderBy("id").collect()
    assert [r.id for r in out] == [0, 1, 2] and out[1].line == "1 10.0 0.0 0.0 255 0 0 0"


@pytest.mark.parametrize("text", ['{"label_to_id": {"a": 3, "b": 1.5}}', '{"a": 3, "b": "x"}'])
def test_class_mapping(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    assert [tuple(r) for r in colmap.class_mapping(spark, str(tmp_path / "m.json")).collect()] == [("a", 3)]


def test_capture_tasks(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"models": [{"lasFile": "a.las", "cameras": [{"eye": [1, 2, 3]}, {"technique": "DISKS"}]}]}')
    rows = colmap.capture_tasks(spark, str(tmp_path / "c.json")).orderBy("camera").collect()
    assert [(r.technique, r.projection, r.pointSize, r.canvasWidth) for r in rows] == [("POINTS", "PERSPECTIVE", 0.2, 1024), ("DISKS", "PERSPECTIVE", 0.2, 1024)]


@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_png_round_trip(spark, tmp_path, kind):
    mask = np.random.default_rng(1).integers(0, 200 if kind == "u1" else 60000, (9, 7)).astype(kind)
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("masks/a.png", png.encode(mask))
    files = png.zip_members(spark, str(tmp_path / "m.zip"))
    got = {(r.px, r.py): r.class_id for r in png.mask_pixels(files).collect()}
    assert got == {(x, y): int(mask[y, x]) for y in range(9) for x in range(7)}


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    want = rng.integers(0, 256, (5, 12)).astype(np.uint8)
    lines, before = [], np.zeros(12, int)
    for row in want.astype(int):
        left = np.r_[[0] * 3, row[:-3]]
        corner = np.r_[[0] * 3, before[:-3]]
        p = left + before - corner
        da, db, dc = abs(p - left), abs(p - before), abs(p - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, before, corner))
        guess = [0 * row, left, before, (left + before) // 2, paeth][kind]
        lines.append((row - guess) % 256)
        before = row
    assert (png.unfiltered(np.array(lines, np.uint8), np.full(5, kind), 3) == want).all()
