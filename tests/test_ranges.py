"""Vertex files in many ranges against the reader that takes a file whole."""

import random

import numpy as np
import pandas as pd
import pytest

from voxelmill.sources import ply


def text_file(rng, n, color, faces, end="\n", more=""):
    names = "".join(f"property double {c}\n" for c in "xyz") + ("".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) if color else "")
    rows = [" ".join(f"{rng.uniform(-9, 9):.{rng.randint(0, 9)}f}" for _ in range(3)) + (f" {rng.randint(0, 255)} 2 3" if color else "") + more for _ in range(n)]
    return (f"ply\nformat ascii 1.0\ncomment made up\nelement vertex {n}\n{names}element face {faces}\nproperty list uchar int vertex_indices\nend_header\n" + end.join([*rows, *["3 0 1 2"] * faces]) + end * bool(n + faces)).encode()


@pytest.mark.parametrize("rows,range_bytes", [(1, 7), (3, 64), (100, 1000), (10**6, 10**6)])
def test_ids_and_vertices_are_those_of_the_whole_file(spark, tmp_path, rows, range_bytes):
    rng = random.Random(rows)
    files = {"a.ply": text_file(rng, 23, True, 2), "b.ply": text_file(rng, 5, False, 0, "\r\n"), "c.ply": text_file(rng, 0, False, 1), "d.ply": text_file(rng, 9, False, 3, more=" 7 8"), "e.ply": text_file(rng, 11, True, 0).rstrip(b"\n")}
    for k, (n, color) in enumerate(((17, True), (1, False), (0, True))):
        points = pd.DataFrame(np.random.default_rng(k).uniform(-5, 5, (n, 3)), columns=list("xyz")).assign(red=1, green=2, blue=k)
        files[f"f{k}.ply"] = ply.encode(points, color) + b"trailing bytes"
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = ply.read_ranges(spark, str(tmp_path), rows, range_bytes)
    key = lambda r: (r.path, r.point_id)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, ply.read(spark, str(tmp_path)).collect()), key=str)
    if rows == 1:
        parts = got.where("path LIKE '%a.ply'").selectExpr("spark_partition_id() AS p").distinct().count()
        assert parts > 1 and len({key(r) for r in got.collect()}) == got.count()


def test_no_files_and_bad_ones(spark, tmp_path):
    (tmp_path / "not.txt").write_bytes(b"x")
    assert ply.read_ranges(spark, str(tmp_path)).count() == 0
    (tmp_path / "big.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty float x\nend_header\n")
    with pytest.raises(Exception, match="binary_big_endian"):
        ply.read_ranges(spark, str(tmp_path)).collect()


def test_survey_files_in_ranges(spark, tmp_path):
    from voxelmill.sources import las

    las.register(spark)
    points = spark.range(500).selectExpr("cast(id AS int) AS X", "cast(id * 2 AS int) AS Y", "cast(-id AS int) AS Z", "cast(id % 30 AS int) AS las_class", "cast(id AS int) AS red", "7 AS green", "9 AS blue", "cast(id AS float) AS nx", "cast(0 AS float) AS ny", "cast(1 AS float) AS nz")
    points.repartition(3).write.format("las").mode("append").option("pointformat", "3").option("normals", "true").save(str(tmp_path))
    (tmp_path / "short.las").write_bytes(next(tmp_path.glob("part*.las")).read_bytes()[:300])  # a header that promises more than there is
    want = sorted(map(tuple, spark.read.format("las").load(str(tmp_path)).select("point_id", "X", "Y", "Z", "red", "nx").collect()))
    for rows in (7, 100, 10**6):
        got = las.read_ranges(spark, str(tmp_path), rows=rows)
        assert sorted(map(tuple, got.select("point_id", "X", "Y", "Z", "red", "nx").collect())) == want
    (tmp_path / "tiny.las").write_bytes(b"LASF")
    with pytest.raises(Exception, match="227 bytes"):
        las.read_ranges(spark, str(tmp_path)).collect()
    for f in tmp_path.glob("*.las"):
        f.unlink()
    assert las.read_ranges(spark, str(tmp_path)).count() == 0
