"""Projection rounds as its formulas are written, so that points on a pixel's edge and equal depths fall as they do in SQL."""

import numpy as np
import pytest

from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P
from voxelmill.plans import projection as plans


@pytest.mark.parametrize("kind", ["fixed", "row"])
def test_points_on_the_middle_plane(spark, kind):
    rows = [(m * 1000 + j, 15 * m * 0.004, j * 0.005, (17 * m - 350) * 0.005) for m in range(21, 80) for j in range(0, 1000, 50)]  # 17 (x - 9) = 12 (z - 11): seen straight ahead
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    size = plans.W, plans.H
    seen = P.pixels(df, plans._fixed_camera(spark), *size) if kind == "fixed" else P.pixels(P.seen_by(df, plans.two_cameras(spark).where("view = 0")), C.camera_of_row(), *size)
    got = {r.point_id: (r.px, r.py, r.z) for r in seen.collect()}

    view, fx, fy, a, b = plans._constants()
    ids, x, y, z = (np.array(v, float) for v in zip(*rows))
    vx, vy, vz = (r[0] * x + r[1] * y + r[2] * z + r[3] for r in view)
    px, py = np.floor((fx * vx / -vz + 1) * (size[0] / 2)), np.floor((1 - fy * vy / -vz) * (size[1] / 2))
    assert got == {int(i): (p, q, d) for i, p, q, d in zip(ids, px, py, (a * vz + b) / -vz)}
