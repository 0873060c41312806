"""A point is projected once in each view, whatever is filtered by its clip coordinates afterwards."""

import re

from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P


def test_filters_do_not_repeat_the_projection(spark):
    cameras = C.camera_rows(spark, {0: (9.0, 6.0, 11.0), 1: (-4.0, 5.0, 9.0)}, (3.0, 2.5, 2.5), 64, 48, 60.0, 0.1, 50.0)
    points = spark.createDataFrame([(k, k * 0.3, k * 0.2, k * 0.25) for k in range(20)], "point_id long, x double, y double, z double")
    seen = P.pixels(P.seen_by(points, cameras), C.camera_of_row(), 64, 48, 0.1, 50.0)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    for i in range(16):
        for matrix in ("view_matrix", "projection"):
            assert len(re.findall(rf"{matrix}#\d+\[{i}\] \*", plan)) <= 1
    assert seen.select("view", "point_id").distinct().count() == seen.count() > 0
