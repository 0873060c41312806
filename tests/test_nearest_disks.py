"""Nearest discs, picked within tasks: the same as by all fragments, and few rows leave a task."""

import pytest
from pyspark.sql import functions as F

from test_patches import CLOUD, H, W, cloud
from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P


@pytest.mark.parametrize("far", [None, 5.0])
@pytest.mark.parametrize("steps", [1e6, 4.0])
def test_as_by_all_fragments(spark, far, steps):
    points = cloud(1, 80) + [(99, None, 0.0, 0.0, 0.0, 0.0, 0.0), (None, 1.0, 0.5, -0.5, 0.0, 0.0, 0.0)]
    points += [(1000 + (i or 0), *rest) for i, *rest in points]  # equal depths
    df, camera = spark.createDataFrame(points, CLOUD).repartition(5), C.fixed_camera((0.3, 0.1, 0.2), (2.0, 1.0, -1.0), W, H, 60.0, 0.3, 6.0)
    every = P.world_disks(df, camera, 0.8, W, H, "guarded") if far is None else P.panorama_disks(df, camera, 0.8, far, W, H, "guarded")
    want = P.z_buffer(every.withColumn("z", F.floor(F.col("z") * steps + 0.5)))
    got = P.nearest_disks(df, camera, 0.8, W, H, steps, "guarded", far)
    assert sorted((r.px, r.py, r.z, r.point_id is None, r.point_id or 0) for r in got.collect()) == sorted((r.px, r.py, r.z, r.point_id is None, r.point_id or 0) for r in want.collect())


def test_a_task_hands_out_a_raster_at_most(spark):
    camera = C.fixed_camera((0.3, 0.1, 0.2), (2.0, 1.0, -1.0), W, H, 60.0, 0.3, 6.0)
    df = spark.createDataFrame(cloud(2, 400), CLOUD).coalesce(2)
    assert P.world_disks(df, camera, 0.8, W, H).count() > 2 * W * H
    assert P.patches(df, camera, 0.8, W, H, steps=1e6).count() <= 2 * W * H
