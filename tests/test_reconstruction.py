"""Whole-view reconstruction on hand-made clouds."""

from pyspark.sql import functions as F

from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P
from voxelmill.operators import reconstruction as V

W, H = 16, 12
CAMERA = ((0.0, 0.0, 5.0), (0.0, 0.0, 0.0), W, H, 60.0, 0.1, 20.0)


def cameras(spark):
    return C.camera_rows(spark, {0: CAMERA[0], 7: (0.0, 0.0, 6.0)}, *CAMERA[1:])


def cloud(spark):
    rows = [(i * 9 + j, (i - 4) * 0.6, (j - 4) * 0.5, 0.0, i / 8, j / 8, 0.5) for i in range(9) for j in range(9)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double")


def bins(spark, *ranges):
    return spark.createDataFrame([(v, k, a, b) for v in (0, 7) for k, (a, b) in enumerate(ranges)], "view int, bin_id int, start double, end double")


def test_captured_pixels_keep_their_colour(spark):
    points = cloud(spark)
    got = {(r.view, r.px, r.py): r for r in V.reconstructed(points, cameras(spark), bins(spark, (1.0, 9.0)), W, H, 40).collect()}
    assert len(got) == 2 * W * H
    seen = {(s.px, s.py): s for s in P.z_buffer(P.pixels(points, C.fixed_camera(*CAMERA), W, H), "r", "g", "b").collect()}
    assert seen
    for at, s in seen.items():
        r = got[0, *at]
        assert (r.r, r.g, r.b, r.a) == (s.r, s.g, s.b, 1.0)
    between = [r for (v, *at), r in got.items() if v == 0 and tuple(at) not in seen and r.a > 0]
    assert between and all(-1e-9 <= c <= 1 for r in between for c in (r.r, r.g, r.b, r.a))


def test_overlapping_bins_and_empty_views(spark):
    points, cams = cloud(spark), cameras(spark)
    three = bins(spark, (1.0, 5.5), (4.5, 9.0), (9.0, 12.0))
    lit = {r.layer: r.n for r in V.slices(points, cams, three, W, H).where("view = 0").groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert lit[0] == lit[-1] > 0 and -2 not in lit
    assert V.reconstructed(points.limit(0), cams, three, W, H, 2).count() == 0
    assert V.reconstructed(points, cams, three.limit(0), W, H, 2).count() == 0


def test_a_hot_pixel_is_blended_in_order(spark):
    rows = [(k, 3, 4, float((k * 7919) % 500), k % 5 / 5.0, k % 7 / 7.0, k % 3 / 3.0, 0.02 + k % 11 / 20.0) for k in range(500)] + [(900, 1, 1, 2.0, 1.0, 0.5, 0.25, 1.0)]
    got = {(r.px, r.py): r for r in P.blended(spark.createDataFrame(rows, "point_id long, px int, py int, z double, r double, g double, b double, weight double")).collect()}
    want = [0.0] * 4
    for k, _, _, _, *rgb, w in sorted(rows[:500], key=lambda r: (-r[3], r[0])):
        want = [c * w + b * (1 - w) for c, b in zip(rgb, want)] + [w + want[3] * (1 - w)]
    assert all(abs(a - b) < 1e-9 for a, b in zip((got[3, 4].r, got[3, 4].g, got[3, 4].b, got[3, 4].a), want)) and got[1, 1].g == 0.5


def test_all_steps_leave_next_to_no_residual(spark):
    """After the full steps the holes are harmonic: each is the mean of its neighbours."""
    import numpy as np

    from voxelmill.operators import raster as R

    layers = V.filled(V.slices(cloud(spark), cameras(spark), bins(spark, (1.0, 9.0)), W, H), W, H).toPandas()
    assert set(layers["view"]) == {0, 7}
    for _, own in layers.groupby(["view", "layer"]):
        al = R.dense(own, "al")
        for c in V.CHANNELS:
            v = R.dense(own, c)
            assert np.abs(np.where(al <= 0, R.mean4(v) - v, 0.0)).max() < 1e-9 and v.min() >= -1e-9
