"""Hand-computed cases of functions, matrices and raster kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelmill.functions import color, geometry
from voxelmill.functions import matrix as M
from voxelmill.operators import cameras, raster, segmentation


def one(spark, *cols):
    r = spark.range(1).select(*(c.alias(f"v{i}") for i, c in enumerate(cols))).first()
    return list(r)


def test_decode(spark):
    row = geometry.decoded(spark.createDataFrame([(100, 200, 300)], "X int, Y int, Z int"), (0.01,) * 3, (1.0, 2.0, 3.0)).first()
    assert (row.x, row.y, row.z) == pytest.approx((2, 6, 0))


def test_colors(spark):
    assert one(spark, color.pack(F.lit(1.0), F.lit(0.0), F.lit(0.0)), color.to_16bit(F.lit(255)), color.to_8bit(F.lit(65535))) == [4278190335, 65535, 255]


def test_survey_classes(spark):
    classes = [47, 171, 61, 40, 999]
    assert one(spark, *(segmentation.survey_class(F.lit(c)) for c in classes)) == [4, 5, 9, 18, 1]


def test_counts(spark):
    assert one(spark, geometry.count_for(F.lit(10), percent=25.0), geometry.count_for(F.lit(3), remove=5)) == [2, 0]


def test_fibonacci(spark):
    assert [r.y for r in cameras.fibonacci(spark, 3).orderBy("i").collect()] == pytest.approx([1, 0])
    with pytest.raises(ValueError):
        cameras.fibonacci(spark, 1)


def test_intrinsics(spark):
    fx, fy, cx, cy = one(spark, *M.intrinsics(F.lit(1024.0), F.lit(512.0), F.lit(math.pi / 4)).values())
    assert (fx, fy, cx, cy) == pytest.approx((618.0386, 618.0386, 512, 256), rel=1e-5)


def test_matrices(spark):
    a, b = np.arange(16.0).reshape(4, 4), np.arange(16.0, 32.0).reshape(4, 4)
    product = one(spark, *M.multiply(M.lit(*a.T.ravel()), M.lit(*b.T.ravel())))
    assert np.allclose(np.array(product).reshape(4, 4).T, a @ b)
    p = one(spark, *M.multiply(M.perspective(*M.lit(1.0, 1.5, 0.1, 9.0)), M.inverse_perspective(*M.lit(1.0, 1.5, 0.1, 9.0))))
    assert np.allclose(np.array(p).reshape(4, 4), np.eye(4))
    for axis in "xyz":
        r = np.array(one(spark, *M.rotation(axis, F.lit(0.7)))).reshape(4, 4)
        assert np.allclose(r @ r.T, np.eye(4))


@pytest.mark.parametrize("q", [(1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0.5, -0.5, 0.5, 0.5), (0.1, 0.9, -0.3, 0.2)])
def test_quaternion_round_trip(spark, q):
    q = np.array(q, float) / np.linalg.norm(q)
    back = np.array(one(spark, *M.quaternion_of(M.rotation_of(M.lit(*q)))))
    assert min(np.abs(back - q).max(), np.abs(back + q).max()) < 1e-12


def test_tie_goes_to_lower_class(spark):
    hits = spark.createDataFrame([(1, 2)] * 3 + [(1, 1)] * 3 + [(2, 0)] * 4, "point_id long, class_id int")
    points = spark.createDataFrame([(1,), (2,), (3,)], "point_id long")
    out = {r.point_id: r.class_id for r in segmentation.label_simple(points, segmentation.vote_histogram(hits)).collect()}
    assert out == {1: 1, 2: 0, 3: 0}


def test_top_three(spark):
    votes = spark.createDataFrame([(1, 1, 5), (1, 2, 7), (1, 3, 5), (1, 4, 1)], "point_id long, class_id int, cnt long")
    assert [(r.class_id, r.cnt) for r in segmentation.ranked(votes).orderBy("rk").collect()] == [(2, 7), (1, 5), (3, 5)]


def test_kernels_agree_on_the_harmonic_solution():
    al = np.zeros((16, 16))
    al[0], al[-1] = 1, 1
    v = np.zeros((16, 16))
    v[-1] = 1.0
    expected = np.repeat(np.linspace(0, 1, 16)[:, None], 16, axis=1)
    assert np.allclose(raster.sor(v, al, 400), expected, atol=1e-6)
    assert np.allclose(raster.conjugate_gradient(v, al, 200), expected, atol=1e-6)
    assert np.allclose(raster.jacobi(v, al, 3000), expected, atol=1e-4)
    u = v
    for _ in range(40):
        u = raster.v_cycle(u, al, np.zeros_like(u))
    assert np.allclose(u, expected, atol=1e-3)


def test_jump_flood_is_close_to_exact():
    rng = np.random.default_rng(3)
    al = (rng.random((32, 48)) < 0.02).astype(float)
    ys, xs = np.nonzero(al)
    y, x = np.indices(al.shape)
    exact = np.sqrt(((y[..., None] - ys) ** 2 + (x[..., None] - xs) ** 2).min(axis=-1)) / np.hypot(48, 32)
    got = raster.jump_flood(al)
    assert (np.abs(got - exact) > 1e-9).mean() < 0.02 and (got >= exact - 1e-12).all()


def test_psnr_of_equal_images(spark):
    image = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, 4.0)], "px int, py int, r double, g double, b double, a double")
    row = raster.psnr(image, image).first()
    assert row.mse == 0 and row.psnr == math.inf


def test_blend_is_ordered(spark):
    from voxelmill.operators.projection import blended

    f = spark.createDataFrame([(0, 0, 0.9, 1, 1.0, 0.0, 0.0, 1.0), (0, 0, 0.1, 2, 0.0, 1.0, 0.0, 0.5)], "px int, py int, z double, point_id long, r double, g double, b double, weight double")
    row = blended(f).first()
    assert (row.r, row.g, row.a) == (0.5, 0.5, 1.0)


def test_bins_without_peaks(spark):
    from voxelmill.operators.depth import bins

    none = spark.createDataFrame([], "i int, a double, depth double")
    assert [tuple(r) for r in bins(none, 1.0, 9.0).collect()] == [(0, 1.0, 9.0)]


def test_voxel_of_flat_cloud(spark):
    flat = spark.createDataFrame([(1, 0.0, 2.0, 0.0), (2, 3.0, 2.0, 1.0)], "point_id long, x double, y double, z double")
    assert {r.point_id: r.vy for r in segmentation.voxel_of(flat).collect()} == {1: 0, 2: 0}


def test_votes_of_high_classes(spark):
    hits = spark.createDataFrame([(1, 130), (1, 130), (1, 5), (2, 187), (3, 0), (4, 300)], "point_id long, class_id int")
    points = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(1, 5)], "point_id long, x double, y double, z double")
    want = {(1, 130, 2), (1, 5, 1), (2, 187, 1), (4, 300, 1)}
    for bound in (None, segmentation.n_classes(hits)):
        assert {tuple(r) for r in segmentation.vote_histogram(hits, bound).collect()} == want
    assert {tuple(r) for r in segmentation.vote_histogram(hits, 128).collect()} == {(1, 5, 1)}
    votes = segmentation.vote_histogram(hits)
    labels = {1: 130, 2: 187, 3: 0, 4: 300}
    assert {r.point_id: r.class_id for r in segmentation.label_simple(points, votes).collect()} == labels
    assert {r.point_id: r.class_id for r in segmentation.spatial_refine(points, votes).collect()} == labels
    wide = spark.createDataFrame([(i, *[100.0 * i] * 3) for i in range(2)], "point_id long, x double, y double, z double")
    sides = [segmentation.voxel_of(wide, classes=segmentation.n_classes(spark.createDataFrame([(c,)], "class_id int"))).agg(F.max("vx")).first()[0] for c in (5, 2047)]
    assert sides == [63, 31]
