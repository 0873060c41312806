"""Views meet cells before they meet points: the same rows, from fewer."""

import random

import pytest

from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P
from voxelmill.plans import projection as Q
from voxelmill.plans.views import points

CLOUD = "point_id long, x double, y double, z double"


def every_pair(points_, cameras):
    """All finite points in all views: no frustum holds the others, though Spark takes NaN for the greatest number."""
    return points_.where("abs(x) < 1e300 AND abs(y) < 1e300 AND abs(z) < 1e300").crossJoin(cameras)


def in_view(df):
    seen = P.clipped(df, C.camera_of_row()).where(P.in_frustum())
    return sorted((r.view, r.point_id) for r in seen.select("view", "point_id").collect())


def test_same_rows_from_fewer(spark, sf_dir):
    p, cameras = points(spark, sf_dir), C.camera_rows(spark, Q.INNER_EYES, Q.TARGET, Q.W, Q.H, Q.FOV, Q.NEAR, Q.FAR)
    culled = P.seen_by(p, cameras)
    assert culled.columns == every_pair(p, cameras).columns
    assert in_view(culled) == in_view(every_pair(p, cameras))
    sent, seen, pairs = culled.count(), len(in_view(culled)), p.count() * cameras.count()
    print(f"{pairs} pairs, {sent} sent, {seen} in a frustum")
    assert seen <= sent < 0.6 * pairs


@pytest.mark.parametrize("cells", [1, 5, 48])
def test_odd_clouds(spark, cells):
    rng = random.Random(cells)
    rows = [(i, *(rng.choice((rng.uniform(-30, 30), 0.0, 5.0)) for _ in range(3))) for i in range(400)]
    rows += [(900, None, 1.0, 1.0), (901, float("inf"), 1.0, 1.0), (902, float("nan"), 1.0, 1.0), (903, 5.0, 5.0, 5.0), (903, 5.0, 5.0, 5.0)]
    cameras = C.camera_rows(spark, {k: tuple(rng.uniform(-20, 20) for _ in range(3)) for k in range(12)}, (1.0, 2.0, 3.0), 64, 48, 40.0, 0.5, 25.0)
    p = spark.createDataFrame(rows, CLOUD)
    assert in_view(P.seen_by(p, cameras, cells)) == in_view(every_pair(p, cameras))
    for few in (p.limit(0), spark.createDataFrame([rows[0]], CLOUD), spark.createDataFrame([rows[-1]] * 3, CLOUD), spark.createDataFrame(rows[400:403], CLOUD)):
        assert in_view(P.seen_by(few, cameras, cells)) == in_view(every_pair(few, cameras))
    assert P.seen_by(p, cameras.limit(0), cells).count() == 0


def test_many_views_and_pairs_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(P, "VIEWS", 4)
    monkeypatch.setattr(P, "FEW_PAIRS", 0)
    rng = random.Random(1)
    p = spark.createDataFrame([(i, *(rng.uniform(-9, 9) for _ in range(3))) for i in range(200)], CLOUD)
    cameras = C.camera_rows(spark, {k: tuple(rng.uniform(-9, 9) for _ in range(3)) for k in range(11)}, (0.0, 0.0, 0.0), 64, 48, 50.0, 0.1, 9.0)
    assert in_view(P.seen_by(p, cameras)) == in_view(every_pair(p, cameras))


def test_a_view_that_sees_nothing(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], CLOUD)
    cameras = C.camera_rows(spark, {0: (0.0, 0.0, 5.0), 1: (0.0, 0.0, -5.0)}, (0.0, 0.0, -9.0), 64, 48, 40.0)
    found = {r.view: (r.in_view, r.density) for r in P.view_results(cameras, p, 64, 48, 40.0).collect()}
    assert found[1] == (0, 0.0) and found[0][0] == 1
    assert {r.in_view for r in P.view_results(cameras, p.limit(0), 64, 48, 40.0).collect()} == {None}
