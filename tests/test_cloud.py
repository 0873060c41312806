"""Neighbour searches and normals against brute force."""

import random

import numpy as np
import pytest

from voxelmill.operators import cloud


def test_nearest_vectors_takes_any_number_of_queries(spark):
    rng = random.Random(3)
    vec = lambda: [float(rng.randint(-9, 9)) for _ in range(3)]
    vectors = [(i, vec()) for i in range(30)]
    queries = vectors[:10] + [(1000 + i, vec()) for i in range(10_500)]
    schema = "vec_id long, embedding array<float>"
    got = {}
    for r in cloud.nearest_vectors(spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), 2).collect():
        got.setdefault(r.query_id, []).append((r.rk, r.vec_id, r.d2))
    assert len(got) == len(queries)
    for i, q in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:2]
        assert sorted(got[i]) == [(k + 1, j, round(d * 1e6)) for k, (d, j) in enumerate(near)]


def test_nearest_of_far_points(spark):
    rng = random.Random(5)
    place = lambda far: tuple(rng.uniform(-1, 1) + far * rng.choice((-1, 1)) for _ in range(3))
    left = [(i, *place(10.0 ** (i % 4))) for i in range(40)]
    right = [(100 + i, *place(1)) for i in range(15)]
    schema = "point_id long, x double, y double, z double"
    got = {r.point_id: (r.other, r.d) for r in cloud.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.5).collect()}
    assert set(got) == {p[0] for p in left}
    for i, *at in left:
        d, other = min((float(np.linalg.norm(np.subtract(at, q))), j) for j, *q in right)
        assert got[i][0] == other and np.isclose(got[i][1], d)
    assert cloud.nearest(spark.createDataFrame(left, schema), spark.createDataFrame([], schema), 0.5).count() == 0


def test_normals_of_a_wide_group_agree(spark):
    rng = random.Random(6)
    ids = list(range(84))
    rng.shuffle(ids)
    lines = [(i, float(k % 42), 50.0 * (k // 42), 0.0) for k, i in enumerate(ids)]  # two groups, 41 hops wide each
    turn = lambda x: (float(np.cos(x / 20)), 0.0, float(np.sin(x / 20)))
    normals = [(i, *(rng.choice((-1, 1)) * np.array(turn(x))).tolist()) for i, x, _, _ in lines]
    got = {r.point_id: (r.nx, r.ny, r.nz) for r in cloud.oriented(spark.createDataFrame(normals, "point_id long, nx double, ny double, nz double"), spark.createDataFrame(lines, "point_id long, x double, y double, z double"), 1.1).collect()}
    given = {i: v for i, *v in normals}
    for y in (0.0, 50.0):
        group = {i: turn(x) for i, x, y_, _ in lines if y_ == y}
        first = min(group)
        side = np.sign(np.dot(given[first], group[first]))
        assert all(np.allclose(got[i], side * np.array(t)) for i, t in group.items())


def test_nearest_in_a_gap(spark):
    schema = "point_id long, x double, y double, z double"
    left = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 30.0, 0.0, 0.0), (3, 90000.0, 0.0, 0.0)], schema)
    right = spark.createDataFrame([(10, 0.1, 0.0, 0.0), (11, 31.0, 0.0, 0.0)], schema)
    assert {r.point_id: r.other for r in cloud.nearest(left, right, 0.5).collect()} == {1: 10, 2: 11, 3: 11}
    assert sorted((r.point_id, r.other) for r in cloud.nearest(left, right, 0.5, 2).collect()) == [(p, q) for p in (1, 2, 3) for q in (10, 11)]


def halves(points, most):
    """Cells by the plain recursion: {id: cell}."""
    cells = []

    def split(own):
        if len(own) <= most:
            cells.append(own)
            return
        sides = [max(p[a] for p in own) - min(p[a] for p in own) for a in (1, 2)]
        axis = 1 if sides[0] >= sides[1] else 2
        mid = (min(p[axis] for p in own) + max(p[axis] for p in own)) / 2
        parts = [p for p in own if p[axis] < mid], [p for p in own if not p[axis] < mid]
        if not all(parts):
            own = sorted(own)
            parts = own[: len(own) // 2], own[len(own) // 2 :]
        for part in parts:
            split(part)

    split(points)
    return {p[0]: k for k, own in enumerate(cells) for p in own}


def test_adaptive_cells_of_points_that_hardly_differ(spark):
    low = 1.0
    high = float(np.nextafter(low, 2))
    rng = random.Random(8)
    rows = [(i, (low, high)[i % 2], 0.0) for i in range(20)] + [(100 + i, 5.0, 5.0) for i in range(23)] + [(200 + i, rng.uniform(0, 9), rng.uniform(0, 4)) for i in range(60)]
    got = {r.point_id: r.cell_id for r in cloud.adaptive_cells(spark.createDataFrame(rows, "point_id long, x double, z double"), 5).collect()}
    assert got == halves(rows, 5)


def test_outliers_and_exact_samples(spark):
    rng = random.Random(9)
    rows = [(i, *(rng.gauss(0, 1) for _ in "xyz")) for i in range(60)] + [(99, 500.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    mean = {i: np.mean(sorted(np.linalg.norm(np.subtract(p, q)) for _, *q in rows)[:6]) for i, *p in rows}
    top = np.mean(list(mean.values())) + 2 * np.std(list(mean.values()), ddof=1)
    assert {r.point_id for r in cloud.without_outliers(df, 6, 2.0).collect()} == {i for i, m in mean.items() if m < top} and 99 not in {i for i, m in mean.items() if m < top}
    for n in (0, 1, 17, 61, 100):
        assert cloud.thinned(df, n).count() == min(n, 61)


def test_orientation_is_one_spanning_tree_in_rounds_or_at_once(spark):
    rng = random.Random(8)
    at = [(i * 7 % 61, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(60)] + [(100, 50.0, 0.0, 0.0)]
    normals = [(i, *rng.choice([(1.0, 0.1, 0.2), (-0.3, 0.9, 0.1), (0.2, -0.4, 0.8)])) for i, *_ in at]
    n, p = spark.createDataFrame(normals, "point_id long, nx double, ny double, nz double"), spark.createDataFrame(at, "point_id long, x double, y double, z double")
    found = [{r.point_id: (r.nx, r.ny, r.nz) for r in cloud.oriented(n, p, 1.5, few=few).collect()} for few in (100_000, 0)]
    assert found[0] == found[1] and set(found[0]) == {i for i, *_ in at}

    # the plain rule: Kruskal over each point's eleven nearest within the radius
    place, unit, near = {i: np.array(v) for i, *v in at}, {i: np.array(v) for i, *v in normals}, set()
    for i in place:
        reach = sorted((float(np.linalg.norm(place[i] - place[j])), j) for j in place if np.linalg.norm(place[i] - place[j]) <= 1.5)[:11]
        near |= {(min(i, j), max(i, j)) for _, j in reach if j != i}
    group = {i: [i] for i in place}
    sign = dict.fromkeys(place, 1)
    for _, i, j in sorted((-abs(float(unit[i] @ unit[j])), i, j) for i, j in near):
        if group[i] is not group[j]:
            if (unit[i] * sign[i]) @ (unit[j] * sign[j]) < 0:
                for k in group[j]:
                    sign[k] = -sign[k]
            group[i] += group[j]
            for k in group[j]:
                group[k] = group[i]
    for i in place:
        assert np.allclose(found[0][i], unit[i] * sign[i] * sign[min(group[i])])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_clouds(spark):
    rng = random.Random(12)
    left = [(i, *(rng.uniform(0, 3) for _ in "xyz")) for i in range(150)] + [(900, None, 1.0, 1.0)]
    right = [(i, *(rng.randint(0, 6) / 2 for _ in "xyz")) for i in range(60)] + [(100 + i, 1.0, 1.0, 1.0) for i in range(5)]
    schema = "point_id long, x double, y double, z double"
    return left, right, spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)


@pytest.mark.parametrize("few", [0, cloud.FEW_RIGHT])
def test_a_neighbour_join_ships_no_cloud(spark, monkeypatch, few):
    """A right side that is few is shipped by cell; otherwise neither side is, whatever Spark guesses of their sizes."""
    monkeypatch.setattr(cloud, "FEW_RIGHT", few)
    left, right, p, q = random_clouds(spark)
    near = cloud.within(p, q, 0.8, 3)
    assert ("BroadcastHashJoin" in plan_of(near)) == (few > 0) and ("SortMergeJoin" in plan_of(near)) == (few == 0)
    got, ranked = {}, {}
    for r in near.collect():
        got.setdefault(r.point_id, set()).add((round(r.d, 9), r.other))
    for i, *at in left[:-1]:
        best = sorted((round(float(np.linalg.norm(np.subtract(at, to))), 9), j) for j, *to in right)
        ranked[i] = best
        assert got.get(i, set()) == {b for b in best if b[0] <= 0.8} & set(best[:3])
    assert 900 not in got
    for k in (1, 4):
        found = {}
        for r in cloud.nearest(p, q, 0.4, k).collect():
            found.setdefault(r.point_id, []).append((round(r.d, 9), r.other))
        assert {i: sorted(v) for i, v in found.items()} == {i: b[:k] for i, b in ranked.items()}


def test_equal_places_are_searched_once(spark, monkeypatch):
    """Many points at few places: what is probed are the places, and ties go to the lowest ids as everywhere."""
    monkeypatch.setattr(cloud, "FEW_RIGHT", 0)
    rng, probed, plain = random.Random(5), [], cloud._candidates

    def counted(left, *rest):
        probed.append(left.count())
        return plain(left, *rest)

    monkeypatch.setattr(cloud, "_candidates", counted)
    at = [tuple(rng.randint(0, 30) / 10 for _ in "xyz") for _ in range(40)]
    rows = [(i, *rng.choice(at)) for i in range(400)]
    p = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, None, 1.0, 1.0)], "point_id long, x double, y double, z double")
    for k in (1, 15):
        probed.clear()
        found = {}
        for r in cloud.nearest(p, p, 0.3, k).collect():
            found.setdefault(r.point_id, []).append((round(r.d, 9), r.other))
        assert {i: sorted(v) for i, v in found.items()} == {i: sorted((round(float(np.linalg.norm(np.subtract(a, to))), 9), j) for j, *to in rows)[:k] for i, *a in rows}
        assert probed[0] == len({tuple(a) for _, *a in rows}) + 1  # and the place without x
