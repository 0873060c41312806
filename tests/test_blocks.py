"""A large cloud searched in itself by blocks, against brute force."""

import random

import numpy as np
import pytest

from voxelmill.operators import blocks, cloud
from voxelmill.operators.tables import Tables

SCHEMA = "point_id long, x double, y double, z double"


def clouds():
    rng = random.Random(4)
    even = [tuple(rng.uniform(0, 3) for _ in "xyz") for _ in range(700)]
    plane = [(rng.uniform(0, 3), rng.uniform(0, 3), 1.0) for _ in range(500)]
    uneven = [tuple(rng.gauss(0, 10.0 ** rng.randint(-4, 2)) for _ in "xyz") for _ in range(600)] + [(1e9, 0.0, 0.0)]
    lattice = [(x / 2, y / 2, z / 2) for x in range(9) for y in range(9) for z in range(9)]  # many equal distances
    shared = [(0.5, 0.5, 0.5)] * 60 + even[:300]
    copies = even[:150] * 5
    return {"even": even, "plane": plane, "uneven": uneven, "lattice": lattice, "shared": shared, "copies": copies}


@pytest.mark.parametrize("kind, k", [("even", 8), ("plane", 1), ("uneven", 8), ("lattice", 20), ("shared", 8), ("copies", 3)])
def test_as_by_brute_force(spark, monkeypatch, kind, k):
    monkeypatch.setattr(cloud, "FEW_RIGHT", 0)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    monkeypatch.setattr(blocks, "RUN", 4)
    monkeypatch.setattr(blocks, "PAIRS", 500)
    monkeypatch.setattr(blocks.blocked, "__defaults__", (40,))
    monkeypatch.setattr(cloud, "_candidates", None)  # no cells are probed
    at = clouds()[kind]
    ids = random.Random(1).sample(range(10 * len(at)), len(at))
    p = spark.createDataFrame([*((i, *a) for i, a in zip(ids, at)), (-1, None, 1.0, 1.0)], SCHEMA).repartition(3)
    found = {}
    for r in cloud.nearest(p, p, 0.3, k).collect():
        found.setdefault(r.point_id, []).append((r.d, r.other))
    xyz, names = np.array(at), np.array(ids)
    assert set(found) == set(ids)
    for i, a in zip(ids, xyz):
        x, y, z = (a - xyz).T
        d = np.sqrt(x * x + y * y + z * z)
        order = np.lexsort((names, d))[:k]
        assert sorted(found[i]) == list(zip(d[order].tolist(), names[order].tolist()))


def test_blocks_follow_the_points(spark):
    """Points once each, blocks of bounded size wherever points are, and their boxes."""
    for kind, at in clouds().items():
        p = spark.createDataFrame([(i, *a) for i, a in enumerate(at)], SCHEMA)
        own, every = blocks.blocked(Tables(spark), p, 50)
        own, every = own.toPandas(), every.toPandas().set_index("block")
        assert sorted(own.point_id) == list(range(len(at)))
        sizes = own.groupby("block").size()
        assert sizes.to_dict() == every.n.to_dict() and sizes.max() <= 100
        for c in "xyz":
            assert (own.groupby("block")[c].min() == every[f"{c}0"].loc[sizes.index]).all() and (own.groupby("block")[c].max() == every[f"{c}1"].loc[sizes.index]).all()


def test_points_that_ask_for_more_than_there_are(spark, monkeypatch):
    monkeypatch.setattr(cloud, "FEW_RIGHT", 0)
    monkeypatch.setattr(blocks, "BLOCK", 2)
    monkeypatch.setattr(blocks.blocked, "__defaults__", (2,))
    p = spark.createDataFrame([(i, float(i * i), 0.0, 0.0) for i in range(9)], SCHEMA)
    found = cloud.nearest(p, p, 0.3, 20).collect()
    assert sorted((r.point_id, r.other, r.d) for r in found) == [(i, j, float(abs(i * i - j * j))) for i in range(9) for j in range(9)]
