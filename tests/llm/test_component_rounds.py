"""Components: right on long paths and hubs, by tables whose plans hold one round each."""

import random

import pytest

from voxelmill.llm import op4_jaccard_join as J
from voxelmill.llm.tables import Scratch


class Watched(Scratch):
    """Notes how many joins the plan of each table has."""

    def written(self, df):
        self.joins = [*getattr(self, "joins", []), df._jdf.queryExecution().analyzed().toString().count("Join ")]
        return super().written(df)


def _smallest(edges):
    up = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        up[hi] = lo
    return {v: top(v) for v in up}


@pytest.mark.parametrize("kind", ["path", "hub", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    n = 60
    ids = rng.sample(range(1000), n)
    edges = {
        "path": list(zip(ids, ids[1:])),
        "hub": [(ids[0], v) for v in ids[1:]],
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(50)],
        "none": [],
    }[kind]
    scratch = Watched(spark)
    found = J._components(spark.createDataFrame(edges, "a long, b long"), scratch)
    assert {r.x: r.component for r in found.collect()} == _smallest(edges)
    assert max(scratch.joins) <= 3
    scratch.clear()
