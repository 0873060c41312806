"""Solvers on tiles against the same solvers on the whole raster."""

import numpy as np
import pytest

from voxelmill.operators import raster as R
from voxelmill.operators import tiles


def rasters(spark, height, width, seeds=(1, 2), share=0.2):
    rows, arrays = [], {}
    for seed in seeds:
        rng = np.random.default_rng(seed)
        al = (rng.random((height, width)) < share * (seed > 0)).astype(float)
        v = rng.random((height, width)) * al
        arrays[seed] = v, al
        rows += [(seed, x, y, float(v[y, x]), float(al[y, x])) for y in range(height) for x in range(width) if al[y, x] or seed % 2]  # the even ones have rows of captured pixels only
    return spark.createDataFrame(rows, "view int, px int, py int, v double, al double"), arrays


def solved(df, height, width, keys=("view",)):
    out = {}
    for view, part in df.toPandas().groupby("view"):
        assert len(part) == height * width and not part.duplicated(["px", "py"]).any()
        out[view] = R.dense(part, "v")
    return out


@pytest.mark.parametrize("method,steps,height,width,tile", [("sor", 5, 32, 48, 8), ("sor", 7, 19, 33, 16), ("jacobi", 9, 30, 20, 8), ("jfa", 0, 64, 40, 8), ("jfa", 0, 21, 70, 16), ("multigrid", 2, 64, 64, 16), ("multigrid", 1, 40, 64, 32), ("two_grid", 2, 32, 64, 8)])
def test_equal_to_the_whole_raster_bit_for_bit(spark, method, steps, height, width, tile):
    df, arrays = rasters(spark, height, width)
    got = solved(tiles.solved(df, method, steps, width, height, tile, ("view",)), height, width)
    assert set(got) == set(arrays)
    for view, (v, al) in arrays.items():
        assert (got[view] == R.METHODS[method](v, al, steps)).all(), view


def test_many_rounds_and_conjugate_gradients(spark):
    df, arrays = rasters(spark, 24, 24)
    got = solved(tiles.solved(df, "sor", 50, 24, 24, 8, ("view",)), 24, 24)
    for view, (v, al) in arrays.items():
        assert (got[view] == R.sor(v, al, 50)).all()
    got = solved(tiles.solved(df, "cg", 4, 24, 24, 8, ("view",)), 24, 24)
    for view, (v, al) in arrays.items():
        assert np.allclose(got[view], R.conjugate_gradient(v, al, 4), rtol=1e-12, atol=1e-12)


def test_rasters_without_holes_or_without_captured_pixels(spark):
    full = spark.createDataFrame([(5, x, y, float(x * y), 1.0) for x in range(12) for y in range(12)] + [(6, 0, 0, None, None)], "view int, px int, py int, v double, al double")
    for method, steps in (("sor", 3), ("cg", 2), ("multigrid", 1), ("jfa", 0), ("jacobi", 0)):
        got = solved(tiles.solved(full, method, steps, 12, 12, 4, ("view",)), 12, 12)
        want = {5: np.zeros((12, 12)), 6: np.full((12, 12), np.hypot(12, 12))} if method == "jfa" else {5: np.outer(range(12), range(12)), 6: np.zeros((12, 12))}
        assert all((got[view] == want[view]).all() for view in (5, 6)), method
    assert tiles.solved(full.limit(0), "sor", 1, 12, 12, 4, ("view",)).count() == 0
    for bad in (("none", 4), ("sor", 5)):
        with pytest.raises(ValueError):
            tiles.solved(full, bad[0], 1, 12, 12, bad[1], ("view",))


def test_many_steps_leave_next_to_no_residual(spark):
    df, arrays = rasters(spark, 32, 32, seeds=(3,), share=0.05)
    v, al = arrays[3]
    for method, steps in (("sor", 200), ("multigrid", 12)):
        u = solved(tiles.solved(df, method, steps, 32, 32, 16, ("view",)), 32, 32)[3]
        assert np.abs(np.where(al <= 0, R.mean4(u) - u, 0.0)).max() < 1e-5 and (u[al > 0] == v[al > 0]).all()
