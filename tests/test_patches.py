"""Patches in perspective and on panoramas, pixel by pixel against rays."""

import math
import random

import numpy as np
import pytest

from voxelmill.operators import cameras as C
from voxelmill.operators import projection as P

CLOUD = "point_id long, x double, y double, z double, nx double, ny double, nz double"
W, H = 40, 24


def rays(eye, target, fov, panorama):
    """Unit-speed rays of all pixels, in the world: a pixel at depth (or, on a panorama, distance) t sees eye + t * ray."""
    e, z = np.array(eye), np.subtract(eye, target)
    z = z / np.linalg.norm(z)
    x = np.cross([0.0, 0.0, 1.0] if abs(z[1]) > 0.99 else [0.0, 1.0, 0.0], z)
    x /= np.linalg.norm(x)
    y = np.cross(z, x)
    for py in range(H):
        for px in range(W):
            a, b = (px + 0.5) / W * 2 - 1, 1 - (py + 0.5) / H * 2
            if panorama:
                lon, lat = a * math.pi, b * math.pi / 2
                v = np.array([math.cos(lat) * math.sin(lon), math.sin(lat), -math.cos(lat) * math.cos(lon)])
            else:
                f = 1 / math.tan(math.radians(fov) / 2)
                v = np.array([a / (f * H / W), b / f, -1.0])
            yield px, py, e, v @ np.array([x, y, z])


def by_force(points, eye, target, size, near, far, panorama=False, fov=60.0):
    out = {}
    axes = {}
    for i, *p, nx, ny, nz in points:
        if None in p:
            continue
        ahead = np.subtract(eye, p)
        ahead = ahead / np.linalg.norm(ahead)
        n = np.array([nx, ny, nz])
        if np.linalg.norm(n) >= 0.001:
            n = n / np.linalg.norm(n)
            n = -n if n @ ahead < 0 else n
        else:
            n = ahead
        right = np.cross([0.0, 0.0, 1.0] if abs(n[1]) > 0.99 else [0.0, 1.0, 0.0], n)
        right /= np.linalg.norm(right)
        axes[i] = np.array(p), n, right, np.cross(n, right)
    for px, py, e, v in rays(eye, target, fov, panorama):
        for i, (p, n, right, over) in axes.items():
            if abs(v @ n) < 1e-12:
                continue
            t = ((p - e) @ n) / (v @ n)
            place = e + t * v - p
            a, b = place @ right / size, place @ over / size
            if t > (0 if panorama else near) and t <= far and max(abs(a), abs(b)) <= 1:
                out[i, px, py] = a * a + b * b, t / far if panorama else (far / (near - far) * -t + far * near / (near - far)) / t
    return out


def same(df, want):
    got = {(r.point_id, r.px, r.py): (r.r2, r.z) for r in df.collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], rtol=1e-6, atol=1e-9) for k in got)
    return got


def cloud(seed, n=60, spread=4.0):
    rng = random.Random(seed)
    normal = lambda: rng.choice([(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), tuple(rng.uniform(-1, 1) for _ in range(3))])
    return [(i, *(rng.uniform(-spread, spread) for _ in range(3)), *normal()) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_every_pixel_of_a_cloud_around_the_eye(spark, seed):
    points, eye, target = cloud(seed) + [(99, None, 0.0, 0.0, 0.0, 0.0, 0.0)], (0.3, 0.1 * seed, 0.2), (2.0, 1.0, -1.0 - seed)
    df, camera = spark.createDataFrame(points, CLOUD), C.fixed_camera(eye, target, W, H, 60.0, 0.3, 6.0)
    assert same(P.patches(df, camera, 0.8, W, H, "guarded"), by_force(points, eye, target, 0.8, 0.3, 6.0))
    assert same(P.spherical_patches(df, camera, 0.8, 5.0, W, H, "guarded"), by_force(points, eye, target, 0.8, 0.0, 5.0, True))


def test_near_plane_edge_of_the_raster_and_edge_on(spark):
    eye, target = (0.0, 0.0, 0.0), (0.0, 0.0, -5.0)
    camera = C.fixed_camera(eye, target, W, H, 60.0, 0.5, 20.0)
    floor = (1, 0.0, -0.4, -1.0, 0.0, 1.0, 0.0)  # lies under the eye and beyond it: crosses the near plane
    behind = (2, 0.0, -0.4, 0.5, 0.0, 1.0, 0.0)  # its centre is behind the eye, a part of it is seen
    aside = (3, 5.2, 0.0, -4.0, 0.0, 0.0, 1.0)  # its centre is off the raster
    edge_on = (4, 0.0, 0.0, -3.0, 0.0, 1.0, 0.0)
    points = [floor, behind, aside, edge_on]
    got = same(P.patches(spark.createDataFrame(points, CLOUD), camera, 2.0, W, H, "guarded"), by_force(points, eye, target, 2.0, 0.5, 20.0))
    assert {i for i, *_ in got} == {1, 2, 3}
    depths = [z for (i, px, py), (_, z) in sorted(got.items()) if i == 1 and px == W // 2]
    assert len(set(depths)) == len(depths) > 3 and depths == sorted(depths, reverse=True)  # nearer towards the lower edge
    kept = P.patches(spark.createDataFrame(points, CLOUD), camera, 2.0, W, H, "guarded", near=3.5, far=4.0)
    assert {r.point_id for r in kept.collect()} == {3}  # the range is about centres


def test_a_disc_on_the_seam_and_one_over_a_pole(spark):
    eye, target = (0.0, 0.0, 0.0), (0.0, 0.0, -1.0)
    camera = C.fixed_camera(eye, target, W, H, 60.0, 0.1, 20.0)
    points = [(1, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0), (3, 0.0, 0.0, -9.0, 0.0, 0.0, 0.0)]
    got = same(P.spherical_patches(spark.createDataFrame(points, CLOUD), camera, 1.0, 5.0, W, H), by_force(points, eye, target, 1.0, 0.0, 5.0, True))
    columns = {i: {px for j, px, _ in got if j == i} for i in (1, 2, 3)}
    assert {0, W - 1} <= columns[1] and not columns[1] & set(range(8, W - 8))  # both sides of the seam
    assert columns[2] == set(range(W)) and not columns[3]
    assert P.spherical_patches(spark.createDataFrame([], CLOUD), camera, 1.0, 5.0, W, H).count() == 0
