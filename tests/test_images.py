"""Image files of all kinds and windowed-sinc resampling against plain rules."""

import math

import numpy as np
import pytest

from voxelmill.operators import images
from voxelmill.sources import png


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
@pytest.mark.parametrize("interlaced", [False, True])
def test_grey_and_palette_files_round_trip(depth, interlaced):
    rng = np.random.default_rng(depth)
    for h, w in ((1, 1), (3, 2), (8, 8), (5, 13), (9, 17)):
        for filters in ((0,), (1, 2, 3, 4, 0), (4,)):
            mask = rng.integers(0, 1 << depth, (h, w))
            back = png.decode(png.encode(mask, depth, None, interlaced, filters))
            assert back.shape == (h, w, 1) and (back[:, :, 0] == (mask * (255 // ((1 << depth) - 1)) if depth < 8 else mask)).all()
            if depth <= 8:
                palette = rng.integers(0, 256, (1 << depth, 3))
                assert (png.decode(png.encode(mask, depth, palette, interlaced, filters)) == palette[mask]).all()
    rgba = rng.integers(0, 256, (6, 11, 4)).astype(np.uint8)
    assert (png.decode(png.encode(rgba, None, None, interlaced, (0, 4, 3))) == rgba).all()


def test_clear_palette_entries_and_bad_files():
    raw = png.encode(np.array([[0, 1, 2]]), 2, np.array([[9, 8, 7], [6, 5, 4], [3, 2, 1], [0, 0, 0]]))
    at = raw.index(b"IDAT") - 4
    clear = b"\0\0\0\x02tRNS\x00\x80" + b"\0\0\0\0"  # the reader doesn't look at checksums
    assert png.decode(raw[:at] + clear + raw[at:]).tolist() == [[[9, 8, 7, 0], [6, 5, 4, 128], [3, 2, 1, 255]]]
    with pytest.raises(ValueError, match="3 bits"):
        png.decode(raw.replace(b"\x02\x03\0\0\0", b"\x03\x03\0\0\0", 1))


def test_sinc_against_the_plain_rule(spark):
    rng = np.random.default_rng(5)

    def weights(old, new, lobes):
        out, scale = np.zeros((new, old)), old / new
        wide = max(scale, 1.0)
        for i in range(new):
            c = (i + 0.5) * scale
            for j in range(max(0, math.floor(c - lobes * wide + 0.5)), min(old, math.floor(c + lobes * wide + 0.5))):
                x = (j + 0.5 - c) / wide
                out[i, j] = np.sinc(x) * np.sinc(x / lobes) if abs(x) < lobes else 0.0
        return out / out.sum(axis=1, keepdims=True)

    for (w, h), (nw, nh), lobes in (((7, 5), (3, 9), 3), ((4, 4), (4, 1), 2), ((1, 6), (5, 2), 3)):
        v, a = rng.random((h, w)), rng.random((h, w))
        a[0, 0] = 0.0
        df = spark.createDataFrame([(x, y, float(v[y, x]), float(a[y, x])) for y in range(h) for x in range(w)], "px int, py int, r double, a double")
        for alpha in (None, "a"):
            got = images.resampled(df, (w, h), nw, nh, ("r", "a"), lobes, alpha).collect()
            assert len(got) == nw * nh
            ww, wh = weights(w, nw, lobes), weights(h, nh, lobes)
            want_a = wh @ a @ ww.T
            want = wh @ (v * a) @ ww.T / want_a if alpha else wh @ v @ ww.T
            for r in got:
                assert np.isclose(r.a, want_a[r.py, r.px])
                assert np.isclose(r.r, want[r.py, r.px]) if not alpha or r.a > 0 else r.r == 0.0
    same = images.resampled(df, (1, 6), 1, 6, ("r",)).collect()
    assert all(np.isclose(r.r, v[r.py, r.px]) for r in same)


def test_photos_within_one_level():
    from voxelmill.sources import jpeg

    y, x = np.indices((67, 91))
    smooth = np.clip(128 + 100 * np.sin(x / 9) * np.cos(y / 7), 0, 255)
    grey = smooth.astype(np.uint8)
    for restart in (0, 1, 5, 1000):
        back = jpeg.decode(jpeg.encode(grey, restart=restart))
        assert back.shape == (67, 91, 1) and np.abs(back[:, :, 0].astype(int) - grey).max() <= 1
    rgb = np.stack([smooth, smooth[::-1], 255 - smooth], axis=2).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(rgb, restart=3)).astype(int) - rgb).max() <= 2  # one level in each of three planes
    noise = np.random.default_rng(1).integers(0, 256, (40, 24)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(noise))[:, :, 0].astype(int) - noise).max() <= 1
    kr, kb = 1 - jpeg.RED / 2, 1 - jpeg.BLUE / 2
    light = kr * rgb[:, :, 0] + kb * rgb[:, :, 2] + (1 - kr - kb) * rgb[:, :, 1]
    coarse = jpeg.decode(jpeg.encode(rgb, coarse=2))
    assert np.abs(kr * coarse[:, :, 0] + kb * coarse[:, :, 2] + (1 - kr - kb) * coarse[:, :, 1] - light)[light.round() % 255 > 60].mean() < 2
    even = np.repeat(np.repeat(np.random.default_rng(2).integers(40, 200, (3, 5, 3)), 16, axis=0), 16, axis=1).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(even, coarse=2)).astype(int) - even).max() <= 2  # colours that are even over 16 x 16 pixels
    for bad in (b"no photo", b"\xff\xd8\xff\xd9", jpeg.encode(grey).replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError, match="JPEG"):
            jpeg.decode(bad)


def test_bitmaps_of_both_kinds(spark):
    from voxelmill.sources import bitmaps, jpeg

    grey = np.full((8, 8), 100, np.uint8)
    rgba = np.zeros((2, 3, 4), np.uint8)
    rgba[0, 1] = 255, 0, 51, 102
    files = spark.createDataFrame([("a", bytearray(jpeg.encode(grey))), ("b", bytearray(png.encode(rgba))), ("c", bytearray(png.encode(np.full((1, 1), 65535), 16))), ("d", None)], "name string, content binary")
    got = {(r.name, r.px, r.py): (r.r, r.g, r.b, r.a) for r in bitmaps.pixels(files).collect()}
    assert len(got) == 64 + 6 + 1 and got["a", 7, 7] == (100 / 255, 100 / 255, 100 / 255, 1.0)
    assert got["b", 1, 0] == (1.0, 0.0, 0.2, 0.4) and got["c", 0, 0] == (1.0, 1.0, 1.0, 1.0)
