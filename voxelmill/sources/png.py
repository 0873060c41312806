"""PNG masks and images of all depths, with palettes and interlaced ones, to pixels; pixels to files; members of ZIP files."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(raw):
        n, kind = struct.unpack_from(">I4s", raw, at)
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def unfiltered(data: np.ndarray, filters: np.ndarray, width: int) -> np.ndarray:
    """Undo the line filters none, sub, up, average and Paeth; ``width`` is bytes of a pixel.

    A pixel needs its left, upper and upper left neighbours only, so all pixels of a
    diagonal (line + column) are worked out at once.
    """
    if len(filters) and filters.max() > 4:
        raise ValueError(f"PNG filter {filters.max()}")
    h, w = data.shape[0], data.shape[1] // width
    raw = data.reshape(h, w, width).astype(np.int16)
    out = np.zeros((h + 1, w + 1, width), np.int16)
    for t in range(h + w - 1):
        y = np.arange(max(0, t - w + 1), min(h, t + 1))
        x, kind = t - y, filters[y][:, None]
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        da, db, dc = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        add = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + add) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, w * width)


# Fixed values of the format: samples of a pixel by colour type; first column and row and steps of the seven passes of an interlaced image.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _parts(w: int, h: int, interlaced: bool) -> Iterator[tuple[slice, slice, int, int]]:
    """Rows and columns of each pass, and how many: one pass of all, or seven."""
    for x, y, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        cols, rows = len(range(x, w, dx)), len(range(y, h, dy))
        if cols and rows:
            yield slice(y, None, dy), slice(x, None, dx), rows, cols


def decode(raw: bytes) -> np.ndarray:
    """height x width x samples; samples of 1, 2 and 4 bits spread over 0 to 255, palette colours as three samples, or four if some aren't opaque."""
    head, body, palette, clear = None, b"", None, b""
    for kind, data in chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        elif kind == b"tRNS":
            clear = data
        elif kind == b"IDAT":
            body += data
    w, h, depth, color, _, _, interlaced = head
    if depth not in (1, 2, 4, 8, 16) or color not in SAMPLES or (color == 3 and palette is None):
        raise ValueError(f"PNG of {depth} bits and colour type {color}")
    samples, data, at = SAMPLES[color], zlib.decompress(body), 0
    out = np.zeros((h, w, samples), np.int32)
    for rows, cols, high, wide in _parts(w, h, bool(interlaced)):
        size = -(-wide * samples * depth // 8)
        lines = np.frombuffer(data, np.uint8, high * (size + 1), at).reshape(high, size + 1)
        at += lines.size
        flat = unfiltered(lines[:, 1:], lines[:, 0], max(1, samples * depth // 8))
        if depth < 8:
            bits = np.unpackbits(flat, axis=1).reshape(high, -1, depth)
            flat = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2)[:, : wide * samples]
        elif depth == 16:
            flat = flat.copy().view(">u2")
        out[rows, cols] = flat.astype(np.int32).reshape(high, wide, samples)
    if color == 3:
        alpha = np.full(len(palette), 255, np.int32)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        return (np.column_stack([palette, alpha]) if clear else palette)[out[:, :, 0]]
    return out * (255 // ((1 << depth) - 1)) if depth < 8 else out


def filtered(lines: np.ndarray, filters: tuple[int, ...], width: int) -> bytes:
    """Lines of bytes under the filters, in turn, each behind its filter's number."""
    up = np.vstack([np.zeros_like(lines[:1]), lines[:-1]]).astype(np.int16)
    left, corner = np.zeros_like(up), np.zeros_like(up)
    left[:, width:], corner[:, width:] = lines[:, :-width], up[:, :-width]
    guess = left + up - corner
    da, db, dc = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
    kind = np.resize(np.array(filters, np.uint8), len(lines))
    less = np.select([kind[:, None] == k for k in range(5)], [np.zeros_like(up), left, up, (left + up) // 2, paeth])
    return np.column_stack([kind, ((lines.astype(np.int16) - less) & 255).astype(np.uint8)]).tobytes()


def encode(pixels: np.ndarray, depth: int | None = None, palette: np.ndarray | None = None, interlaced: bool = False, filters: tuple[int, ...] = (0,)) -> bytes:
    """A file of height x width (grey, or numbers of colours in a ``palette``) or height x width x 4 (8 bits); grey has 8 or 16 bits by type, or as many as ``depth`` says.  ``filters`` are used line by line, in turn."""
    h, w = pixels.shape[:2]
    depth = depth or (16 if pixels.dtype.itemsize == 2 else 8)
    samples, body = 4 if pixels.ndim == 3 else 1, b""
    for rows, cols, high, _ in _parts(w, h, interlaced):
        part = pixels[rows, cols].reshape(high, -1)
        if depth < 8:
            bits = (part[:, :, None].astype(np.uint8) >> np.arange(depth - 1, -1, -1, dtype=np.uint8)) & 1
            lines = np.packbits(bits.reshape(high, -1), axis=1)
        else:
            lines = np.ascontiguousarray(part.astype(">u2" if depth == 16 else "u1")).view(np.uint8).reshape(high, -1)
        body += filtered(lines, filters, max(1, samples * depth // 8))
    body = zlib.compress(body)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, depth, 3 if palette is not None else 6 if pixels.ndim == 3 else 0, 0, 0, int(interlaced))
    colours = chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    return SIGNATURE + chunk(b"IHDR", head) + colours + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def scaled_bytes(values: np.ndarray, unit: bool) -> np.ndarray:
    """Bytes of values 0 to 255, or 0 to 1 if ``unit``: cut, clamped."""
    return np.clip(np.floor(values * (255.0 if unit else 1.0)), 0, 255).astype(np.uint8)


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, name, content) of the files in the ZIP archives at a path, sorted by name, a task for each archive; only those with one of the ``suffixes``, in either case, where given."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, content in zip(b.path, b.content):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/") and (not suffixes or n.lower().endswith(suffixes))):
                        yield pd.DataFrame({"archive": [archive], "name": [name], "content": [z.read(name)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, content binary")


def mask_pixels(files: DataFrame) -> DataFrame:
    """(name, px, py, class_id) of the first sample of every pixel of PNG masks (name, content)."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.name, b.content):
                v = decode(bytes(content))[:, :, 0]
                y, x = np.indices(v.shape, np.int32)
                yield pd.DataFrame({"name": name, "px": x.ravel(), "py": y.ravel(), "class_id": v.ravel()})

    return files.select("name", "content").mapInPandas(pixels, "name string, px int, py int, class_id int")


def images(rasters: DataFrame, keys: tuple[str, ...] = ("view_id",)) -> DataFrame:
    """(keys, content): a PNG of each view's pixels (px, py, r, g, b, a from 0 to 1)."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((int(pdf.py.max()) + 1, int(pdf.px.max()) + 1, 4), np.uint8)
        out[pdf.py, pdf.px] = scaled_bytes(pdf[list("rgba")].to_numpy(), True)
        first = pdf[list(keys)].head(1).copy()
        first["content"] = [encode(out)]
        return first

    kinds = ", ".join(f"{k} {dict(rasters.dtypes)[k]}" for k in keys)
    return rasters.groupBy(*keys).applyInPandas(draw, f"{kinds}, content binary")


#: How debugging images show values: factors of each channel, before they are cut to bytes.
DEBUG_SCALES = {"texture": (255.0, 255.0, 255.0), "normalised": (180.0, 100.0, 200.0), "mask": (255.0, 255.0, 255.0)}


def debug_pixels(raster: DataFrame, kind: str, channels: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """px, py and r, g, b, a from 0 to 1 of a raster for images(), by a kind of DEBUG_SCALES; ``mask`` shows its first channel only."""
    named = [F.col(channels[0])] * 3 if kind == "mask" else [F.col(c) for c in channels]
    shown = [F.floor(F.greatest(F.least(c * k, F.lit(255.0)), F.lit(0.0))) / 255.0 for c, k in zip(named, DEBUG_SCALES[kind])]
    return raster.withColumns({**dict(zip("rgb", shown)), "a": F.lit(1.0)})
