"""Baseline JPEG images: files to pixels and pixels to files.

Huffman codes are read one by one, by a table that tells each 16 bits' first code;
all else, from coefficients to colours, is done for all blocks at once.  A file is
one task's work: an image of 1024 x 512 pixels takes a fraction of a second.  Progressive
files are refused.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Fixed values of the format: places of a block's coefficients in the order in which they are stored, along its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
# Fixed values of the format: red and blue from the colour differences, and green from both.
RED, BLUE, GREEN = 1.402, 1.772, (0.344136, 0.714136)
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """Of every 16 bits: the length of the code they begin with, times 256, and its symbol; 0 where there is none."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            out[code << (16 - size) : (code + 1) << (16 - size)] = size << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


def _parsed(raw: bytes) -> dict:
    """Tables, frame and coded data of a file."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    found, at = {"quant": {}, "codes": {}, "restart": 0}, 2
    while at + 4 <= len(raw):
        kind, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                found["quant"][body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(float)
                k += 65 + 64 * bool(wide)
        elif kind == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                found["codes"][body[k]] = _lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif kind in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError(f"JPEG of {body[0]} bits")
            found["size"] = struct.unpack_from(">HH", body, 1)
            found["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG files are read")
        elif kind == 0xDD:
            found["restart"] = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            found["tables"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, 16 | body[2 + 2 * i] & 15) for i in range(body[0])}
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(raw, at)
            found["data"] = raw[at : end.start() if end else len(raw)]
            break
    if "data" not in found or "parts" not in found:
        raise ValueError("a JPEG file without a picture")
    return found


def _coefficients(found: dict, across: int, down: int) -> list[np.ndarray]:
    """Of each component the stored coefficients of its blocks, unit by unit."""
    plan = [(c, *(found["codes"][t] for t in found["tables"][name])) for c, (name, h, v, _) in enumerate(found["parts"]) for _ in range(h * v)]
    per = [h * v for _, h, v, _ in found["parts"]]
    places, values = [[] for _ in per], [[] for _ in per]
    done, units = [0] * len(per), across * down
    for part in re.split(rb"\xff[\xd0-\xd7]", found["data"]):
        data = np.frombuffer(part.replace(b"\xff\x00", b"\xff") + b"\xff" * 64, np.uint8).astype(np.int64)
        window = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]).tolist()  # 24 bits from each byte on
        p, last = 0, [0] * len(per)
        for _ in range(min(found["restart"] or units, units)):
            for c, dc, ac in plan:
                at, own, what = done[c] * 64, places[c], values[c]
                done[c] += 1
                k = 0
                while k < 64:
                    code = (ac if k else dc)[window[p >> 3] >> (8 - (p & 7)) & 0xFFFF]
                    if not code:
                        raise ValueError("a JPEG code that no table has")
                    p += code >> 8
                    run, size = (code & 255) >> 4, code & 15
                    if k and not size:
                        if run < 15:
                            break
                        k += 16
                        continue
                    k += run
                    v = window[p >> 3] >> (8 - (p & 7)) & 0xFFFF
                    v >>= 16 - size
                    p += size
                    if size and v < 1 << (size - 1):
                        v -= (1 << size) - 1
                    if not k:
                        last[c] += v
                        v = last[c]
                    own.append(at + k)
                    what.append(v)
                    k += 1
        units -= found["restart"] or units
        if units <= 0:
            break
    out = []
    for c, n in enumerate(per):
        blocks = np.zeros(across * down * n * 64)
        at = np.array(places[c], np.int64)
        blocks[at[at < len(blocks)]] = np.array(values[c], float)[at < len(blocks)]
        out.append(blocks.reshape(-1, 64))
    return out


def decode(raw: bytes) -> np.ndarray:
    """height x width x 1 (grey) or 3 (red, green, blue) bytes of a baseline file; chroma pixels are repeated where they are coarser."""
    found = _parsed(raw)
    height, width = found["size"]
    most = [max(part[k] for part in found["parts"]) for k in (1, 2)]
    across, down = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
    if len(found["parts"]) == 1:  # one component's units are single blocks
        (name, _, _, q), most = found["parts"][0], [1, 1]
        found["parts"], across, down = [(name, 1, 1, q)], -(-width // 8), -(-height // 8)
    planes = []
    for (_, h, v, q), stored in zip(found["parts"], _coefficients(found, across, down)):
        blocks = np.zeros_like(stored)
        blocks[:, ZIGZAG] = stored * found["quant"][q]
        pixels = _COSINES.T @ blocks.reshape(-1, 8, 8) @ _COSINES
        plane = pixels.reshape(down, across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(down * v * 8, across * h * 8)
        planes.append(plane.repeat(most[1] // v, axis=0).repeat(most[0] // h, axis=1)[:height, :width])
    if len(planes) == 1:
        colours = planes[0][:, :, None] + 128
    else:
        y, blue, red = planes[:3]
        colours = np.stack([y + RED * red, y - GREEN[0] * blue - GREEN[1] * red, y + BLUE * blue], axis=2) + 128
    return np.clip(np.floor(colours + 0.5), 0, 255).astype(np.uint8)


def encode(pixels: np.ndarray, step: float = 1, coarse: int = 1, restart: int = 0) -> bytes:
    """A baseline file of height x width (grey) or height x width x 3 bytes.

    All coefficients are stored in units of ``step``, chroma at one pixel for each
    ``coarse`` x ``coarse`` (1 or 2), a restart mark after so many units.  Codes have equal lengths.
    """
    if pixels.ndim == 2:
        planes, factors = [pixels.astype(float) - 128], [1]
        coarse = 1
    else:
        r, g, b = (pixels[:, :, c].astype(float) for c in range(3))
        kr, kb = 1 - RED / 2, 1 - BLUE / 2  # shares of red and blue in the brightness
        y = kr * r + (1 - kr - kb) * g + kb * b
        planes, factors = [y - 128, (b - y) / BLUE, (r - y) / RED], [coarse, 1, 1]
    height, width = pixels.shape[:2]
    across, down = -(-width // (8 * coarse)), -(-height // (8 * coarse))
    grids = []
    for plane, n in zip(planes, factors):
        plane = np.pad(plane, ((0, down * 8 * coarse - height), (0, across * 8 * coarse - width)), mode="edge")
        if n < coarse:
            plane = plane.reshape(down * 8, coarse, across * 8, coarse).mean(axis=(1, 3))
        blocks = plane.reshape(down, n, 8, across, n, 8).transpose(0, 3, 1, 4, 2, 5).reshape(down * across, n * n, 8, 8)
        grids.append(np.rint((_COSINES @ blocks @ _COSINES.T).reshape(down * across, n * n, 64)[:, :, ZIGZAG] / step).astype(int).tolist())
    out, bits, held = bytearray(), 0, 0

    def put(value: int, size: int) -> None:
        nonlocal bits, held
        bits, held = bits << size | value, held + size
        while held >= 8:
            held -= 8
            byte = bits >> held
            bits &= (1 << held) - 1
            out.append(byte)
            if byte == 0xFF:
                out.append(0)

    def number(v: int, size: int) -> None:
        put(v if v >= 0 else v + (1 << size) - 1, size)

    def flush() -> None:
        if held:
            put((1 << (8 - held)) - 1, 8 - held)

    last = [0] * len(planes)
    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (unit // restart - 1) % 8])
            last = [0] * len(planes)
        for c, grid in enumerate(grids):
            for block in grid[unit]:
                size = abs(block[0] - last[c]).bit_length()
                put(size, 4)
                number(block[0] - last[c], size)
                last[c], zeros = block[0], 0
                for v in block[1:]:
                    if not v:
                        zeros += 1
                        continue
                    while zeros > 15:
                        put(0xF0, 8)
                        zeros -= 16
                    size = abs(v).bit_length()
                    put(zeros << 4 | size, 8)
                    number(v, size)
                    zeros = 0
                if zeros:
                    put(0, 8)
    flush()

    def chunk(kind: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body

    quant = bytes([0]) + bytes([int(step)]) * 64
    tables = b"".join(bytes([name, *(n if k + 1 == size else 0 for k in range(16)), *range(n)]) for name, size, n in ((0, 4, 15), (16, 8, 255)))
    frame = struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([c + 1, n << 4 | n, 0]) for c, n in enumerate(factors))
    scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + bytes([0, 63, 0])
    marks = chunk(0xDD, struct.pack(">H", restart)) if restart else b""
    return b"\xff\xd8" + chunk(0xDB, quant) + chunk(0xC0, frame) + chunk(0xC4, tables) + marks + chunk(0xDA, scan) + bytes(out) + b"\xff\xd9"
