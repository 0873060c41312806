"""LAS point files: a Spark data source that reads byte ranges in parallel, and a writer.

    register(spark)
    spark.read.format("las").load("/clouds/*.las")

A file's records have a fixed length, so a reader partition is a range of records.
Columns hold the survey integers; functions.geometry.decoded() gives coordinates.
A point_id is the file's number among the files read, times 2^40, and the record's.
These two formats list and open files on folders that all machines have mounted;
read_ranges() does the same with the headers read by a first small job, for very many
files; read_anywhere() takes any path that Spark's own readers open, a task for each file.
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.cloud import numbered
from ..operators.tables import cut
from .archives import local_path

HEADER_BYTES = 227
# Fixed values of the format: byte offset of red, green, blue by point format; formats without colour are absent.
COLOR_AT = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
# Fixed values of the format: shortest record by point format.
RECORD_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}
SCHEMA = "path string, point_id long, X int, Y int, Z int, las_class int, red int, green int, blue int, nx float, ny float, nz float"
ROWS = 1 << 18
FILE_BITS = 40
RAW_SCHEMA = "path string, file long, first long, format int, rec_len int, head binary, records binary, tail binary"


@dataclass
class Header:
    format: int
    rec_len: int
    data_offset: int
    count: int
    scale: tuple
    offset: tuple
    low: tuple
    high: tuple


def parse_header(raw: bytes) -> Header:
    """The public header block; ValueError under 227 bytes or without the signature."""
    if len(raw) < HEADER_BYTES:
        raise ValueError(f"a LAS header has {HEADER_BYTES} bytes; got {len(raw)}")
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", raw, 179)
    return Header(raw[104] & 0x0F, struct.unpack_from("<H", raw, 105)[0], struct.unpack_from("<I", raw, 96)[0], struct.unpack_from("<I", raw, 107)[0], struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), (x0, y0, z0), (x1, y1, z1))


def class_offset(point_format: int, user_data: bool = False) -> int:
    """Where a record has its class: byte 16 from format 6 on, 15 before; some writers use byte 17 (user data) there."""
    return 16 if point_format >= 6 else 17 if user_data else 15


def extra_dimensions(raw: bytes) -> dict[str, int]:
    """Byte offset within a record of extra dimensions, by name; the first of a repeated name counts."""
    h = parse_header(raw)
    size = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 8, 8: 8, 9: 4, 10: 8}
    at, out = struct.unpack_from("<H", raw, 94)[0], {}
    for _ in range(struct.unpack_from("<I", raw, 100)[0]):
        user, record, length = raw[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", raw, at + 18)
        body = raw[at + 54 : at + 54 + length]
        if user == b"LASF_Spec" and record == 4:
            place = RECORD_BYTES[h.format]
            for k in range(0, len(body) - 191, 192):
                out.setdefault(body[k + 4 : k + 36].rstrip(b"\0").decode("ascii", "replace"), place)
                place += size.get(body[k + 2], body[k + 3])
        at += 54 + length
    return out


def repaired(raw: bytes, drop: tuple[str, ...] = ("nx", "ny", "nz")) -> bytes:
    """A file, or what of it stands before its records, with one description of extra bytes in place of all of them, with the first entry of each name that isn't in ``drop``; offsets are patched."""
    parse_header(raw)
    start, data, number = struct.unpack_from("<HII", raw, 94)
    at, others, entries = start, [], {}
    for _ in range(number):
        user, record, length = raw[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack_from("<HH", raw, at + 18)
        whole = raw[at : at + 54 + length]
        if user == b"LASF_Spec" and record == 4:
            for k in range(54, len(whole) - 191, 192):
                entry = whole[k : k + 192]
                name = entry[4:36].rstrip(b"\0").decode("ascii", "replace")
                if name not in drop:
                    entries.setdefault(name, entry)
        else:
            others.append(whole)
        at += len(whole)
    if entries:
        body = b"".join(entries.values())
        head = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"extra dimensions")
        others.append(head + body)
    described = b"".join(others)
    out = bytearray(raw[:start] + described + raw[at:data] + raw[data:])
    struct.pack_into("<II", out, 96, start + len(described) + data - at, len(others))
    return bytes(out)


def decode_records(raw: bytes, h: Header, extra: dict[str, int], user_data_class: bool = False) -> dict[str, np.ndarray | None]:
    """Columns of whole records."""
    n = len(raw) // h.rec_len
    table = np.frombuffer(raw[: n * h.rec_len], np.uint8).reshape(n, h.rec_len)

    def column(at: int, kind: str) -> np.ndarray:
        return np.ascontiguousarray(table[:, at : at + np.dtype(kind).itemsize]).view(kind)[:, 0]

    out: dict[str, np.ndarray | None] = {c: column(4 * i, "<i4") for i, c in enumerate("XYZ")}
    cls = column(class_offset(h.format, user_data_class), "u1").astype(np.int32)
    out["las_class"] = cls if h.format >= 6 else cls & 31
    at = COLOR_AT.get(h.format)
    for i, c in enumerate(("red", "green", "blue")):
        out[c] = None if at is None else column(at + 2 * i, "<u2").astype(np.int32)
    for c in ("nx", "ny", "nz"):
        place = extra.get(c)
        out[c] = column(place, "<f4") if place is not None and place + 4 <= h.rec_len else None
    return out


@dataclass
class _Range(InputPartition):
    path: str
    file: int
    first: int
    rows: int
    last: bool


def _arrays(cols: dict[str, np.ndarray | None], n: int) -> tuple[list[pa.Array], list[str]]:
    kinds = {"X": pa.int32(), "Y": pa.int32(), "Z": pa.int32(), "las_class": pa.int32(), "red": pa.int32(), "green": pa.int32(), "blue": pa.int32(), "nx": pa.float32(), "ny": pa.float32(), "nz": pa.float32()}
    return [pa.nulls(n, kinds[c]) if cols[c] is None else pa.array(cols[c], kinds[c]) for c in kinds], list(kinds)


class LasReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.las")) if os.path.isdir(path) else glob.glob(path))
        out = []
        for k, f in enumerate(files):
            with open(f, "rb") as s:
                h = parse_header(s.read(HEADER_BYTES))
            n = max(0, (os.path.getsize(f) - h.data_offset) // h.rec_len)
            n = min(n, h.count) if h.count else n
            out += [_Range(f, k, a, min(ROWS, n - a), a + ROWS >= n) for a in range(0, n, ROWS)]
        return out or [_Range("", 0, 0, 0, False)]

    def read(self, part: _Range):
        if not part.rows:
            return
        with open(part.path, "rb") as s:
            start = s.read(HEADER_BYTES)
            h = parse_header(start)
            s.seek(0)
            extra = extra_dimensions(s.read(h.data_offset))
            s.seek(h.data_offset + part.first * h.rec_len)
            cols = decode_records(s.read(part.rows * h.rec_len), h, extra, self.options.get("userdataclass", "false") == "true")
        n = len(cols["X"])
        arrays, names = _arrays(cols, n)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array((part.file << FILE_BITS) + np.arange(part.first, part.first + n)), *arrays], ["path", "point_id", *names])


class LasRawReader(LasReader):
    """The bytes of a file as they are, a row for each range of records, with all that stands before the first and after the last.

    With option repair, which names extra dimensions to drop from their description
    (none: an empty string), the head is that of a mended file: one description, each
    name once, and the offset that follows from it.  The records are read where they are.
    """

    def read(self, part: _Range):
        if not part.rows:
            return
        with open(part.path, "rb") as s:
            h = parse_header(s.read(HEADER_BYTES))
            s.seek(0)
            head = s.read(h.data_offset) if not part.first else None
            if head is not None and "repair" in self.options:
                head = repaired(head, tuple(filter(None, self.options["repair"].split(","))))
            s.seek(h.data_offset + part.first * h.rec_len)
            records = s.read(part.rows * h.rec_len)
            tail = s.read() if part.last else None
        row = {"path": part.path, "file": part.file, "first": part.first, "format": h.format, "rec_len": h.rec_len, "head": head, "records": records, "tail": tail}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("file", pa.int64()), ("first", pa.int64()), ("format", pa.int32()), ("rec_len", pa.int32()), ("head", pa.binary()), ("records", pa.binary()), ("tail", pa.binary())]))


def read_ranges(spark: SparkSession, path: str, user_data_class: bool = False, rows: int = ROWS) -> DataFrame:
    """The columns of SCHEMA of all LAS files at a path in folders that all machines have mounted, a file in many ranges; files are numbered in the order of the paths.

    A first small job reads the headers, so that the driver opens no file, however many there are.
    """

    def headed(batches):
        for batch in batches:
            found = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(local_path(name), "rb") as s:
                    h = parse_header(s.read(HEADER_BYTES))
                n = max(0, (size - h.data_offset) // h.rec_len)
                found.append((name, min(n, h.count) if h.count else n))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "n"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "length")
    heads = numbered(files.mapInArrow(headed, "path string, n long"), "file", "path").where("n > 0")
    ranges = cut(heads.select("path", "file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(rows).cast("long"))).alias("first"), "n"))
    tasks = max(1, min(ranges.count(), 100_000))  # the ranges are small rows of much work: Spark must not put them together

    def decode(batches):
        for batch in batches:
            for name, file, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with open(local_path(name), "rb") as s:
                    h = parse_header(s.read(HEADER_BYTES))
                    s.seek(0)
                    extra = extra_dimensions(s.read(h.data_offset))
                    s.seek(h.data_offset + first * h.rec_len)
                    cols = decode_records(s.read(min(rows, n - first) * h.rec_len), h, extra, user_data_class)
                m = len(cols["X"])
                arrays, names = _arrays(cols, m)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array((file << FILE_BITS) + np.arange(first, first + m)), *arrays], ["path", "point_id", *names])

    return ranges.repartition(tasks, "path", "first").select("path", "file", "first", "n").mapInArrow(decode, SCHEMA)


def read_anywhere(spark: SparkSession, path: str, user_data_class: bool = False) -> DataFrame:
    """The columns of SCHEMA of all LAS files at any path that Spark reads; a file is a task, numbered in the order of the paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path)
    order = {p: k for k, p in enumerate(sorted(r.path for r in files.select("path").collect()))}  # names of files only

    def decode(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = raw.as_buffer().to_pybytes()
                h = parse_header(raw)
                n = max(0, (len(raw) - h.data_offset) // h.rec_len)
                n = min(n, h.count) if h.count else n
                extra = extra_dimensions(raw[: h.data_offset])
                for a in range(0, n, ROWS):
                    m = min(ROWS, n - a)
                    arrays, names = _arrays(decode_records(raw[h.data_offset + a * h.rec_len : h.data_offset + (a + m) * h.rec_len], h, extra, user_data_class), m)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array((order[name] << FILE_BITS) + np.arange(a, a + m)), *arrays], ["path", "point_id", *names])

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def _with_records(raw: DataFrame, points: DataFrame, column: Column) -> DataFrame:
    """raw with an array of (record, value) of the points (point_id, ..) in each range: ROWS of them at most."""
    place = F.pmod("point_id", F.lit(1 << FILE_BITS))
    own = points.select(F.shiftright("point_id", FILE_BITS).alias("file"), (place - place % ROWS).alias("first"), F.struct((place % ROWS).cast("int").alias("record"), column.cast("int").alias("value")).alias("v"))
    return raw.join(own.groupBy("file", "first").agg(F.collect_list("v").alias("values")), ["file", "first"], "left")


def _rows(batch: pa.RecordBatch):
    """Each row without its ``values``, and these as two arrays: records and values."""
    names = [n for n in batch.schema.names if n != "values"]
    lists = batch.column(batch.schema.get_field_index("values"))
    for k, row in enumerate(batch.select(names).to_pylist()):
        own = lists[k].values
        yield row, *(np.zeros(0, np.int64) if own is None else own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("record", "value"))


def classified(raw: DataFrame, labels: DataFrame, user_data_class: bool = False) -> DataFrame:
    """(name, piece, content) of the files of ``raw`` (format las_raw) with the class byte of the points in ``labels`` (point_id, class_id) overwritten, for format("pieces").

    All other bytes stay as they are; a point without a label keeps its class.  Of
    several labels of a point one is taken.
    """

    def patch(batches):
        for batch in batches:
            for row, at, values in _rows(batch):
                table = np.frombuffer(row["records"], np.uint8).reshape(-1, row["rec_len"]).copy()
                table[at, class_offset(row["format"], user_data_class)] = values & 255
                yield _piece(row, "_classified.las", table.tobytes(), row["head"])

    return _with_records(raw, labels, F.col("class_id")).mapInArrow(patch, _PIECES)


def _piece(row: dict, ending: str, records: bytes, head: bytes | None) -> pa.RecordBatch:
    content = (head or b"") + records + (row["tail"] or b"")
    name = os.path.basename(row["path"]).removesuffix(".las") + ending
    return pa.RecordBatch.from_pylist([{"name": name, "piece": row["first"], "content": content}], pa.schema([("name", pa.string()), ("piece", pa.int64()), ("content", pa.binary())]))


_PIECES = "name string, piece long, content binary"


def thinned(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """(name, piece, content) of the files of ``raw`` with the points of ``kept`` (point_id) only: records and all else as they are, but for the header's count."""
    counts = kept.groupBy(F.shiftright("point_id", FILE_BITS).alias("file")).agg(F.count("*").alias("n"))

    def pick(batches):
        for batch in batches:
            for row, at, _ in _rows(batch):
                table = np.frombuffer(row["records"], np.uint8).reshape(-1, row["rec_len"])
                head = row["head"]
                if head is not None:
                    head = bytearray(head)
                    struct.pack_into("<I", head, 107, row["n"] or 0)
                    if len(head) >= 255 and head[25] >= 4:
                        struct.pack_into("<Q", head, 247, row["n"] or 0)
                yield _piece(row, "_thinned.las", table[np.sort(at)].tobytes(), bytes(head) if head is not None else None)

    rows = _with_records(raw, kept, F.lit(0)).join(counts, "file", "left")
    return rows.mapInArrow(pick, _PIECES)


NORMALS = ("nx", "ny", "nz")


def encode_records(table: dict[str, np.ndarray], point_format: int, user_data_class: bool = False) -> bytes:
    """Records of X, Y, Z, las_class, where the format has it colour, and where the table has them normals as extra bytes."""
    n, size = len(table["X"]), RECORD_BYTES[point_format]
    normals = all(c in table for c in NORMALS)
    out = np.zeros((n, size + 12 * normals), np.uint8)

    def put(at: int, values: np.ndarray, kind: str) -> None:
        width = np.dtype(kind).itemsize
        out[:, at : at + width] = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(n, width)

    for i, c in enumerate("XYZ"):
        put(4 * i, table[c], "<i4")
    put(class_offset(point_format, user_data_class), table["las_class"], "u1")
    if point_format in COLOR_AT:
        for i, c in enumerate(("red", "green", "blue")):
            put(COLOR_AT[point_format] + 2 * i, table[c], "<u2")
    for i, c in enumerate(NORMALS * normals):
        put(size + 4 * i, table[c], "<f4")
    return out.tobytes()


def _described(names: tuple[str, ...]) -> bytes:
    """The record that describes float extra bytes of these names: a head of 54 bytes, then 192 for each."""
    body = b"".join(struct.pack("<HBB32s156x", 0, 9, 0, name.encode()) for name in names)
    return struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(body), b"extra bytes") + body


def header_bytes(point_format: int, count: int, scale: tuple, offset: tuple, low: tuple, high: tuple, normals: bool = False) -> bytes:
    h = bytearray(375 if point_format >= 6 else HEADER_BYTES)
    h[:4] = b"LASF"
    h[24], h[25] = 1, 4 if point_format >= 6 else 2
    extra = _described(NORMALS) if normals else b""
    struct.pack_into("<HII", h, 94, len(h), len(h) + len(extra), int(normals))
    h[104] = point_format
    struct.pack_into("<HI", h, 105, RECORD_BYTES[point_format] + 12 * normals, count)
    struct.pack_into("<3d3d", h, 131, *scale, *offset)
    struct.pack_into("<6d", h, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(h) + extra


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class LasWriter(DataSourceArrowWriter):
    """One LAS file for each task; a file appears under its name only when it is whole.  Option normals adds nx, ny, nz."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, batches):
        from pyspark import TaskContext

        o, context = self.options, TaskContext.get()
        kind = int(o.get("pointformat", "0"))
        scale = tuple(float(v) for v in o.get("scale", "0.001,0.001,0.001").split(","))
        offset = tuple(float(v) for v in o.get("offset", "0,0,0").split(","))
        normals = o.get("normals", "false") == "true"
        columns = ["X", "Y", "Z", "las_class", *(("red", "green", "blue") if kind in COLOR_AT else ()), *(NORMALS * normals)]
        folder = o["path"].removeprefix("file://")
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"part-{context.partitionId():05d}.las")
        temporary = f"{name}.{context.taskAttemptId()}.tmp"
        n, low, high = 0, np.full(3, np.iinfo(np.int32).max), np.full(3, np.iinfo(np.int32).min)
        with open(temporary, "wb") as s:
            s.write(header_bytes(kind, 0, scale, offset, (0, 0, 0), (0, 0, 0), normals))
            for b in batches:
                t = {c: b.column(b.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False) for c in columns}
                if len(t["X"]):
                    xyz = np.stack([t[c] for c in "XYZ"])
                    low, high = np.minimum(low, xyz.min(axis=1)), np.maximum(high, xyz.max(axis=1))
                    s.write(encode_records(t, kind, o.get("userdataclass", "false") == "true"))
                    n += len(t["X"])
            box = [[float(v) * k + d for v, k, d in zip(e, scale, offset)] if n else [0.0] * 3 for e in (low, high)]
            s.seek(0)
            s.write(header_bytes(kind, n, scale, offset, *box, normals))
        os.replace(temporary, name)
        return _Written(name, n)


class LasSource(DataSource):
    @classmethod
    def name(cls):
        return "las"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LasReader(dict(self.options))

    def writer(self, schema, overwrite):
        return LasWriter(dict(self.options))


class LasRawSource(DataSource):
    @classmethod
    def name(cls):
        return "las_raw"

    def schema(self):
        return RAW_SCHEMA

    def reader(self, schema):
        return LasRawReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)
    spark.dataSource.register(LasRawSource)
