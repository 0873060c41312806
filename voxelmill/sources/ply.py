"""PLY vertex files, ASCII and binary little-endian, with or without colour; and their side-car of origin and scale."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.cloud import numbered
from ..operators.tables import cut
from .archives import local_path

# Fixed values of the format: names of property types.
TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2", "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8"}
SCHEMA = "path string, point_id long, x double, y double, z double, red int, green int, blue int"


#: Vertices of a binary body, and bytes of a text body, that are one range.
ROWS, RANGE_BYTES = 1 << 18, 16 << 20
#: Most bytes of a header.
_HEAD = 1 << 16


@dataclass(frozen=True)
class Head:
    """What a file's header says: binary or not, where the body starts, how many vertices it has and their properties (name, type)."""

    binary: bool
    start: int
    count: int
    names: tuple[tuple[str, str], ...]

    def columns(self, table) -> pd.DataFrame:
        """x, y, z and colour of the properties, null where there is none."""
        own = [n for n, _ in self.names]
        out = pd.DataFrame({c: np.asarray(table[c], float) for c in "xyz"})
        for c in ("red", "green", "blue"):
            out[c] = pd.array(np.asarray(table[c]).astype(int), "Int32") if c in own else pd.array([None] * len(out), "Int32")
        return out

    def vertices(self, raw: bytes) -> pd.DataFrame:
        """Of whole records, or whole lines."""
        if self.binary:
            return self.columns(np.frombuffer(raw, np.dtype(list(self.names))))
        words, lines = raw.split(), raw.decode("ascii").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        if len(words) == len(lines) * len(self.names):
            table = np.array(words, float).reshape(-1, len(self.names))
        else:  # lines with more than the properties
            table = np.array([line.split()[: len(self.names)] for line in lines], float).reshape(-1, len(self.names))
        return self.columns({n: table[:, i] for i, (n, _) in enumerate(self.names)})


def head(raw: bytes) -> Head:
    """The header at the start of a file's bytes."""
    end = raw.index(b"end_header")
    start = raw.index(b"\n", end) + 1
    lines = raw[:end].decode("ascii").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    kind, names, count, inside = "", [], 0, False
    for words in (line.split() for line in lines):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[:1] == ["property"] and inside:
            names.append((words[-1], TYPES[words[1]]))
    if kind not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY format {kind!r}")
    return Head(kind != "ascii", start, count, tuple(names))


def parse(raw: bytes) -> pd.DataFrame:
    """Vertices: x, y, z and colour, null where the file has none; other properties are passed over."""
    h = head(raw)
    if h.binary:
        return h.vertices(raw[h.start : h.start + h.count * np.dtype(list(h.names)).itemsize])
    return h.vertices(b"".join(raw[h.start :].splitlines(True)[: h.count]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all files at a path, a task for each file; a point_id is the file's number in the order of the paths, times 2^40, and the vertex's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path)
    order = {p: k for k, p in enumerate(sorted(r.path for r in files.select("path").collect()))}  # names of files only

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b.path, b.content):
                v = parse(bytes(content))
                v.insert(0, "point_id", (order[name] << 40) + np.arange(len(v)))
                v.insert(0, "path", name)
                yield v

    return files.select("path", "content").mapInPandas(vertices, SCHEMA)


def _tasks(spark: SparkSession, ranges: int, size: float) -> int:
    """How many tasks ranges of so many bytes in all are dealt to: they are small rows of much work, which Spark must not put together, but a task for each small range would cost more than its work."""
    return max(1, min(ranges, max(2 * spark.sparkContext.defaultParallelism, int(size) // RANGE_BYTES), 100_000))


def read_ranges(spark: SparkSession, path: str, rows: int = ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same rows with the same ids as read(), of files in folders that all machines have mounted, a file in many ranges.

    A first small job reads the headers.  A range of a binary body is some records.  A
    range of a text body is the lines that begin in it; a second job counts
    these, so that each range knows the number of its first line: what follows the
    last vertex is passed over.
    """

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, size in zip(b.path, b.length):
                with open(local_path(name), "rb") as f:
                    h = head(f.read(_HEAD))
                yield pd.DataFrame({"path": [name], "start": [h.start], "length": [size], "binary": [h.binary], "count": [h.count], "names": [[{"name": n, "kind": k} for n, k in h.names]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "length")
    heads = numbered(files.mapInPandas(headed, "path string, start long, length long, binary boolean, count long, names array<struct<name: string, kind: string>>"), "file", "path")
    end, step = F.when(F.col("binary"), F.col("count")).otherwise(F.col("length")), F.when(F.col("binary"), F.lit(rows)).otherwise(F.lit(range_bytes))
    first = F.when(F.col("binary"), F.lit(0)).otherwise(F.col("start"))
    ranges = heads.where("count > 0").withColumn("low", F.explode(F.sequence(first.cast("long"), end - 1, step.cast("long")))).withColumn("high", F.least(F.col("low") + step, end))
    record = F.when(F.col("binary"), (F.col("length") - F.col("start")) / F.col("count")).otherwise(1.0)
    ranges = cut(ranges.select("path", "file", ((F.col("low") - first) / step).cast("long").alias("range"), "low", "high", "start", "binary", "count", "names", ((F.col("high") - F.col("low")) * record).alias("bytes")))
    tasks = _tasks(spark, *ranges.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0.0))).first())
    ranges = ranges.drop("bytes")

    def began(f, low: int, start: int) -> int:
        """Where the first line that begins at ``low`` or after it does."""
        f.seek(max(low - 1, start))
        if low > start:
            f.readline()
        return f.tell()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b.itertuples(index=False):
                n = 0
                with open(local_path(k.path), "rb") as f:
                    at = began(f, k.low, k.start)
                    while at < k.high:
                        part = f.read(min(1 << 20, k.high - at))
                        n += part.count(b"\n")
                        at += len(part)
                        if at >= k.high and not part.endswith(b"\n"):
                            n += 1  # a line that began here and ends beyond
                yield pd.DataFrame({"path": [k.path], "range": [k.range], "n": [n]})

    lines = ranges.where("NOT binary").repartition(tasks, "path", "range").mapInPandas(counted, "path string, range long, n long")
    before = lines.select("path", "range", (F.sum("n").over(Window.partitionBy("path").orderBy("range")) - F.col("n")).alias("before"))  # a row for each range of a file
    placed = ranges.join(before, ["path", "range"], "left").repartition(tasks, "path", "range")

    def vertices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in b.itertuples(index=False):
                names = tuple((v["name"], v["kind"]) for v in k.names)
                h = Head(bool(k.binary), k.start, k.count, names)
                with open(local_path(k.path), "rb") as f:
                    if h.binary:
                        size, index = np.dtype(list(names)).itemsize, int(k.low)
                        f.seek(h.start + k.low * size)
                        raw = f.read((k.high - k.low) * size)
                    else:
                        index, at = int(k.before), began(f, k.low, k.start)
                        if at >= k.high or index >= k.count:
                            continue
                        raw = f.read(k.high - at)
                        raw += b"" if raw.endswith(b"\n") else f.readline()
                        if index + raw.count(b"\n") > k.count:
                            raw = b"".join(raw.splitlines(True)[: int(k.count) - index])
                v = h.vertices(raw)
                v.insert(0, "point_id", (int(k.file) << 40) + index + np.arange(len(v)))
                v.insert(0, "path", k.path)
                yield v

    return placed.mapInPandas(vertices, SCHEMA)


def encode(points: pd.DataFrame, color: bool) -> bytes:
    """A binary little-endian file of single-precision x, y, z and, if asked for, byte colours."""
    kinds = [(c, "<f4") for c in "xyz"] + ([(c, "u1") for c in ("red", "green", "blue")] if color else [])
    table = np.zeros(len(points), np.dtype(kinds))
    for c, _ in kinds:
        table[c] = points[c].to_numpy()
    return header(len(points), color) + table.tobytes()


def header(n: int, color: bool) -> bytes:
    names = "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue") if color)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{names}end_header\n".encode()


def side_car(origin: list[float], scale: float, color: bool) -> str:
    return json.dumps({"origin": list(origin), "position_scale": scale, "has_color": color})


def side_cars(clouds: DataFrame, name: str) -> DataFrame:
    """(name, piece, content) of a side-car beside each cloud (``name``, origin, position_scale, has_color), for format("pieces")."""
    text = F.to_json(F.struct("origin", "position_scale", "has_color"))
    return clouds.select(F.concat(F.col(name), F.lit(".json")).alias("name"), F.lit(0).cast("long").alias("piece"), F.encode(text, "utf-8").alias("content"))


def read_side_car(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("origin array<double>, position_scale double, has_color boolean").option("multiLine", True).json(path)


def pieces(points: DataFrame, color: bool, name: str = "name") -> DataFrame:
    """(name, piece, content) of a binary file for each ``name`` of points (x, y, z and red, green, blue), in the order of point_id, for format("pieces").

    Every task encodes its own rows; the header, with the number of vertices, is a piece before all others.
    """
    columns = ["x", "y", "z", *(("red", "green", "blue") if color else ())]
    ranged = points.select(name, "point_id", *columns).repartitionByRange(name, "point_id").sortWithinPartitions(name, "point_id")
    counts = points.groupBy(name).agg(F.count("*").alias("n"))

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, rows in b.groupby(name, sort=False):
                yield pd.DataFrame({"name": [key], "piece": [int(rows.point_id.iloc[0]) + 1], "content": [encode(rows, color).split(b"end_header\n", 1)[1]]})

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b[name], "piece": -1, "content": [header(n, color) for n in b.n]})

    kind = "name string, piece long, content binary"
    return ranged.mapInPandas(body, kind).unionByName(counts.mapInPandas(head, kind))


def text_pieces(lines: DataFrame, name: str) -> DataFrame:
    """(name, piece, content) of one text file of lines (piece, line) in the order of ``piece``, for format("pieces"): every task joins its own lines, so that the file's writer only copies bytes."""
    ranged = lines.select("piece", "line").repartitionByRange("piece").sortWithinPartitions("piece")

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"name": [name], "piece": [int(b.piece.iloc[0])], "content": ["".join(f"{v}\n" for v in b.line).encode()]})

    return ranged.mapInPandas(joined, "name string, piece long, content binary")


def to_survey(points: DataFrame, scale: float = 0.001) -> DataFrame:
    """X, Y, Z in units of ``scale``, class 0 and 16-bit colours of vertices, for the LAS writer: point format 3 with colour, else 0."""
    colours = {c: F.coalesce(F.col(c), F.lit(0)) * 257 for c in ("red", "green", "blue")}
    return points.select(*(F.rint(F.col(c) / scale).cast("int").alias(c.upper()) for c in "xyz"), F.lit(0).alias("las_class"), *(v.cast("int").alias(c) for c, v in colours.items()))
