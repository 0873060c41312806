"""ZIP archives: read member by member from their directories, written by deflating on the executors.

Reading: a first small job reads each archive's directory, at the file's end; each
member is then a row that any task can read by its place, so a large archive is many
tasks' work.  Writing: members, or pieces of a large one, are deflated where they
are and put into part files; one task for each archive then only copies bytes,
and writes headers and directory, with 64-bit sizes where they are needed.  Folders
are ones that all machines have mounted.
"""

from __future__ import annotations

import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import Tables

#: Deflated bytes that one task reads, about.
TASK_BYTES = 32 << 20
_BIG = 0xFFFFFFFF
# An empty last block, which ends a stream of flushed pieces.
_END = b"\x03\x00"
_ENTRY = "archive string, name string, method int, header long, packed long, size long, crc long"


def local_path(uri: str) -> str:
    """A mounted file's path from the URI that Spark has for it."""
    from urllib.parse import unquote, urlparse

    return unquote(urlparse(uri).path) if uri.startswith("file:") else uri


def entries(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(archive, name, method, header, packed, size, crc): the files in the archives at a path, from their directories alone; only those with one of the ``suffixes``, in either case, where given."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive in b.path:
                with zipfile.ZipFile(local_path(archive)) as z:
                    found = [i for i in z.infolist() if not i.is_dir() and (not suffixes or i.filename.lower().endswith(suffixes))]
                rows = [(archive, i.filename, i.compress_type, i.header_offset, i.compress_size, i.file_size, i.CRC) for i in found]
                yield pd.DataFrame(rows, columns=["archive", "name", "method", "header", "packed", "size", "crc"])

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(listed, _ENTRY)


def contents(found: DataFrame) -> DataFrame:
    """(archive, name, content) of entries(), dealt out by place, so that one archive's members are read by many tasks; ValueError where a member's checksum doesn't agree."""

    def inflated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, name, method, header, packed, size, crc in b[["archive", "name", "method", "header", "packed", "size", "crc"]].itertuples(index=False):
                with open(local_path(archive), "rb") as f:
                    f.seek(header)
                    head = f.read(30)
                    f.seek(sum(struct.unpack_from("<HH", head, 26)), 1)
                    raw = f.read(packed)
                if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{name}: method {method}")
                out = zlib.decompress(raw, -15, max(size, 1)) if method else raw
                if zlib.crc32(out) != crc:
                    raise ValueError(f"{name}: wrong checksum")
                yield pd.DataFrame({"archive": [archive], "name": [name], "content": [out]})

    # The entries are small, so Spark would put them together; their contents decide how many tasks there are.
    total, n = found.agg(F.coalesce(F.sum("packed"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(n, max(total // TASK_BYTES, found.sparkSession.sparkContext.defaultParallelism)))
    return found.repartition(int(tasks), "archive", "header").mapInPandas(inflated, "archive string, name string, content binary")


def crc_joined(a: int, b: int, length: int) -> int:
    """The CRC of two texts one after the other, from both CRCs and the second's length: the first is moved on by so many zero bytes, as a product modulo the CRC's polynomial."""

    def times(x: int, y: int) -> int:
        out = 0
        while x:
            if x & 0x80000000:
                out ^= y
            x = x << 1 & _BIG
            y = y >> 1 ^ (0xEDB88320 if y & 1 else 0)
        return out

    step, by = 0x00800000, 0x80000000  # x ** 8, and 1, the lowest power in the highest bit
    while length:
        if length & 1:
            by = times(step, by)
        step = times(step, step)
        length >>= 1
    return times(by, a) ^ b


def write(members: DataFrame, folder: str) -> DataFrame:
    """Writes (archive, name, piece, content), a member's content being its pieces in order, as ``folder``/archive; returns (archive, members, bytes).

    The rows are computed as asked for, once: the result is a table.  An archive
    appears under its name only when it is whole; its members are in the order of their
    names.  A null content is an empty one.
    """
    tables, folder = Tables(members.sparkSession), local_path(folder)
    parts = f"{folder}/.parts-{uuid.uuid4().hex}"

    def deflate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(parts, exist_ok=True)
        path = f"{parts}/{uuid.uuid4().hex}"  # one of this attempt's own
        with open(path, "wb") as out:
            for b in batches:
                rows = []
                for archive, name, piece, content in b[["archive", "name", "piece", "content"]].itertuples(index=False):
                    content = bytes(content or b"")
                    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
                    packed = packer.compress(content) + packer.flush(zlib.Z_FULL_FLUSH)
                    rows.append((archive, name, piece, path, out.tell(), len(packed), len(content), zlib.crc32(content)))
                    out.write(packed)
                yield pd.DataFrame(rows, columns=["archive", "name", "piece", "part", "at", "packed", "size", "crc"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        archive = pdf.archive.iloc[0]
        target = os.path.join(folder, archive)
        temporary = f"{target}.{uuid.uuid4().hex}.tmp"
        directory = []
        with open(temporary, "wb") as out:
            for name, own in pdf.sort_values(["name", "piece"]).groupby("name", sort=False):
                crc, start = 0, out.tell()
                for c, n in zip(own.crc, own["size"]):
                    crc = crc_joined(crc, int(c), int(n))
                packed, size = int(own.packed.sum()) + len(_END), int(own["size"].sum())
                out.write(_head(name, crc, packed, size, start, local=True))
                for part, at, n in zip(own.part, own["at"], own.packed):
                    with open(part, "rb") as f:
                        f.seek(at)
                        while n > 0:
                            n -= out.write(f.read(min(n, 1 << 20)))
                out.write(_END)
                directory.append(_head(name, crc, packed, size, start, local=False))
            start = out.tell()
            out.write(b"".join(directory))
            out.write(_foot(len(directory), out.tell() - start, start))
            total = out.tell()
        os.replace(temporary, target)
        return pd.DataFrame({"archive": [archive], "members": [len(directory)], "bytes": [total]})

    keys = ("archive", "name", "piece")
    dealt = members.select(*keys, "content").repartitionByRange(*keys).sortWithinPartitions(*keys)
    packed = tables.cut("packed", dealt.mapInPandas(deflate, "archive string, name string, piece long, part string, at long, packed long, size long, crc long"))
    done = tables.cut("archives", packed.groupBy("archive").applyInPandas(join, "archive string, members long, bytes long"))
    where = tables.spark._jvm.org.apache.hadoop.fs.Path(f"file://{parts}")
    where.getFileSystem(tables.spark._jsc.hadoopConfiguration()).delete(where, True)
    return done


def _head(name: str, crc: int, packed: int, size: int, start: int, local: bool) -> bytes:
    """A member's header before its content, or its entry of the directory; sizes that don't fit 32 bits stand in an extra field."""
    raw = name.encode()
    wide = [v for v in ((size, packed) if local else (size, packed, start)) if v >= _BIG]
    if local and wide:
        wide = [size, packed]
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    sizes = (_BIG, _BIG) if local and wide else (min(packed, _BIG), min(size, _BIG))
    common = struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 8, 0, 0x21, crc, *sizes, len(raw), len(extra))
    if local:
        return b"PK\x03\x04" + common + raw + extra
    return b"PK\x01\x02" + struct.pack("<H", 45) + common + struct.pack("<HHHII", 0, 0, 0, 0, min(start, _BIG)) + raw + extra


def _foot(n: int, length: int, start: int) -> bytes:
    """What ends the directory, in 64 bits too where numbers don't fit."""
    wide = b""
    if n >= 0xFFFF or length >= _BIG or start >= _BIG:
        wide = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start) + b"PK\x06\x07" + struct.pack("<IQI", 0, start + length, 1)
    return wide + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, _BIG), min(start, _BIG), 0)


def bundles(images: DataFrame, cameras: DataFrame, poses: DataFrame, points: DataFrame) -> DataFrame:
    """(archive, name, piece, content) of an archive for each model: its images/ and the three texts of its cameras, poses and points.

    images: (model, name, content); cameras: (model, line); poses: as image_lines()
    takes them, and points: as points3d_lines() does, both with their model.
    """
    from . import colmap

    def text(lines: DataFrame, name: str, order: str, block: int) -> DataFrame:
        piece = F.floor(F.col(order) / block)
        rows = F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda v: F.concat(v["line"], F.lit("\n")))  # a block's lines
        return lines.groupBy("model", piece.alias("piece")).agg(F.encode(F.array_join(rows, ""), "utf-8").alias("content")).select(F.concat("model", F.lit(".zip")).alias("archive"), F.lit(name).alias("name"), "piece", "content")

    drawn = images.select(F.concat("model", F.lit(".zip")).alias("archive"), F.concat(F.lit("images/"), F.col("name")).alias("name"), F.lit(0).cast("long").alias("piece"), "content")
    pose = colmap.image_text(poses).select("model", "image_id", F.concat("line", F.lit("\n")).alias("line"))
    place = colmap.points3d_lines(points, keys=("model",))
    return drawn.unionByName(text(cameras.withColumn("at", F.lit(0)), "cameras.txt", "at", 1)).unionByName(text(pose, "images.txt", "image_id", colmap.BLOCK)).unionByName(text(place, "points3D.txt", "id", colmap.BLOCK))
