"""Archives against the standard library's reader and writer."""

import io
import os
import random
import zipfile
import zlib

import pytest

from voxelmill.sources import archives

MEMBERS = "archive string, name string, piece long, content binary"


def test_checksums_of_joined_texts():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (rng.randbytes(rng.choice((0, 1, 7, 1000))) for _ in range(2))
        assert archives.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_pieces_become_members_that_any_reader_opens(spark, tmp_path):
    rng = random.Random(2)
    whole = {("a.zip", "dir/ü.txt"): [rng.randbytes(70_000) for _ in range(5)], ("a.zip", "b.txt"): [b"line\n" * 9], ("b.zip", "empty"): [None], ("b.zip", "c.png"): [b"", b"x"]}
    rows = [(a, n, k, p) for (a, n), parts in whole.items() for k, p in enumerate(parts)]
    rng.shuffle(rows)
    done = archives.write(spark.createDataFrame(rows, MEMBERS).repartition(4), f"file://{tmp_path}/out").collect()
    assert sorted((r.archive, r.members) for r in done) == [("a.zip", 2), ("b.zip", 2)] and sorted(os.listdir(tmp_path / "out")) == ["a.zip", "b.zip"]
    for name, n in ((r.archive, r.bytes) for r in done):
        assert os.path.getsize(tmp_path / "out" / name) == n
        with zipfile.ZipFile(tmp_path / "out" / name) as z:
            assert z.testzip() is None
            assert {(name, i): z.read(i) for i in z.namelist()} == {k: b"".join(p or b"" for p in v) for k, v in whole.items() if k[0] == name}
    found = archives.contents(archives.entries(spark, f"{tmp_path}/out/*.zip"))
    assert {(r.archive.rsplit("/", 1)[1], r.name): bytes(r.content) for r in found.collect()} == {k: b"".join(p or b"" for p in v) for k, v in whole.items()}
    assert [r.name for r in archives.entries(spark, f"{tmp_path}/out/*.zip", (".png", ".TXT".lower())).orderBy("name").collect()] == ["b.txt", "c.png", "dir/ü.txt"]
    assert archives.write(spark.createDataFrame([], MEMBERS), f"{tmp_path}/none").count() == 0


def test_archives_of_other_writers_and_damaged_ones(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "other archive.zip", "w") as z:
        z.writestr("stored", b"s" * 100, zipfile.ZIP_STORED)
        z.writestr("deflated", b"d" * 10_000, zipfile.ZIP_DEFLATED)
        z.mkdir("folder")
        z.comment = b"with a comment"
    df = archives.entries(spark, f"{tmp_path}/*.zip")
    assert {r.name: bytes(r.content) for r in archives.contents(df).collect()} == {"stored": b"s" * 100, "deflated": b"d" * 10_000}
    raw = bytearray((tmp_path / "other archive.zip").read_bytes())
    raw[raw.index(b"ssss")] ^= 1
    (tmp_path / "other archive.zip").write_bytes(raw)
    with pytest.raises(Exception, match="wrong checksum"):
        archives.contents(df).collect()


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(200):
            z.writestr(f"{i}.txt", str(i))
    got = archives.contents(archives.entries(spark, f"{tmp_path}/many.zip")).selectExpr("spark_partition_id() AS p", "cast(decode(content, 'utf-8') AS int) AS v").collect()
    assert sorted(r.v for r in got) == list(range(200)) and len({r.p for r in got}) > 1


def test_directories_beyond_the_old_limits():
    out, directory = io.BytesIO(), []
    for i in range(70_000):
        start = out.tell()
        out.write(archives._head(f"m{i}", 0, len(archives._END), 0, start, True) + archives._END)
        directory.append(archives._head(f"m{i}", 0, len(archives._END), 0, start, False))
    start = out.tell()
    out.write(b"".join(directory))
    out.write(archives._foot(70_000, out.tell() - start, start))
    with zipfile.ZipFile(out) as z:
        assert len(z.namelist()) == 70_000 and z.read("m69999") == b""
    wide = zipfile.ZipInfo()
    raw = archives._head("big", 1, 5 << 32, 6 << 32, 7 << 32, False)
    n, extra = int.from_bytes(raw[28:30], "little"), int.from_bytes(raw[30:32], "little")
    wide.extra, wide.file_size, wide.compress_size, wide.header_offset = raw[46 + n : 46 + n + extra], 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF
    wide._decodeExtra(0)
    assert (wide.file_size, wide.compress_size, wide.header_offset) == (6 << 32, 5 << 32, 7 << 32)
