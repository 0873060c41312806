"""Token-id output by bit-plane shuffling.

A dataset of chunks: each row holds whole documents' ids, laid out as fixed-size
blocks of ids.  A block is transposed into byte planes (or bit planes), each plane
compressed with zstandard by itself; a block's planes of zeros take nothing.  The
chunk's index columns (first document's place, counts, block sizes) can be read
without its planes.  Spark's own writer commits the files, so a lost executor's
task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_path
from .tables import gone_at_exit, read, shared_dir

VOCABULARY = "byte_bpe_50k.json"
BLOCK = 1 << 15  #: ids in a block
CHUNK_IDS = 1 << 19  #: a chunk is closed when it has so many ids
#: Characters of a text by which rows with one doc_id are ordered.
FIRST = 32
CHUNK_SCHEMA = "part int, chunk int, chunk_start long, n_ids long, doc_ids array<long>, doc_lens array<long>, block_ids int, plane_kind string, plane_sizes array<int>, planes binary"


def encode_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> tuple[list[int], bytes]:
    """Sizes and bytes of the compressed planes of a chunk, block after block; a size of 0 is a plane of zeros."""
    if kind not in ("byte", "bit"):
        raise ValueError(f"plane kind {kind!r} is neither byte nor bit")
    squeeze, sizes, out = zstandard.ZstdCompressor(level=level), [], []
    for at in range(0, len(ids), BLOCK):
        planes = ids[at : at + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4).T
        if kind == "bit":
            planes = np.concatenate([np.packbits((p[None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=1) for p in planes])
        for plane in planes:
            packed = squeeze.compress(np.ascontiguousarray(plane).tobytes()) if plane.any() else b""
            sizes.append(len(packed))
            out.append(packed)
    return sizes, b"".join(out)


def decode_planes(n: int, kind: str, sizes: list[int], data: bytes, block: int = BLOCK) -> np.ndarray:
    """The ids that encode_planes() laid out."""
    expand, ids, at, k = zstandard.ZstdDecompressor(), np.zeros(n, "<u4"), 0, 0
    per = 4 if kind == "byte" else 32
    for lo in range(0, n, block):
        m = min(block, n - lo)
        planes = np.zeros((per, m if kind == "byte" else (m + 7) // 8), np.uint8)
        for p in range(per):
            if sizes[k]:
                planes[p] = np.frombuffer(expand.decompress(data[at : at + sizes[k]]), np.uint8)
                at += sizes[k]
            k += 1
        if kind == "bit":
            bits = np.unpackbits(planes, axis=1, count=m).reshape(4, 8, m)
            planes = (bits << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8)
        ids[lo : lo + m] = np.ascontiguousarray(planes.T).view("<u4")[:, 0]
    return ids


def write_ids(docs: DataFrame, path: str, parts: int, text: str = "text", vocabulary: str = VOCABULARY, end_id: int = 0, plane_kind: str = "byte", block_chunk: int = CHUNK_IDS) -> None:
    """Encode every row's text, append end_id, and write the ids in ascending doc_id order.

    A null text is an empty one: its ids are just the end id.  Rows with equal
    doc_id stand beside each other, ordered by the text's first characters, then by
    a hash of it; a null doc_id comes first.  Rows of one doc_id, and even equal
    rows, can be many tasks' work, as parts are cut by all of these.  An empty table
    writes a dataset without chunks.  Other columns are ignored.
    """
    tokenizer_path(vocabulary)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number, start, held, docs_in, lens = 0, 0, [], [], []

        def chunk() -> pa.RecordBatch:
            nonlocal number, start, held, docs_in, lens
            ids = np.frombuffer(b"".join(held), "<u4")
            sizes, data = encode_planes(ids, plane_kind)
            row = {"part": part, "chunk": number, "chunk_start": start, "n_ids": len(ids), "doc_ids": docs_in, "doc_lens": lens, "block_ids": BLOCK, "plane_kind": plane_kind, "plane_sizes": sizes, "planes": data}
            number, start, held, docs_in, lens = number + 1, start + len(ids), [], [], []
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                for key, ids in zip(keys[lo : lo + 256], enc.encode_many([t or "" for t in texts[lo : lo + 256]])):
                    held += (ids, end)
                    docs_in.append(key)
                    lens.append(len(ids) // 4 + 1)
                    size += lens[-1]
                    if size >= block_chunk:
                        yield chunk()
                        size = 0
        if held:
            yield chunk()

    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("chunk_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("plane_kind", pa.string()), ("plane_sizes", pa.list_(pa.int32())), ("planes", pa.binary())])
    # Short keys, as a sample of them goes to the driver; the last tells equal rows apart, whose order doesn't matter.
    order = [F.col("doc_id"), F.substring("text", 1, FIRST).alias("first"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie")]
    keyed = docs.select("doc_id", F.col(text).alias("text")).select("text", *order)
    ordered = keyed.repartitionByRange(parts, "doc_id", "first", "hash", "tie").sortWithinPartitions("doc_id", "first", "hash", "tie").select("doc_id", "text")
    ordered.mapInArrow(chunks, CHUNK_SCHEMA).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files: a row for each document with start, n_tokens, ids_crc32 and its ids (binary, little-endian 32-bit).

    ``start`` counts the ids of all documents before it: those of earlier parts
    (from the index alone), of earlier chunks of the part, and of the chunk.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row for each part file, as many as the writer had tasks: some 100,000 at 100 TB in parts of 1 GB
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = decode_planes(row["n_ids"], row["plane_kind"], row["plane_sizes"], row["planes"], row["block_ids"]).tobytes()
                lens = np.array(row["doc_lens"], np.int64)
                ends = np.cumsum(lens)
                raw = [ids[4 * a : 4 * b] for a, b in zip((ends - lens).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(raw), pa.int32()), pa.array(row["chunk_start"] + ends - lens), pa.array(lens), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())],
                    ["doc_id", "part", "in_part", "n_tokens", "ids_crc32", "ids"],
                )

    rows = chunks.mapInArrow(documents, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, path: str | None = None, text: str = "text", plane_kind: str = "byte", parts: int | None = None) -> DataFrame:
    """Write all ids of ``docs`` and return the digest of each document as the files have it; as many parts as the input has, unless given.  Without a ``path`` the files stay until the application ends.

    A null or empty text is the end id alone; repeated rows and equal or null
    doc_ids have a row each (see write_ids() for their order); an empty table gives
    no rows; columns besides doc_id and the text are ignored.
    """
    spark = docs.sparkSession
    own = path or shared_dir(spark)
    write_ids(docs, own, parts or max(1, docs.rdd.getNumPartitions()), text, plane_kind=plane_kind)
    if path is None:
        gone_at_exit(spark, own)
    return read_ids(spark, own, with_ids=False)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(read(spark, sf_dir, "documents"))


QUERIES = {"op2_token_output": op2_token_output}
ORACLE_SQL: dict[str, str] = {}
