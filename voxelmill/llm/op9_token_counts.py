"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with the library's offsets.  Two
neighbouring chunks are spliced at a boundary inside their overlap that both
encodings share and that is proven stable: a single space between two characters
that are not white space, where the splitting rule always starts a new piece, so
that neither side's ids depend on the other's text.  Where an overlap has no such
place the chunk is widened until it has one or the text ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import _CUT, Encoder, encoder, tokenizer_path
from .tables import read

VOCABULARY = "byte_bpe_50k.json"
CHUNK, OVERLAP = 32_768, 512


def count_huge(enc: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks of ``chunk`` characters.

    Special strings are tokens of their own, and what stands between them is encoded
    apart.  Under a splitting rule without stable boundaries, or with special strings
    that take their surroundings with them, a text is encoded whole.
    """
    if not enc.by_piece:
        return len(enc.whole(text))
    if any(s in text for s in enc.special):
        if enc.special_rule is None:
            return len(enc.whole(text))
        total, at = 0, 0
        for m in enc.special_rule.finditer(text):
            total += count_huge(enc, text[at : m.start()], chunk, overlap) + 1
            at = m.end()
        return total + count_huge(enc, text[at:], chunk, overlap)
    if not text:
        return 0
    total, at, width = 0, 0, overlap
    coded = None  # (start, offsets) of the chunk that begins at a proven boundary
    while True:
        end = min(len(text), at + chunk + width)
        if coded is None:
            coded = _offsets(enc, text[at:end])
        if end == len(text):
            return total + len(coded)
        splice = _splice(enc, text, at, coded, end - width, end)
        if splice is None:
            width *= 2
            coded = None
            continue
        left, at, coded, width = *splice, None, overlap
        total += left


def _offsets(enc: Encoder, text: str) -> np.ndarray:
    """First character of each token."""
    return np.array([a for a, _ in enc.library.encode(text, add_special_tokens=False).offsets], np.int64)


def _splice(enc: Encoder, text: str, at: int, left: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """Tokens before the first stable boundary in [low, high) that both chunks have, and its place."""
    right = None
    for m in _CUT.finditer(text, max(low, at + 1), high):
        p = m.start()
        k = int(np.searchsorted(left, p - at))
        if right is None:
            right = low + _offsets(enc, text[low:high])
        # the token of a lone space starts at the space, or after it where offsets leave it out
        in_left = k < len(left) and left[k] - (p - at) in (0, 1)
        j = int(np.searchsorted(right, p))
        in_right = j < len(right) and right[j] - p in (0, 1)
        if in_left and in_right:
            return k, p
    return None


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; other columns of ``docs`` don't matter.

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows are counted
    each.  An empty table gives no rows.  No text is cut off.
    """
    name = vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), np.int64)
            for lo in range(0, len(texts), 512):
                short = [i for i in range(lo, min(lo + 512, len(texts))) if len(texts[i]) <= chunk]
                for i, ids in zip(short, enc.encode_many([texts[i] for i in short])):
                    n[i] = len(ids) // 4
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = count_huge(enc, t, chunk, overlap)
            size = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    tokenizer_path(name)
    return docs.select("doc_id", text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE_SQL: dict[str, str] = {}
