"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x languages, a bounded size) is broadcast; a
task scores slab by slab, gathering the matrix's rows for all n-grams and summing
them by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed_nb import count_features, fit, softmax, summed
from .tables import read
from .textkit import Slab, char_count, mix, slabs

BUCKETS, ORDERS, STRENGTH = 1 << 15, (1, 2, 3), 200.0
UNKNOWN = "und"
_SLAB_BYTES = 1 << 19


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter; its lower case where that is one code point."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x24F0):
        x = chr(c).lower()
        if len(x) == 1:
            lower[c] = ord(x)
    return letter, lower


def ngrams(slab: Slab, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all character n-grams in row order, and which rows have a letter; other characters count as one space class."""
    letter, lower = _tables()
    raw = slab.buf.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(raw.encode("utf-32-le", "replace"), np.uint32)
    off = char_count(slab)[slab.off]
    is_letter = letter[points]
    sums = np.zeros(len(points) + 1, np.int64)
    np.cumsum(is_letter, out=sums[1:])
    spoken = sums[off[1:]] > sums[off[:-1]]
    value = np.where(is_letter, lower[points], 32).astype(np.uint64)
    row_of = np.repeat(np.arange(slab.n), np.diff(off))
    rows, codes = [], []
    for n in orders:
        m = len(value) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + value[j : m + j]
        inside = row_of[:m] == row_of[n - 1 :]
        rows.append(row_of[:m][inside])
        codes.append((mix(h[inside]) >> np.uint64(32)).astype(np.int64) % buckets)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), spoken
    return np.concatenate(rows), np.concatenate(codes), spoken


def train(docs: DataFrame, label: str = "lang", text: str = "text", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
    """A model from all rows of ``docs`` with a text and a label."""

    def each(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        for slab in slabs(batch.column(0), _SLAB_BYTES):
            row, bucket, _ = ngrams(slab, orders, buckets)
            yield batch.column(1).slice(slab.first, slab.n).to_pylist(), row, bucket

    known = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(text, F.col(label).cast("string"))
    labels, counts, n = summed(count_features(known, buckets, each), buckets)
    return fit(counts, n, labels, STRENGTH)


def predict(docs: DataFrame, model, text: str = "text", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """The columns of ``docs`` but its text, with lang_pred and score (the posterior of lang_pred, 0 to 1), which replace columns of those names.

    A null text, a text without a letter, or a model without classes gives ``und``
    and 0.  Equal posteriors go to the first label in order.  Repeated rows get
    equal results; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for slab in slabs(batch.column(len(kept)), _SLAB_BYTES):
                pred, p = [UNKNOWN] * slab.n, np.zeros(slab.n)
                if m.labels:
                    row, bucket, spoken = ngrams(slab, orders, buckets)
                    total = np.zeros((slab.n, len(m.labels)))
                    begins = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
                    if len(row):
                        np.add.at(total, row[begins], np.add.reduceat(m.log_p[bucket], begins, axis=0))
                    posterior = softmax(total + m.prior)
                    best = np.argmax(posterior, axis=1)
                    pred = [m.labels[k] if s else UNKNOWN for k, s in zip(best.tolist(), spoken.tolist())]
                    p = np.where(spoken, posterior[np.arange(slab.n), best], 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(slab.first, slab.n) for c in batch.columns[:-1]), pa.array(pred, pa.string()), pa.array(p)], [*kept, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema) + ", lang_pred string, score double"
    return docs.select(*kept, text).mapInArrow(score, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned where crc32(doc_id) mod 3 isn't 1; a null doc_id is neither held out nor learned from."""
    docs = read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs.where(fold != 1))
    return predict(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model)


QUERIES = {"op7_language": op7_language}
ORACLE_SQL: dict[str, str] = {}
