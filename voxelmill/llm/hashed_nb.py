"""Multinomial naive Bayes over hashed features, counted and scored by Spark.

Counting: each task adds its rows' features to one matrix of classes x buckets
and emits the entries that aren't zero; Spark sums them by key.  What comes to
the driver, and is broadcast, is that matrix alone: ``max_classes`` x ``buckets``
numbers at most, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import NOT_SPACE, Slab, span_hashes, words

MAX_CLASSES = 256
_PLAIN = np.array([b >= 0x80 or chr(b).isalnum() or b <= 32 for b in range(256)])


@dataclass
class Model:
    """Class names and log probabilities, one column for each class."""

    labels: list[str]
    log_p: np.ndarray
    prior: np.ndarray

    def totals(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Sum of log probabilities of each row's features, n x classes; features come in row order."""
        out = np.zeros((n, len(self.labels)))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[first]] = np.add.reduceat(self.log_p[bucket], first, axis=0)
        return out


def fit(counts: np.ndarray, docs: np.ndarray, labels: list[str], strength: float) -> Model:
    """Class distributions shrunk towards the distribution over all classes with ``strength`` pseudo-counts."""
    total = counts.sum(axis=0)
    shared = (total + 1.0) / (total.sum() + len(total))
    p = (counts + strength * shared) / (counts.sum(axis=1, keepdims=True) + strength)
    return Model(labels, np.ascontiguousarray(np.log(p).T), np.log((docs + 1.0) / (docs.sum() + len(labels))))


def summed(rows: DataFrame, buckets: int, labels: list[str] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, classes x buckets counts and rows per class from emitted (label, bucket, n); bucket -1 counts rows."""
    sums = rows.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = sums.toArrow()
    seen = table.column("label").to_pylist()
    labels = sorted(set(seen)) if labels is None else labels
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{len(labels)} classes; a model holds {MAX_CLASSES} at most")
    place = {x: i for i, x in enumerate(labels)}
    k = np.array([place[x] for x in seen], np.int64)
    b, n = (table.column(c).to_numpy() for c in ("bucket", "n"))
    counts, docs = np.zeros((len(labels), buckets)), np.zeros(len(labels))
    if len(k):
        real = b >= 0
        counts[k[real], b[real]] = n[real]
        docs[k[~real]] = n[~real]
    return labels, counts, docs


class Tally:
    """A task's counts by label; ``rows()`` gives what isn't zero."""

    def __init__(self, buckets: int):
        self.buckets, self.by, self.docs = buckets, {}, {}

    def add(self, labels: list, row: np.ndarray, bucket: np.ndarray) -> None:
        """Count the features of rows with a label; ``labels`` has one, or None, for each row."""
        names = sorted({x for x in labels if x is not None})
        code = {x: i for i, x in enumerate(names)}
        of_row = np.array([-1 if x is None else code[x] for x in labels], np.int64)
        k = of_row[row]
        for x, i in code.items():
            if x not in self.by:
                if len(self.by) >= MAX_CLASSES:
                    raise ValueError(f"more than {MAX_CLASSES} classes")
                self.by[x], self.docs[x] = np.zeros(self.buckets, np.int64), 0
            self.by[x] += np.bincount(bucket[k == i], minlength=self.buckets)
            self.docs[x] += int((of_row == i).sum())

    def rows(self) -> Iterator[pa.RecordBatch]:
        for x, counts in self.by.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[at], self.docs[x]), pa.int64())],
                ["label", "bucket", "n"],
            )


def count_features(docs: DataFrame, buckets: int, each: Callable[[pa.RecordBatch], Iterator[tuple[list, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(label, bucket, n) rows of what ``each`` gives for a batch: labels by row, and features as rows and buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(buckets)
        for batch in batches:
            for labels, row, bucket in each(batch):
                tally.add(labels, row, bucket)
        yield from tally.rows()

    return docs.mapInArrow(count, "label string, bucket long, n long")


def text_features(slab: Slab, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets, in row order: each word (A-Z folded, outer punctuation kept), each symbol, each word that repeats the one before."""
    w = words(slab, NOT_SPACE)
    h = span_hashes(slab, w.start, w.end, fold=True)
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])) + 1
    symbol = np.flatnonzero(~_PLAIN[slab.buf])
    row = np.concatenate([w.row, w.row[again], np.searchsorted(slab.off, symbol, "right") - 1])
    room = buckets - 256
    bucket = np.concatenate([(h % np.uint64(room)).astype(np.int64), np.full(len(again), room + 255, np.int64), room + slab.buf[symbol].astype(np.int64)])
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)
