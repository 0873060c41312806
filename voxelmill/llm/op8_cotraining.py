"""Quality classifier by co-training of two views.

A text view (words and symbols) and a metadata view (source, language, length)
each have a naive Bayes model.  Each round is one pass: every document that one
view is sure of is counted, with that label, into the other view's next model;
labelled documents count into both.  At the end both views are calibrated on
labelled documents held out of the training, joined by a logistic regression, and
score every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed_nb import Model, Tally, fit, summed, text_features
from .tables import read
from .textkit import slabs

BUCKETS, STRENGTH = 1 << 16, 2000.0
#: Labelled rows that training and calibration use at most, taken in the order of a hash of doc_id.
LABELLED_LIMIT = 20_000
ROUNDS, SURE, KEEP_FROM = 2, 0.97, 0.25
_META = ("source", "lang", "n_chars")
_META_BUCKETS = 1 << 12
SCORES = "p_text double, p_meta double, quality double, kept boolean"


def meta_features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of source, language and the length's half octave; a null is a value of its own."""
    from zlib import crc32

    n, buckets = batch.num_rows, []
    for k, name in enumerate(_META):
        values = batch.column(batch.schema.get_field_index(name)).to_pylist()
        if name == "n_chars":
            values = [None if v is None else int(2 * np.log2(max(v, 0) + 1)) for v in values]
        buckets.append(np.array([crc32(f"{k}:{v}".encode()) % _META_BUCKETS for v in values], np.int64))
    return np.repeat(np.arange(n), len(_META)), np.stack(buckets, axis=1).ravel() if n else np.empty(0, np.int64)


def log_odds(model: Model, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Log odds of class "1", by the root of the number of features, so that long texts stay comparable."""
    if len(model.labels) < 2:
        return np.zeros(n)
    total = model.totals(row, bucket, n)
    size = np.bincount(row, minlength=n)
    return (total[:, 1] - total[:, 0]) / np.sqrt(size + 1.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by Newton's method; x has few columns and a bounded number of rows."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[:-1] = 1.0 if not len(y) else 0.0
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    penalty = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def apply_logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))


class CoTrained:
    """Both views' models with their calibrations, and the weights that join them."""

    def __init__(self, text: Model, meta: Model, text_cal: np.ndarray, meta_cal: np.ndarray, joint: np.ndarray):
        self.text, self.meta, self.text_cal, self.meta_cal, self.joint = text, meta, text_cal, meta_cal, joint

    def raw(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """Of each slab: its part of the batch, both views' features and log odds."""
        for slab in slabs(batch.column(batch.schema.get_field_index("text"))):
            part = batch.slice(slab.first, slab.n)
            t, m = text_features(slab, BUCKETS), meta_features(part)
            yield part, t, m, log_odds(self.text, *t, slab.n), log_odds(self.meta, *m, slab.n)

    def views(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = apply_logistic(a[:, None], self.text_cal), apply_logistic(b[:, None], self.meta_cal)
        return p, q, apply_logistic(np.column_stack([a, b]), self.joint)


def _label_sample(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids with y ("0" or "1") and whether they calibrate; the size bounds the broadcast."""
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("q"))
    order = F.xxhash64("doc_id")
    return one.orderBy(order, "doc_id").limit(limit).select("doc_id", F.when(F.col("q") > 0, "1").otherwise("0").alias("y"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("cal"))


def _views(docs: DataFrame) -> DataFrame:
    """doc_id and what the views read; a metadata column that isn't there is null."""
    kinds = {"source": "string", "lang": "string", "n_chars": "long"}
    return docs.select("doc_id", "text", *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def train(docs: DataFrame, labels: DataFrame, limit: int = LABELLED_LIMIT, rounds: int = ROUNDS, sure: float = SURE) -> CoTrained:
    """Fit both views; every round's pseudo-labels come from all rows of ``docs``."""
    spark = docs.sparkSession
    rows = _views(docs).join(F.broadcast(_label_sample(labels, limit)), "doc_id", "left")
    labelled = rows.where("y IS NOT NULL")
    state: CoTrained | None = None
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(state)

        def count(batches: Iterator[pa.RecordBatch], shared=shared, first=r == 0) -> Iterator[pa.RecordBatch]:
            now, text, meta = shared.value, Tally(BUCKETS), Tally(_META_BUCKETS)
            reader = now or CoTrained(Model([], np.zeros((BUCKETS, 0)), np.zeros(0)), Model([], np.zeros((_META_BUCKETS, 0)), np.zeros(0)), np.zeros(2), np.zeros(2), np.zeros(3))
            for batch in batches:
                for part, t, m, a, b in reader.raw(batch):
                    y, cal = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("y", "cal"))
                    given = [None if c else v for v, c in zip(y, cal)]
                    p, q = (None, None) if first else now.views(a, b)[:2]

                    def told(by: np.ndarray | None) -> list:
                        if by is None:
                            return given
                        says = np.where(by >= sure, 1, np.where(by <= 1 - sure, 0, -1)).tolist()
                        return [g if g is not None or c else (str(s) if s >= 0 else None) for g, c, s in zip(given, cal, says)]

                    text.add(told(q), *t)
                    meta.add(told(p), *m)
            for k, tally in ((0, text), (1, meta)):
                for found in tally.rows():
                    yield pa.RecordBatch.from_arrays([pa.array([f"{k}{x}" for x in found.column(0).to_pylist()], pa.string()), found.column(1), found.column(2)], ["label", "bucket", "n"])

        counted = (labelled if r == 0 else rows).mapInArrow(count, "label string, bucket long, n long")
        _, counts, n = summed(counted, BUCKETS, ["00", "01", "10", "11"])
        text = fit(counts[:2], n[:2], ["0", "1"], STRENGTH)
        meta = fit(counts[2:, :_META_BUCKETS], n[2:], ["0", "1"], 20.0)
        state = CoTrained(text, meta, np.array([1.0, 0]), np.array([1.0, 0]), np.array([1.0, 1.0, 0]))
        _calibrate(labelled.where("cal"), state)
    return state


def _calibrate(held: DataFrame, state: CoTrained) -> None:
    """Fit the calibrations on the held-out labelled rows: three numbers of each, a bounded number of rows."""
    shared = held.sparkSession.sparkContext.broadcast(state)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, a, b in shared.value.raw(batch):
                y = [float(v) for v in part.column(part.schema.get_field_index("y")).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(y, pa.float64())], ["a", "b", "y"])

    t = held.mapInArrow(odds, "a double, b double, y double").orderBy("a", "b", "y").toArrow()
    a, b, y = (t.column(c).to_numpy() for c in ("a", "b", "y"))
    state.text_cal, state.meta_cal = logistic(a[:, None], y), logistic(b[:, None], y)
    state.joint = logistic(np.column_stack([a, b]), y)


def score(docs: DataFrame, state: CoTrained, threshold: float = KEEP_FROM) -> DataFrame:
    """doc_id, both views' calibrated probabilities of good quality, the joint one, and whether it reaches the threshold.

    A null text has no text features and is judged by its metadata; null metadata
    counts as a value, as does a metadata column that is missing; other columns are
    ignored.  Without labels of both classes nothing is learned and every row is kept.  Repeated rows get equal scores; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(state)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _, a, b in shared.value.raw(batch):
                p, q, joint = shared.value.views(a, b)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(q), pa.array(joint), pa.array(joint >= threshold)], ["doc_id", "p_text", "p_meta", "quality", "kept"])

    return _views(docs).mapInArrow(judge, f"doc_id long, {SCORES}")


def op8_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


QUERIES = {"op8_cotraining": op8_cotraining}
ORACLE_SQL: dict[str, str] = {}
