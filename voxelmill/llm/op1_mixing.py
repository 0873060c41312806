"""Mixing to target weights by soft membership.

A classifier learned from a labelled table predicts each document's posterior over
domains, so a document belongs to several domains in part.  Nonnegative document
rates are then fitted by projected-gradient least squares, such that the expected
tokens of each domain, summed over rate x tokens x posterior, match the targets.
A document's rate after any number of steps follows from its own tokens and
posterior and the steps' residuals alone, a few numbers for each domain; so a step
is one distributed sum, and no state of the documents is kept between steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashed_nb import Model, count_features, fit, softmax, summed, text_features
from .tables import read, written
from .textkit import NOT_SPACE, Slab, slabs, words

BUCKETS, STRENGTH = 1 << 18, 200.0
#: Deviations from the expected count by which a feature must stand out in some domain: so many at least, and
#: so many times the root of the labelled documents, which is the same strength of a feature at every size.
CHANCE, TELLING = 4.5, 0.075
#: Labelled rows that the classifier is fitted on at most, taken in the order of a hash of doc_id.
LABELLED_LIMIT = 20_000
STEPS, CLOSE = 200, 1e-4
#: Target share of the tokens for each domain of the labels table.
TARGETS = {"good": 0.85, "poor": 0.08, "toxic": 0.07}


def features(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of each row's distinct features, in row order."""
    row, bucket = text_features(slab, BUCKETS)
    both = np.unique(row * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def telling(model: Model, counts: np.ndarray, docs: np.ndarray) -> Model:
    """The model with all features left out that are about as frequent in every domain: what chance gives them would drown the others in a long text."""
    total = counts.sum(axis=0)
    expected = total * (counts.sum(axis=1, keepdims=True) / max(counts.sum(), 1.0))
    deviation = (np.abs(counts - expected) / np.sqrt(expected + 1.0)).max(axis=0, initial=0.0)
    stands_out = deviation > max(CHANCE, TELLING * np.sqrt(docs.sum()))
    return Model(model.labels, np.where(stands_out[:, None], model.log_p, 0.0), model.prior)


@dataclass
class Classifier:
    """Posterior of each domain; ``heat`` is the calibrated weight of the text's log odds."""

    model: Model
    heat: float

    def of(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Of each slab: its part of the batch, posteriors, and tokens (words between white space)."""
        for slab in slabs(batch.column(at)):
            x = self.model.totals(*features(slab), slab.n)
            yield batch.slice(slab.first, slab.n), softmax(self.heat * x + self.model.prior), words(slab, NOT_SPACE).count()


def train(docs: DataFrame, labelled: DataFrame, limit: int = LABELLED_LIMIT) -> Classifier:
    """A classifier from ``labelled`` (doc_id, domain), of which a bounded sample is used; a quarter of it sets the heat."""
    one = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isNotNull()).groupBy("doc_id").agg(F.max(F.col("domain").cast("string")).alias("domain"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "domain", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("cal"))

    def each(batch: pa.RecordBatch) -> Iterator[tuple]:
        for slab in slabs(batch.column(0)):
            yield batch.column(1).slice(slab.first, slab.n).to_pylist(), *features(slab)

    labels, counts, n = summed(count_features(rows.where("NOT cal"), BUCKETS, each), BUCKETS)
    found = Classifier(telling(fit(counts, n, labels, STRENGTH), counts, n), 1.0)
    if len(labels) < 2:
        return found
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.model
        for batch in batches:
            for slab in slabs(batch.column(0)):
                x = m.totals(*features(slab), slab.n)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(slab.first, slab.n), pa.array(list(x), pa.list_(pa.float64()))], ["domain", "x"])

    t = rows.where("cal").mapInArrow(held, "domain string, x array<double>").orderBy("domain", "x").toArrow()
    known = [(labels.index(d), x) for d, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist()) if d in labels]
    if known:
        found.heat, found.model.prior = calibrated(np.array([v for _, v in known]), np.array([k for k, _ in known]), found.model.prior)
    return found


def calibrated(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> tuple[float, np.ndarray]:
    """The heat and the domains' offsets with the least log loss on held-out log odds x and domains y.

    The offsets tell how likely a domain is where a text has none of its features;
    a class that isn't held out keeps a share of half a row.
    """
    share = (np.bincount(y, minlength=len(prior)) + 0.5) / (len(y) + 0.5 * len(prior))
    best = (np.inf, 1.0, prior)
    for heat in np.geomspace(0.05, 20, 40):
        offset = prior.copy()
        for _ in range(100):
            p = softmax(heat * x + offset)
            offset -= np.clip((p.mean(axis=0) - share) / ((p * (1 - p)).mean(axis=0) + 1e-6), -1.0, 1.0)
        loss = -np.log(softmax(heat * x + offset)[np.arange(len(y)), y] + 1e-12).mean()
        best = min(best, (loss, float(heat), offset), key=lambda b: b[0])
    return best[1:]


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, n_tokens and posterior of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, p, n in shared.value.of(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(list(p), pa.list_(pa.float64()))], ["doc_id", "n_tokens", "posterior"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, n_tokens long, posterior array<double>")


def rates_after(posterior: np.ndarray, steps: np.ndarray, max_rate: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps, and where the next step starts.

    Each step moves along -posterior . step and is projected on [0, max_rate]; it
    starts ahead of the last rates by a part of the last move (Nesterov's momentum).
    """
    rate = ahead = np.ones(len(posterior))
    for t, step in enumerate(steps):
        moved = np.clip(ahead - posterior @ step, 0.0, max_rate)
        rate, ahead = moved, moved + t / (t + 3) * (moved - rate)
    return rate, ahead


def rate_of(posterior: np.ndarray, steps: np.ndarray, max_rate: float | None) -> np.ndarray:
    return rates_after(posterior, steps, max_rate)[0]


def fit_rates(members: DataFrame, targets: np.ndarray, max_rate: float | None = None, steps: int = STEPS, close: float = CLOSE) -> tuple[np.ndarray, np.ndarray]:
    """Steps of projected gradient descent on the squared residuals tokens - targets, and the tokens they lead to.

    Rates start at 1; distances between rates are weighted by tokens, residuals by
    the inverse of the domain's tokens.  As a document's posteriors sum to 1 the
    Hessian's largest eigenvalue is 1 at most, so steps of length 1 descend.  It
    stops when every domain is within ``close`` of the target total, when a step
    changes next to nothing, or at the last step (targets may be out of reach).
    """
    k = len(targets)
    done: list[np.ndarray] = []

    def summed_up(each: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += each(batch.column(0).to_numpy(), np.array(batch.column(1).flatten().to_numpy()).reshape(-1, k))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], ["at", "value"])

        out = np.zeros(size)
        for at, value in members.select("n_tokens", "posterior").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
            out[at] = value
        return out

    def tokens_after(now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def each(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.concatenate([(r * n) @ p for r in rates_after(p, now, max_rate)])

        return tuple(summed_up(each, 2 * k).reshape(2, k))

    tokens = start = tokens_after(np.zeros((0, k)))[0]
    mass, total = np.maximum(tokens, 1e-9), max(tokens.sum(), 1e-9)
    while len(done) < steps and np.abs(tokens - targets).max() > close * max(targets.sum(), 1e-9):
        done.append((start - targets) / mass)
        after, start = tokens_after(np.array(done))
        still = np.abs(after - tokens).max() <= close / 10 * total
        tokens = after
        if still:
            break
    return np.array(done).reshape(-1, k), tokens


def aims(mass: np.ndarray, labels: list[str], weights: dict[str, float], spare: bool) -> np.ndarray:
    """Target tokens of each domain: the weights' shares of the input's tokens or, ``spare``, of as many as no domain needs to be repeated for."""
    share = np.array([weights.get(x, 0.0) for x in labels])
    if share.sum() <= 0:
        raise ValueError(f"no weight for any of the domains {labels}")
    share = share / share.sum()
    total = mass.sum()
    if spare:
        total = min(total, min(m / s for m, s in zip(mass, share) if s > 0))
    return share * total


@dataclass
class Mix:
    """What rates follow from: the classifier and the steps; and what was asked for and reached.

    ``targets`` and ``tokens`` are the target and the fitted tokens of each domain of
    the classifier's labels; ``reached`` tells whether they agree within CLOSE.
    """

    classifier: Classifier
    steps: np.ndarray
    targets: np.ndarray
    tokens: np.ndarray
    max_rate: float | None

    @property
    def reached(self) -> bool:
        return bool(np.abs(self.tokens - self.targets).max() <= CLOSE * max(self.targets.sum(), 1e-9))

    def totals(self, spark: SparkSession) -> DataFrame:
        """(domain, target_tokens, tokens): a row for each domain."""
        return spark.createDataFrame(list(zip(self.classifier.model.labels, self.targets.tolist(), self.tokens.tolist())), "domain string, target_tokens double, tokens double")


def halved(*domains: str) -> Callable[[dict[str, float]], dict[str, float]]:
    """Weights that halve the given domains' present tokens and keep the others'."""
    return lambda mass: {k: v / 2 if k in domains else v for k, v in mass.items()}


def fit_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | Callable | None = None, max_rate: float | None = None, limit: int = LABELLED_LIMIT) -> Mix | None:
    """Fit rates to ``weights`` (domain -> share, or a function of the present tokens by domain); None if nothing is labelled, when all rates are 1.

    Weights of domains that no label names are ignored, domains without a weight
    get none.  With ``max_rate`` 1 the target total is what needs no repeats.
    """
    classifier = train(docs, labelled, limit)
    labels = classifier.model.labels
    if not labels:
        return None
    members = written(memberships(docs, classifier))
    mass = members.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]) for i in range(len(labels))]).first()
    mass = np.array([x or 0.0 for x in mass])
    if mass.sum() <= 0:
        return None
    weights = TARGETS if weights is None else weights(dict(zip(labels, mass))) if callable(weights) else weights
    targets = aims(mass, labels, weights, max_rate is not None and max_rate <= 1)
    steps, tokens = fit_rates(members, targets, max_rate)
    return Mix(classifier, steps, targets, tokens, max_rate)


def rates(docs: DataFrame, mix: Mix | None) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (its), rate of each row, and whether the fitted rates reach the targets (targets may be out of reach, or STEPS too few).

    A null or empty text has no tokens; its posterior is the prior and its rate
    follows from that.  Repeated rows get equal rates.  Without labels domain,
    posterior and reached are null and the rate is 1.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(mix)
    names = ["doc_id", "n_tokens", "domain", "posterior", "rate"]
    reached = F.lit(None if mix is None else mix.reached).cast("boolean").alias("reached")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                for slab in slabs(batch.column(1)):
                    none = pa.nulls(slab.n)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.first, slab.n), pa.array(words(slab, NOT_SPACE).count()), none.cast(pa.string()), none.cast(pa.float64()), pa.array(np.ones(slab.n))], names)
                continue
            for part, p, n in m.classifier.of(batch, 1):
                best = np.argmax(p, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array([m.classifier.model.labels[k] for k in best.tolist()], pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(rate_of(p, m.steps, m.max_rate))], names
                )

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, n_tokens long, domain string, posterior double, rate double").select("*", reached)


def mixed(docs: DataFrame, mix: Mix | None, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, all their columns, each as often as its rate says: the whole part, and one more with the fraction's probability by a hash of doc_id.

    A null or empty text is judged by the domains' offsets alone; rows with a null
    doc_id share one draw; repeated rows are drawn alike; an empty table gives no
    rows; without a mix every row is kept once.  Columns may have any names.
    """
    if mix is None:
        return docs
    shared, columns = docs.sparkSession.sparkContext.broadcast(mix), docs.columns
    at = columns.index("text")
    name = "chance"
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    seeded = docs.withColumn(name, (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30))

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, p, _ in m.classifier.of(batch, at):
                rate = rate_of(p, m.steps, m.max_rate)
                copies = (np.floor(rate) + (part.column(len(columns)).to_numpy() < rate - np.floor(rate))).astype(np.int64)
                yield part.select(list(range(len(columns)))).take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    return seeded.mapInArrow(repeat, docs.schema)


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, else good or poor by quality."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").when(F.col("quality").isNotNull(), "poor").alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return rates(docs, fit_mix(docs, label_domains(read(spark, sf_dir, "labels"))))


QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL: dict[str, str] = {}
