"""Language-model scores by the lattice of subword segmentations.

A text's probability is the sum over all ways to cut its words into pieces of an
existing vocabulary, each way weighing the product of its pieces' probabilities;
the sum is worked out by a forward recursion in log space.  A piece never crosses
the start of a word, so all ways meet there, the text's sum is the product of its
words', and each distinct word's lattice is worked out once for the whole corpus.

The pieces' probabilities begin with the vocabulary's scores.  Those of a unigram
vocabulary are log probabilities and stand as they are.  Those of a merge vocabulary
are ranks; a piece of rank k then weighs 1 / (k + OFFSET).  Training texts adapt them:
pieces are counted as often as they are expected in all segmentations of all
training words (``rounds`` times), and the vocabulary's own probabilities count as
one more occurrence of each piece.

Words are numbered by blocks of texts.  A word's count and lattice meet the blocks
that have it by a join on the word, and a block's values meet its texts by the
block: what is shuffled is one row for each distinct word of a block, and nothing
that grows with the corpus is broadcast or held by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import tokenizer_path
from .lattice import Lattice, Trie, marked, trie
from .tables import Scratch, read, small_batches, written
from .textkit import NOT_SPACE, slabs, words

VOCABULARY = "piece_bpe_32k.model"
#: Documents whose id's crc32 has this remainder are held out of training.
MODULUS, HELD_OUT = 7, 2
#: Added to the rank of a piece of a merge vocabulary, so that the first few don't take all.
OFFSET = 100.0
ROUNDS = 1
#: Text of one block.
_BLOCK_BYTES = 12 << 20
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BLOCKS = "block long, word string, pos int, n int, doc_id array<long>, held array<boolean>, size array<int>, codes binary"


def vocabulary_weights(vocabulary: str = VOCABULARY) -> tuple[list[bytes], np.ndarray]:
    """The distinct strings of a sentencepiece vocabulary, all single bytes among them, and their probabilities."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    text = [i for i in ids if not model.is_byte(i)]
    score = np.array([model.get_score(i) for i in text])
    if 0.5 <= np.exp(np.minimum(score, 1)).sum() <= 1.5:
        weight = np.exp(score)
    else:
        weight = np.empty(len(text))
        weight[np.argsort(-score, kind="stable")] = 1 / (OFFSET + np.arange(len(text)))
    strings = {model.id_to_piece(i).encode(): w for i, w in zip(text, weight.tolist())}
    least = min(strings.values(), default=1.0)
    for b in range(256):  # any text has a segmentation
        strings[bytes([b])] = strings.get(bytes([b]), 0.0) + least
    weights = np.array(list(strings.values()))
    return list(strings), weights / weights.sum()


def _held(doc_id: object) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS == HELD_OUT


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of about ``most`` bytes, over the bounds of batches; nulls are empty."""
    ids, texts, size = [], [], 0
    for batch in batches:
        column = batch.column(1).fill_null("")
        for slab in slabs(column, most):
            ids += batch.column(0).slice(slab.first, slab.n).to_pylist()
            texts.append(column.slice(slab.first, slab.n))
            size += len(slab.buf)
            if size >= most:
                yield ids, pa.concat_arrays(texts)
                ids, texts, size = [], [], 0
    if ids:
        yield ids, pa.concat_arrays(texts)


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Of each block a row with its documents, their sizes and their words' codes, and a row for each distinct word with its code and how often training documents have it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = 0
        for ids, texts in _gathered(batches, block_bytes):
            (slab,) = slabs(texts, max(1, texts.nbytes))
            w = words(slab, NOT_SPACE)
            kept = _FOLD[slab.buf[NOT_SPACE[slab.buf]]]
            offsets = np.r_[0, np.cumsum(w.end - w.start)].astype(np.int32)
            coded = pa.StringArray.from_buffers(len(w.start), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
            n = len(coded.dictionary)
            held = np.array([_held(i) for i in ids], bool)
            codes = coded.indices.to_numpy()
            order = np.argsort(-np.bincount(codes, minlength=n), kind="stable")  # frequent words get small numbers, which compress well
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            trained = np.bincount(codes[~held[w.row]], minlength=n)[order]
            planes = place[codes].view(np.uint8).reshape(-1, 4).T.tobytes()
            block = (TaskContext.get().partitionId() << 32) + own
            own += 1
            for lo in range(0, n, 50_000):
                part = pa.array(order[lo : lo + 50_000])
                yield _filled(block=pa.array(np.full(len(part), block)), word=coded.dictionary.take(part), pos=pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), n=pa.array(trained[lo : lo + 50_000].astype(np.int32)))
            yield _filled(block=pa.array([block]), doc_id=pa.array([ids], pa.list_(pa.int64())), held=pa.array([held.tolist()]), size=pa.array([w.count().tolist()], pa.list_(pa.int32())), codes=pa.array([zstandard.ZstdCompressor(1).compress(planes)], pa.binary()))

    kinds = {"block": pa.int64(), "word": pa.string(), "pos": pa.int32(), "n": pa.int32(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "size": pa.list_(pa.int32()), "codes": pa.binary()}

    def _filled(**columns: pa.Array) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], list(kinds))

    return docs.select("doc_id", "text").mapInArrow(cut, _BLOCKS)


def piece_weights(counts: DataFrame, ends: int, known: Trie, given: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """log probabilities of the pieces and of the end, adapted to the training words (word, c) and their ``ends`` texts; what comes to the driver is one number a piece."""
    n = len(given)
    share = given
    found = np.zeros(n)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(np.log(share))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n)
            for batch in batches:
                times = batch.column(1).to_numpy().astype(float)
                for buf, bound, at in marked(batch.column(0).to_pylist()):
                    total += Lattice(known, buf, bound).expected(shared.value, times[at : at + len(bound) - 1], n)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        table = counts.where("c > 0").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        found = np.zeros(n)
        found[table.column("piece").to_numpy()] = table.column("n").to_numpy()
        share = (found + n * given) / (found.sum() + n)
    pieces = found.sum() + n
    end = (ends + 1) / (pieces + ends + 1)
    return np.log(share) + np.log1p(-end), float(np.log(end))


def lattice_scores(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    Tokens are the words of the text, A-Z in lower case, and one end.  ``base_score`` is
    the log10 probability of the tokens by add-one counts of the training documents,
    ``score`` that of the text by the lattice.  A null text is empty: it has only its
    end.  A null doc_id counts as an empty string and is trained on; repeated rows
    are rows like others; without training documents the vocabulary's own
    probabilities stand; an empty table gives no rows; other columns don't matter.
    """
    strings, given = vocabulary_weights(vocabulary)
    known = trie(strings)
    scratch = Scratch(docs.sparkSession)
    blocks = scratch.written(_blocks(docs, block_bytes))
    ids = blocks.where("codes IS NOT NULL")
    counts = scratch.written(blocks.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c")))
    ends = ids.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train, vocabulary_size = total + ends, distinct + (ends > 0)
    with small_batches(docs.sparkSession):
        weight, end = piece_weights(counts, ends, known, given, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(weight)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for buf, bound, at in marked(batch.column(0).to_pylist()):
                out[at : at + len(bound) - 1] = Lattice(known, buf, bound).forward(shared.value)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out / np.log(10))], ["word", "c", "lp"])

    def score(texts: pa.Table, values: pa.Table) -> pa.Table:
        at = values.column("code").to_numpy()
        c, lp = np.zeros(len(at), np.int64), np.zeros(len(at))
        c[at], lp[at] = values.column("c").to_numpy(), values.column("lp").to_numpy()
        found = []
        for row in texts.select(["doc_id", "held", "size", "codes"]).to_pylist():
            size = np.array(row["size"], np.int64)
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.uint8)
            codes = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
            bound = np.r_[0, np.cumsum(size)]
            some = np.flatnonzero(size)

            def sums(each: np.ndarray, codes=codes, bound=bound, some=some, size=size) -> np.ndarray:
                out = np.zeros(len(size), each.dtype)
                if len(some):
                    out[some] = np.add.reduceat(each[codes], bound[:-1][some])
                return out

            base = np.log10(np.array([ends + 1]) / (train + vocabulary_size + 1))[0] + sums(np.log10((c + 1) / (train + vocabulary_size + 1)))
            found.append(pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size + 1), pa.array(sums((c > 0).astype(np.int64)) + (ends > 0)), pa.array(np.full(len(size), train, np.int64)), pa.array(base), pa.array(sums(lp) + end / np.log(10))], names))
        return pa.concat_tables(found) if found else pa.table([pa.array([], k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    weighed = counts.mapInArrow(weigh, "word string, c long, lp double")
    values = blocks.where("word IS NOT NULL").select("word", "block", "pos").join(weighed, "word").select(F.col("block").alias("at"), F.col("pos").alias("code"), "c", "lp")
    scored = ids.groupBy("block").cogroup(values.groupBy("at")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    table = written(scored)
    scratch.clear()
    return table


def op13_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(read(spark, sf_dir, "documents"))


QUERIES = {"op13_lattice_score": op13_lattice_score}
#: SQL has no recursion over a lattice; tests compare with brute force.
ORACLE_SQL: dict[str, str] = {}
