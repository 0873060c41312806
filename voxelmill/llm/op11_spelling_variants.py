"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion, one
replacement or one insertion of a letter of the observed alphabet makes of it.
Those candidates are joined to the vocabulary by hash join; what joins is exactly
the words at a distance of one, so no distance is ever worked out.

A candidate is worked out as a number first: a polynomial hash of the word gives
those of all its neighbours by an addition each.  A filter with some bits of every
word, of bounded size, tells at once that nearly all candidates are no words; only
the others become strings and are shuffled to the join, which decides.  A filter
that is full costs shuffle, not results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, read, small_batches, written
from .textkit import Slab, char_count, mix, slabs, words

LEAST_LETTERS, LEAST_COUNT, DOMINANCE = 7, 2, 10
#: One run in so many loses a letter, by a hash of the document and the run.
DAMAGED = 31
#: 64-bit words of the filter, least and most; four bits of one of them are set for each vocabulary word.  Two words share one of them; above 8 million words it begins to fill.
FILTER_WORDS = (1 << 12, 1 << 22)
_SLAB_BYTES = 4 << 20
#: Candidates that a task holds at once.
_AT_ONCE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = np.uint64(pow(_BASE, -1, 1 << 64))
_LONG = 256
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _crc_table() -> np.ndarray:
    """The table of the reflected 32-bit CRC polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def _letters(slab: Slab) -> np.ndarray:
    """Whether each byte belongs to a letter: A-Z, a-z, or U+00C0 to U+00FF, which are all characters that begin with the byte C3."""
    inside = _ASCII_LETTER[slab.buf]
    lead = slab.buf == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    return inside


def _run_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each span, continued from each one's seed."""
    state = ~seed
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, left = start[order], size[order]
    alive = len(order)
    for t in range(int(min(size.max(initial=0), _LONG))):
        alive = int(np.searchsorted(-left[:alive], -t, "left"))  # spans longer than t
        now = order[:alive]
        state[now] = _CRC[(state[now] ^ buf[s[:alive] + t]) & np.uint32(255)] ^ (state[now] >> np.uint32(8))
    out = ~state
    for k in np.flatnonzero(size > _LONG):
        out[k] = zlib.crc32(buf[start[k] + _LONG : end[k]].tobytes(), int(out[k]))
    return out


def slab_words(slab: Slab, ids: list, letters: int = LEAST_LETTERS) -> pa.StructArray:
    """(values, counts): the distinct words of a slab, some of which lost a letter."""
    folded = Slab(slab.first, slab.n, _FOLD[slab.buf], slab.off)
    inside = _letters(slab)
    runs = words(Slab(0, slab.n, inside.astype(np.uint8), slab.off), np.arange(256) == 1)
    chars = char_count(slab)
    size = chars[runs.end] - chars[runs.start]
    keep = size >= letters
    start, end, size, row = runs.start[keep], runs.end[keep], size[keep], runs.row[keep]
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = _run_hashes(folded.buf, start, end, seeds[row] if len(row) else np.empty(0, np.uint32))
    hit = h % np.uint32(DAMAGED) == 0
    cut = []
    for a, b, n, v in zip(start[hit].tolist(), end[hit].tolist(), size[hit].tolist(), h[hit].tolist()):
        if n > letters:
            word = folded.buf[a:b].tobytes().decode()
            cut.append(word[: v % n] + word[v % n + 1 :])
    start, end = start[~hit], end[~hit]
    depth = np.zeros(len(slab.buf) + 1, np.int8)
    depth[start] += 1
    depth[end] -= 1
    kept = folded.buf[np.cumsum(depth[:-1]).astype(bool)]
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    whole = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))
    return pc.value_counts(pa.chunked_array([whole, pa.array(cut, pa.string())]))


def word_counts(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of enough letters that occur often enough, counted by slab before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for slab in slabs(batch.column(1), _SLAB_BYTES):
                found = slab_words(slab, ids[slab.first : slab.first + slab.n], letters)
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix((codes.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _marks(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word of the filter a polynomial hash has, and its four bits there."""
    h = mix(h)
    bits = np.uint64(1) << (h & np.uint64(63))
    for k in (6, 12, 18):
        bits |= np.uint64(1) << ((h >> np.uint64(k)) & np.uint64(63))
    return (h >> np.uint64(24)) & np.uint64(size - 1), bits


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a batch of words, one after the other, and n + 1 bounds."""
    text = "".join(column.to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), np.r_[0, np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))]


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the words of each length: their rows and a matrix of their code points."""
    codes, bound = _codes(column)
    size = np.diff(bound)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, codes[bound[rows][:, None] + np.arange(n)]


def vocabulary_filter(vocabulary: DataFrame, n: int) -> np.ndarray:
    """The filter over the vocabulary's n words, made by distributed ORs."""
    size = min(max(1 << int(n / 2).bit_length(), FILTER_WORDS[0]), FILTER_WORDS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _by_size(batch.column(0)):
                at, bits = _marks((_values(m) * _powers(m.shape[1])).sum(1, dtype=np.uint64), size)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    parts = vocabulary.select("word").mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[parts.column("at").to_numpy()] = parts.column("bits").to_numpy().view(np.uint64)
    return out


def neighbours(m: np.ndarray, alphabet: np.ndarray, passing) -> Iterator[tuple[int, str]]:
    """(row, string) of the distinct neighbours of equally long words, a matrix of code points, that ``passing`` lets through: it is given an array of polynomial hashes and returns which to keep."""
    n = m.shape[1]
    power = _powers(n + 1)
    per_word = 2 * n * len(alphabet) + n
    letters = _values(alphabet)
    for lo in range(0, len(m), max(1, _AT_ONCE // per_word)):
        w = m[lo : lo + max(1, _AT_ONCE // per_word)]
        own = _values(w)
        sums = np.zeros((len(w), n + 1), np.uint64)  # of what stands before each place
        np.cumsum(own * power[:n], axis=1, out=sums[:, 1:])
        total = sums[:, n:]
        step = max(1, _AT_ONCE // (len(w) * len(alphabet)))
        again = np.zeros((len(w), n + 1), bool)  # the letter before is the same
        again[:, 1:n] = w[:, 1:] == w[:, :-1]
        for a in range(0, n + 1, step):
            at = np.arange(a, min(a + step, n + 1))
            inside = at[at < n]
            if len(inside):
                gone = sums[:, inside] + (total - sums[:, inside + 1]) * _BASE_INV
                r, i = np.nonzero(passing(gone) & ~again[:, inside])
                for row, k in zip(r.tolist(), inside[i].tolist()):
                    yield lo + row, _spelt(w[row, :k], w[row, k + 1 :])
                other = (total[:, :, None] - (own[:, inside] * power[inside])[:, :, None]) + letters * power[inside][None, :, None]
                r, i, c = np.nonzero(passing(other) & (w[:, inside, None] != alphabet))
                for row, k, x in zip(r.tolist(), inside[i].tolist(), alphabet[c].tolist()):
                    yield lo + row, _spelt(w[row, :k], w[row, k + 1 :], x)
            more = (sums[:, at] + (total - sums[:, at]) * np.uint64(_BASE))[:, :, None] + letters * power[at][None, :, None]
            before = np.where(at > 0, w[:, np.maximum(at - 1, 0)], np.uint32(0))  # a letter put behind its like was already put before it
            r, i, c = np.nonzero(passing(more) & (before[:, :, None] != alphabet))
            for row, k, x in zip(r.tolist(), at[i].tolist(), alphabet[c].tolist()):
                yield lo + row, _spelt(w[row, :k], w[row, k:], x)


def _spelt(left: np.ndarray, right: np.ndarray, letter: int | None = None) -> str:
    return left.tobytes().decode("utf-32-le") + ("" if letter is None else chr(letter)) + right.tobytes().decode("utf-32-le")


def near_pairs(vocabulary: DataFrame, n: int) -> DataFrame:
    """(word, n, near, m): each word with each word of the vocabulary (word, n) that one edit makes of it; ``n`` is the number of words."""
    alphabet = np.array(sorted(ord(r.c) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()), np.uint32)  # letters, so a bounded number
    shared = vocabulary.sparkSession.sparkContext.broadcast((alphabet, vocabulary_filter(vocabulary, n)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, marks = shared.value

        def passing(h: np.ndarray) -> np.ndarray:
            at, bits = _marks(h, len(marks))
            return marks[at] & bits == bits

        for batch in batches:
            for rows, m in _by_size(batch.column(0)):
                found = list(neighbours(m, letters, passing))
                at = pa.array(rows[[r for r, _ in found]] if found else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([s for _, s in found], pa.string())], ["word", "n", "near"])

    candidates = vocabulary.select("word", "n").mapInArrow(emit, "word string, n long, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")


def _roots(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until none moves.  A form occurs DOMINANCE times as often, so ways are as long as the digits of a count at most."""
    roots, moved = scratch.counted(forms.select("word", F.col("form").alias("root")))
    while moved:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots, moved = scratch.counted(roots.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), F.col("moved"))
        roots = roots.drop("moved")
    return roots


def spelling_variants(docs: DataFrame, letters: int = LEAST_LETTERS, least: int = LEAST_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``letters`` letters and ``least`` occurrences.

    A word's form is the most frequent of its near words, the first in code-point
    order at ties, if that occurs ``dominance`` times as often as the word; the root
    is the last form of forms.  Repeated rows count each; a null text has no words, a
    null doc_id hashes as an empty string; an empty table or one without such words
    gives no rows; other columns of ``docs`` don't matter.
    """
    if dominance < 2:
        raise ValueError("a form must be more frequent than its word, or roots have no end")
    scratch = Scratch(docs.sparkSession)
    vocabulary, n = scratch.counted(word_counts(docs, letters, least))
    with small_batches(docs.sparkSession):
        pairs = near_pairs(vocabulary, n)
    best = F.min(F.struct((-F.col("m")).alias("minus"), F.col("near").alias("form")))
    near = scratch.written(pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"), F.first("n").alias("n")).select("word", "n", "n_near", "b.form", (-F.col("b.minus")).alias("form_n")))
    strong = F.col("form_n") >= dominance * F.col("n")
    forms = near.where(strong).select("word", "form", "form_n")
    found = vocabulary.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(_roots(scratch, forms), "word", "left")
    table = written(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
    scratch.clear()
    return table


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
_HEX = "CAST(strpos('0123456789ABCDEF', substr(x, {}, 1)) - 1 AS BIGINT)"
#: The CRC from its polynomial; near words from equal patterns with a gap, and from equal words with a letter less.
ORACLE_SQL = {
    "op11_spelling_variants": f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
    low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
    coded AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM low),
    bytes AS (SELECT run, n, list_transform(range(1, length(x), 2), lambda i: {_HEX.format('i')} * 16 + {_HEX.format('i + 1')}) AS b FROM coded),
    hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda s, y: xor(s // 256, t[xor(s % 256, y) + 1])), 4294967295) AS h FROM bytes, crc),
    damaged AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
    gaps AS MATERIALIZED (SELECT word, n, k, left(word, k) AS a, substr(word, k + 2) AS z FROM (SELECT word, n, unnest(range(length(word))) AS k FROM v) s),
    pairs AS (SELECT p.word, p.n, q.word AS near, q.n AS m FROM gaps p JOIN gaps q ON p.k = q.k AND p.a = q.a AND p.z = q.z WHERE p.word <> q.word
        UNION SELECT g.word, g.n, v.word, v.n FROM gaps g JOIN v ON g.a || g.z = v.word UNION SELECT v.word, v.n, g.word, g.n FROM gaps g JOIN v ON g.a || g.z = v.word),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(near)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
    forms AS (SELECT word, near AS form, m AS form_n FROM ranked WHERE r = 1 AND m >= {DOMINANCE} * n),
    way AS (SELECT word, form AS root, 1 AS step FROM forms UNION ALL SELECT way.word, forms.form, step + 1 FROM way JOIN forms ON way.root = forms.word),
    ends AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
    SELECT v.word, form, coalesce(root, v.word) AS root, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
    FROM v LEFT JOIN (SELECT word, n_near FROM ranked WHERE r = 1) USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""
}
