"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths and of whole lines tell which characters
of a text lie inside an n-gram or a line that the same text has more than once.
A document is rejected when that share is high for some length, or when one of the
base counts fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import read
from .textkit import NOT_SPACE, Slab, char_count, gram_hashes, row_sums, rows_of_grams, slabs, span_hashes, words

#: n-gram length in words -> largest share of a text's word characters inside repeated n-grams.
GRAM_LIMITS = {5: 0.45, 8: 0.40, 10: 0.35}
LINE_LIMIT = 0.40  #: largest share of word characters on lines that repeat an earlier one
MIN_WORDS, SYMBOLS_PER_WORD = 50, 0.10
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_gram_share double, dup_line_share double"


def repeated(row: np.ndarray, h: np.ndarray, first_too: bool) -> np.ndarray:
    """Which of the (row, h) pairs occur more than once; without ``first_too``, only those after the first."""
    key = h ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    key, same = key[order], np.zeros(len(key), bool)
    again = (key[1:] == key[:-1]) & (row[order][1:] == row[order][:-1])
    same[1:] |= again
    if first_too:
        same[:-1] |= again
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def covered(hits: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in one of the n-word windows that begin at ``hits``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, hits, 1)
    np.add.at(steps, hits + n, -1)
    return np.cumsum(steps)[:size] > 0


def measures(slab: Slab, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Base counts and repetition coverage of each row of a slab."""
    w = words(slab, NOT_SPACE)
    chars = char_count(slab)
    length = chars[w.end] - chars[w.start]
    h = span_hashes(slab, w.start, w.end, fold=False)
    out = {"n_words": w.count(), "word_chars": row_sums(length, w.bound)}

    def in_grams(n: int) -> np.ndarray:
        inside = np.flatnonzero(rows_of_grams(w.row, n))
        hits = inside[repeated(w.row[inside], gram_hashes(h, n)[inside], True)]
        return covered(hits, n, len(h))

    out["n_repeat_words"] = row_sums(in_grams(3), w.bound)
    for n in lengths:
        out[f"chars_{n}"] = row_sums(length * in_grams(n), w.bound)
    symbols = np.zeros(len(slab.buf) + 1, np.int64)
    np.cumsum(_SYMBOLS[slab.buf], out=symbols[1:])
    out["n_symbols"] = symbols[slab.off[1:]] - symbols[slab.off[:-1]]
    # lines: between line feeds and row ends; only those with a word count
    breaks = np.flatnonzero(slab.buf == 10)
    start = np.unique(np.concatenate([slab.off[:-1], breaks + 1]))
    start = start[start < len(slab.buf)]
    row = np.searchsorted(slab.off, start, "right") - 1
    after = np.searchsorted(breaks, start)
    end = np.minimum(slab.off[row + 1], np.append(breaks, len(slab.buf))[after])
    first, last = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    full = last > first
    start, end, row, first, last = start[full], end[full], row[full], first[full], last[full]
    again = repeated(row, span_hashes(slab, start, end, fold=False), False)
    out["n_dup_lines"] = np.bincount(row[again], minlength=slab.n)
    sums = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=sums[1:])
    out["line_chars"] = np.bincount(row[again], (sums[last] - sums[first])[again], slab.n).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray], limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """Adds base_failed, kept and the two shares."""
    chars = np.maximum(m["word_chars"], 1)
    shares = [m[f"chars_{n}"] / chars for n in limits]
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    m["dup_line_share"] = m["line_chars"] / chars
    m["dup_gram_share"] = np.max(shares, axis=0) if shares else np.zeros(len(chars))
    bad = m["dup_line_share"] > line_limit
    for share, limit in zip(shares, limits.values()):
        bad = bad | (share > limit)
    bad = bad | (m["n_symbols"] > SYMBOLS_PER_WORD * m["n_words"])
    m["kept"] = ~(m["base_failed"] | bad)
    return m


def quality(docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the shares, for each row of ``docs``.

    A null or empty text has no words, so it fails the base rules.  Rows are
    judged one by one: repeated rows get equal verdicts; an empty table gives no
    rows; other columns are ignored.
    """
    limits = GRAM_LIMITS if limits is None else limits
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1)):
                m = verdict(measures(slab, tuple(limits)), limits, line_limit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.first, slab.n), *(pa.array(m[c]) for c in names[1:])], names)

    return docs.select("doc_id", text).mapInArrow(judge, SCHEMA)


def accepted(docs: DataFrame, text: str = "text", limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with all their columns, whatever their names."""
    limits, at = GRAM_LIMITS if limits is None else limits, docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(at)):
                kept = verdict(measures(slab, tuple(limits)), limits, line_limit)["kept"]
                yield batch.slice(slab.first, slab.n).filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


QUERIES = {"op5_quality": op5_quality}
def _covered(n: int) -> str:
    """Per document: words, and their code points, in n-word windows that occur twice or more."""
    gram = " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER p" for j in range(1, n))])
    return f"""g{n} AS (SELECT doc_id, i, word, {gram} AS g FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
    h{n} AS (SELECT doc_id, i, word, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS hit FROM g{n}),
    v{n} AS (SELECT doc_id, word, max(CAST(hit AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM h{n}),
    c{n} AS (SELECT doc_id, count(*) AS k, sum(len(word)) AS chars FROM v{n} WHERE inside = 1 GROUP BY doc_id)"""


#: The base columns and the method's verdict, on explicit word windows.
ORACLE_SQL = {
    "op5_quality": rf"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM t),
    {", ".join(_covered(n) for n in (3, *GRAM_LIMITS))},
    l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) s WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    d AS (SELECT doc_id, count(*) AS k, sum(list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: len(x)))) AS chars FROM l WHERE k > 1 GROUP BY doc_id),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(d.k, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.k, 0) AS BIGINT) AS n_repeat_words,
        coalesce(d.chars, 0) AS line_chars, {", ".join(f"coalesce(c{n}.chars, 0) AS chars_{n}" for n in GRAM_LIMITS)}
        FROM t LEFT JOIN d USING (doc_id) LEFT JOIN c3 USING (doc_id) {" ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in GRAM_LIMITS)}),
    v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"CAST(chars_{n} AS DOUBLE) / greatest(word_chars, 1) AS s{n}" for n in GRAM_LIMITS)},
        CAST(line_chars AS DOUBLE) / greatest(word_chars, 1) AS dup_line_share FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT (base_failed OR dup_line_share > CAST({LINE_LIMIT} AS DOUBLE) OR n_symbols > CAST({SYMBOLS_PER_WORD} AS DOUBLE) * n_words OR {" OR ".join(f"s{n} > CAST({x} AS DOUBLE)" for n, x in GRAM_LIMITS.items())}) AS kept,
        greatest({", ".join(f"s{n}" for n in GRAM_LIMITS)}) AS dup_gram_share, dup_line_share FROM v"""
}
