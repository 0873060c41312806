"""Benchmark decontamination by suffix arrays over the training texts.

Each slab of documents is a shard with a suffix array over its words.  Every
suffix of every benchmark item is binary-searched in each shard: its place there
tells its longest verbatim match, and a search of its first ``window`` words gives
all places where that window stands.  A document's own longest match follows from
the nearest benchmark suffixes before and after its suffixes in the sorted order.

What is shipped of the benchmark is one number for each of its words, and its
vocabulary; a task compares in place and holds no window of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read
from .textkit import ALNUM, Slab, Words, mix, slabs, span_hashes, words

WINDOW = 10
#: Benchmark text that one pass ships to the executors; a larger benchmark takes more passes.
BLOCK_BYTES = 32 << 20
_SHARD_BYTES = 2 << 20
#: Suffixes that are searched together.
_AT_ONCE = 1 << 16
#: Pairs of a row and an item that are held before equal ones become one.
_PAIRS = 1 << 20
#: Words that a comparison walks one by one; longer matches are measured by halving.
_WALK = 24
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1664525)
_FOUND = "n_words long, spans array<long>, items array<string>, longest long, longest_at long"


def stretches(codes: np.ndarray, more: int = 0) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Where the first 0 at or after each place stands; and, by two primes, the sums before each place of code * base ** place, and the powers, of which there are ``more`` at least: two stretches are equal if their sums are, each times the power of the other's place."""
    n = len(codes)
    stop = np.where(codes == 0, np.arange(n), n)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    value = mix(codes.astype(np.uint64))
    sums, powers = [], []
    for p, base in zip(_PRIMES, _BASES):
        power = np.ones(max(n, more) + 1, np.int64)
        have, step = 1, base
        while have < len(power):
            power[have : 2 * have] = power[: min(have, len(power) - have)] * step % p
            have, step = 2 * have, step * step % p
        total = np.zeros(n + 1, np.int64)
        np.cumsum((value % np.uint64(p)).astype(np.int64) * power[:n] % p, out=total[1:])
        sums.append(total)
        powers.append(power)
    return stop, sums, powers


@dataclass
class Queries:
    """A block of items: the sorted hashes of their words, each word's number there and one, a 0 after each item, and each suffix's place, item and width.

    The width is ``window`` or, for an item of fewer words, all of them; suffixes
    too short to be a window have width 0.
    """

    vocabulary: np.ndarray
    codes: np.ndarray
    item: np.ndarray
    window: int
    ids: list[str | None]
    _stretches: tuple | None = None

    def stretches(self) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The block's stretches(), made when a task first needs them."""
        if self._stretches is None:
            self._stretches = stretches(self.codes)
        return self._stretches

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and width of every suffix."""
        ends = np.flatnonzero(self.codes == 0)
        size = np.diff(np.r_[-1, ends]) - 1
        at = np.flatnonzero(self.codes)
        left = np.repeat(ends, size) - at
        least = np.minimum(np.repeat(size, size), self.window)
        return at, np.where(left >= least, least, 0)


def query_block(items: list[tuple[object, str | None]], window: int) -> Queries:
    """The items that have a word."""
    hashes, sizes, ids = [], [], []
    for item_id, text in items:
        if text is None:
            continue
        for slab in slabs(pa.array([text])):
            w = words(slab, ALNUM)
            h = span_hashes(slab, w.start, w.end, fold=True)
            if len(h):
                hashes.append(h)
                sizes.append(len(h))
                ids.append(None if item_id is None else str(item_id))
    every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    vocabulary, known = np.unique(every, return_inverse=True)
    codes, item = np.zeros(len(every) + len(ids), np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), np.array(sizes, np.int64) + 1)
    codes[np.arange(len(every)) + np.repeat(np.arange(len(ids)), sizes)] = known + 1
    return Queries(vocabulary, codes, item, window, ids)


class SuffixArray:
    """Suffixes of a shard's words, sorted as far as a benchmark item of ``depth`` words can tell them apart.

    Words are numbered by the benchmark's vocabulary; others, and the ends of rows,
    are 0, where a comparison ends.
    """

    def __init__(self, h: np.ndarray, row: np.ndarray, n_rows: int, queries: Queries, depth: int):
        k = np.minimum(np.searchsorted(queries.vocabulary, h), max(len(queries.vocabulary) - 1, 0))
        known = queries.vocabulary[k] == h if len(queries.vocabulary) else np.zeros(len(h), bool)
        self.at = np.arange(len(h)) + row
        self.seq = np.zeros(len(h) + n_rows + 1, np.int32)
        self.seq[self.at] = np.where(known, k + 1, 0)
        self.word_at = np.full(len(self.seq), -1, np.int32)
        self.word_at[self.at] = np.arange(len(h))
        self.sums = None
        suffixes = np.flatnonzero(self.seq).astype(np.int32)
        self.order = suffixes[np.argsort(self.seq[suffixes], kind="stable")]
        self._refine(depth)

    def _refine(self, depth: int) -> None:
        """Prefix doubling of what is still tied; a rank is the slot of its first suffix, and one, so other ranks stay."""
        n = len(self.order)
        if not n:
            return
        rank = np.zeros(2 * len(self.seq), np.int32)
        value = self.seq[self.order]
        slot = np.arange(n, dtype=np.int32)
        group = np.maximum.accumulate(np.where(np.r_[True, value[1:] != value[:-1]], slot, 0))
        rank[self.order] = group + 1
        k = 1
        while k < depth:
            first = np.r_[True, group[1:] != group[:-1]]
            tied = np.flatnonzero(~(first & np.r_[first[1:], True])).astype(np.int32)
            if not len(tied):
                return
            at = self.order[tied]
            nxt = rank[at + k]
            by = np.lexsort((nxt, group[tied]))
            self.order[tied], nxt = at[by], nxt[by]
            own = group[tied]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])]
            group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
            rank[self.order[tied]] = group[tied] + 1
            k *= 2

    def compare(self, queries: Queries, a: np.ndarray, slots: np.ndarray, width: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix a of the block and the suffix in a slot (none outside the array): words that agree from their start on, and the sign of shard - block after those; ``width`` words are compared at most."""
        inside = (slots >= 0) & (slots < len(self.order))
        b = self.order[np.clip(slots, 0, max(len(self.order) - 1, 0))] if len(self.order) else np.zeros(len(a), np.int64)
        same, sign = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        open_ = np.flatnonzero(inside)
        j = 0
        while len(open_):
            if width is not None:
                open_ = open_[width[open_] > j]
            if j == _WALK and len(open_):
                most = None if width is None else width[open_] - j
                same[open_], sign[open_] = self._far(queries, a[open_] + j, b[open_] + j, most)
                same[open_] += j
                break
            x, y = queries.codes[a[open_] + j], self.seq[b[open_] + j]
            sign[open_] = np.sign(y - x)
            open_ = open_[(x == y) & (x > 0)]
            same[open_] += 1
            j += 1
        return same, sign

    def _far(self, queries: Queries, a: np.ndarray, b: np.ndarray, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """compare() for long matches: the length by halving, as the sums of any two stretches tell whether they are equal; so it takes the logarithm of the length."""
        if self.sums is None:
            self.sums = stretches(self.seq, len(queries.codes))
        theirs, (stop, own, power) = queries.stretches(), self.sums
        high = np.minimum(theirs[0][a] - a, stop[b] - b)
        high = high if most is None else np.minimum(high, most)
        low, high = np.zeros(len(a), np.int64), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_] + 1) // 2
            x, y = a[open_], b[open_]
            equal = np.ones(len(open_), bool)
            for p, s, t, w in zip(_PRIMES, theirs[1], own, power):
                equal &= (s[x + mid] - s[x]) % p * w[y] % p == (t[y + mid] - t[y]) % p * w[x] % p
            low[open_[equal]] = mid[equal]
            high[open_[~equal]] = mid[~equal] - 1
        sign = np.sign(self.seq[b + low] - queries.codes[a + low])
        return low, sign if most is None else np.where(low >= most, 0, sign)

    def bound(self, queries: Queries, a: np.ndarray, width: np.ndarray | None, upper: bool) -> np.ndarray:
        """The first slot whose suffix isn't below a's, or (upper) is above it."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), len(self.order), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            sign = self.compare(queries, a[open_], mid, None if width is None else width[open_])[1]
            right = (sign < 0) | (upper & (sign == 0))
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(self, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows found, as columns (first slot, slots, width) and their items as (window, item) columns; and the longest match of every word of the shard with any suffix.

        Suffixes that begin with the same window find the same slots, and windows of
        one width share no slot, so what is found is bounded by the shard and the block, not by their product.
        """
        at, width = queries.suffixes()
        present = np.zeros(len(queries.vocabulary) + 1, bool)
        present[self.seq] = True
        present[0] = False
        keep = present[queries.codes[at]]
        at, width = at[keep], width[keep]
        found, nearest = [np.empty((4, 0), np.int64)], []
        for lo in range(0, len(at), _AT_ONCE):
            a, w = at[lo : lo + _AT_ONCE], width[lo : lo + _AT_ONCE]
            place = self.bound(queries, a, None, False)
            before, after = self.compare(queries, a, place - 1)[0], self.compare(queries, a, place)[0]
            nearest.append(np.stack([place, before, after, a]))
            hit = np.flatnonzero((w > 0) & (np.maximum(before, after) >= w))
            lower = self.bound(queries, a[hit], w[hit], False)
            n = self.bound(queries, a[hit], w[hit], True) - lower
            found.append(np.unique(np.stack([lower, n, w[hit], queries.item[a[hit]]]), axis=1))
        longest = np.zeros(len(self.at), np.int64)
        if nearest and len(self.order):
            longest[self.word_at[self.order]] = self._longest(queries, np.concatenate(nearest, axis=1))
        rows = np.unique(np.concatenate(found, axis=1), axis=1)
        windows, which = np.unique(rows[:3], axis=1, return_inverse=True)
        return windows, np.stack([which.ravel(), rows[3]]), longest

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word) of every place where a window stands."""
        n = windows[1]
        which = np.repeat(np.arange(len(n)), n)
        slots = np.repeat(windows[0], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, self.word_at[self.order[slots]]

    def _longest(self, queries: Queries, nearest: np.ndarray) -> np.ndarray:
        """The longest match of the suffix in each slot: with the nearest block suffix that sorts before it, or the nearest after it.

        ``nearest`` has each block suffix's place and what it shares with the slots
        before and after; of those at one place the one that shares most stands for all.
        """
        place, before, after, a = nearest
        slot, out = np.arange(len(self.order)), np.zeros(len(self.order), np.int64)
        for shared, side, step in ((before, "right", 0), (after, "right", -1)):
            by = np.lexsort((-shared, place))
            first = by[np.r_[True, place[by][1:] != place[by][:-1]]]
            k = np.searchsorted(place[first], slot, side) + step
            some = np.flatnonzero((k >= 0) & (k < len(first)))
            out[some] = np.maximum(out[some], self.compare(queries, a[first[k[some]]], slot[some])[0])
        return out


def merge(spans: list[int]) -> list[int]:
    """Flat [start, end, ...] spans, sorted and joined."""
    pairs = sorted(zip(spans[::2], spans[1::2]))
    out: list[int] = []
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _pairs(windows: np.ndarray, rows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Distinct (row, item) columns of those that share a window; ``rows`` and ``items`` are (window, row) and (window, item) columns, distinct and sorted by window.  About _PAIRS are held at once before they are told apart."""
    row_at, item_at = (np.searchsorted(x[0], np.arange(windows.shape[1] + 1)) for x in (rows, items))
    ends = np.cumsum(np.diff(row_at) * np.diff(item_at))
    out, at = np.empty((2, 0), np.int64), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, "right")))
        wide = np.diff(item_at)[rows[0, row_at[at] : row_at[to]]]  # items that each (window, row) meets
        first = item_at[rows[0, row_at[at] : row_at[to]]]
        k = np.repeat(first - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())
        out = np.unique(np.concatenate([out, np.stack([np.repeat(rows[1, row_at[at] : row_at[to]], wide), items[1, k]])], axis=1), axis=1)
        at = to
    return out


def shard_matches(slab: Slab, w: Words, queries: Queries) -> tuple[list[list[int]], list[list[str]], np.ndarray, np.ndarray]:
    """Of each row: hit word spans, items found, words in its longest verbatim match with an item, and the first word where one of that length begins (-1 without any)."""
    spans: list[list[int]] = [[] for _ in range(slab.n)]
    items: list[list[str]] = [[] for _ in range(slab.n)]
    depth = int(np.diff(np.r_[-1, np.flatnonzero(queries.codes == 0)]).max(initial=1))
    h = span_hashes(slab, w.start, w.end, fold=True)
    array = SuffixArray(h, w.row, slab.n, queries, depth)
    windows, owners, match = array.search(queries)
    if windows.shape[1]:
        which, word = array.places(windows)
        edge = np.bincount(word, minlength=len(h) + 1) - np.bincount(word + windows[2][which], minlength=len(h) + 1)
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        parted = np.r_[True, (np.diff(hit) > 1) | (np.diff(w.row[hit]) > 0)]
        first, last = hit[parted], hit[np.r_[parted[1:], True]]
        low = w.bound[w.row[first]]
        for r, a, b in zip(w.row[first].tolist(), (first - low).tolist(), (last + 1 - low).tolist()):
            spans[r] += (a, b)
        for r, item in _pairs(windows, np.unique(np.stack([which, w.row[word]]), axis=1), owners).T.tolist():
            items[r].append(queries.ids[item])
    longest, at = np.zeros(slab.n, np.int64), np.full(slab.n, -1, np.int64)
    some = np.flatnonzero(np.diff(w.bound))
    if len(some):
        longest[some] = np.maximum.reduceat(match, w.bound[:-1][some])
        best = np.flatnonzero((match == longest[w.row]) & (match > 0))
        rows, where = np.unique(w.row[best], return_index=True)
        at[rows] = best[where] - w.bound[:-1][rows]
    return spans, items, longest, at


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Queries, bool]]:
    """The benchmark's items in blocks of a bounded size, one at a time on the driver; whether it's the last."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield query_block([(r.item_id, r.text) for r in part.select("item_id", "text").collect()], window), k == n - 1


def _found(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs with those of _FOUND; each block of the benchmark is one narrow pass."""
    own, new = docs.schema, T._parse_datatype_string(_FOUND).fields
    for k, (block, last) in enumerate(_blocks(benchmark, window, block_bytes)):
        carried = keep if last else own.names
        schema = T.StructType([*(own[c] for c in carried), *new])
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, carried=carried, more=k > 0) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            for batch in batches:
                for slab in slabs(batch.column(own.names.index("text")), _SHARD_BYTES):
                    part = batch.slice(slab.first, slab.n)
                    w = words(slab, ALNUM)
                    spans, items, longest, at = shard_matches(slab, w, queries)
                    if more:
                        before = {c: part.column(part.schema.get_field_index(c)).to_pylist() for c in ("spans", "items", "longest", "longest_at")}
                        spans = [a + b for a, b in zip(before["spans"], spans)]
                        items = [a + b for a, b in zip(before["items"], items)]
                        was, place = np.array(before["longest"], np.int64), np.array(before["longest_at"], np.int64)
                        at = np.where(was > longest, place, np.where((was == longest) & (longest > 0), np.minimum(place, at), at))
                        longest = np.maximum(longest, was)
                    found = [
                        pa.array(w.count()),
                        pa.array([merge(s) for s in spans], pa.list_(pa.int64())),
                        pa.array([sorted(set(i), key=lambda v: (v is None, v or "")) for i in items], pa.list_(pa.string())),
                        pa.array(longest),
                        pa.array(at),
                    ]
                    yield pa.RecordBatch.from_arrays([*(part.column(own.names.index(c)) for c in carried), *found], [*carried, *(f.name for f in new)])

        docs = docs.mapInArrow(search, schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest, longest_at and the hit word spans of each row.

    Words in lower case; a hit word lies in an occurrence of ``window`` consecutive
    item words (of all the words of a shorter item).  ``longest`` is the number of
    words in the longest run that the document shares with one item, however short,
    and ``longest_at`` the first word where such a run begins, null without any.

    A null or wordless text or item has no words and no windows; an empty benchmark
    hits nothing; rows with equal texts get equal results, and repeated rows or
    null doc_ids are rows like others; an empty table gives no rows; other columns
    of either table are ignored.  Items with a null item_id are searched like
    others: their words are hit and contaminate.  As in the SQL they count as one
    item in n_items and have no name in the list.
    """
    found = _found(docs.select("doc_id", "text"), benchmark, window, block_bytes, ["doc_id"])
    hits = F.aggregate(F.sequence(F.lit(0), F.size("spans") - 1), F.lit(0).cast("long"), lambda n, i: n + F.when(i % 2 == 1, F.get("spans", i)).otherwise(-F.get("spans", i)))
    return found.select(
        "doc_id",
        "n_words",
        F.when(F.size("spans") == 0, F.lit(0).cast("long")).otherwise(hits).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
        F.when(F.col("longest_at") >= 0, F.col("longest_at")).alias("longest_at"),
        "spans",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all their columns, without those that hold a benchmark window.

    Rows without words stay; a row that repeats another shares its fate; an empty
    benchmark drops nothing, an empty table gives no rows.
    """
    clash = {f.split()[0] for f in _FOUND.split(", ")} & set(docs.columns)
    kept = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    kept = _found(kept, benchmark, window, block_bytes, kept.columns).where(F.size("spans") == 0).select(*kept.columns)
    return kept.withColumnsRenamed({f"__{c}": c for c in clash})


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


QUERIES = {"op6_decontaminate": op6_decontaminate}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op6_decontaminate": f"""
    WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS g, least(10, len(w)) AS k
        FROM (SELECT item_id, w, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0) s),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win) kk WHERE len(w) >= k) s),
    hit AS (SELECT DISTINCT g.doc_id, g.i, g.k, win.item_id FROM g JOIN win ON g.g = win.g AND g.k = win.k),
    cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) s GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) s GROUP BY doc_id),
    pos AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM d), bpos AS MATERIALIZED (SELECT r, unnest(range(0, len(w))) AS j, unnest(w) AS x FROM (SELECT row_number() OVER () AS r, w FROM b) q),
    two AS (SELECT doc_id, i, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM pos), btwo AS (SELECT r, j, x, lead(x) OVER (PARTITION BY r ORDER BY j) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY j) AS z FROM bpos),
    tri AS (SELECT doc_id, r, i, i - j AS dg, i - row_number() OVER (PARTITION BY doc_id, r, i - j ORDER BY i) AS grp FROM two JOIN btwo ON two.x = btwo.x AND two.y = btwo.y AND two.z = btwo.z),
    runs AS (SELECT doc_id, 2 + count(*) AS n, min(i) AS place FROM tri GROUP BY doc_id, r, dg, grp
        UNION ALL SELECT doc_id, 2, min(i) FROM two SEMI JOIN btwo ON two.x = btwo.x AND two.y = btwo.y GROUP BY doc_id
        UNION ALL SELECT doc_id, 1, min(i) FROM two SEMI JOIN btwo ON two.x = btwo.x GROUP BY doc_id),
    lng AS (SELECT doc_id, n AS longest, min(place) AS longest_at FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS top FROM runs) q WHERE n = top GROUP BY doc_id, n)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest, CAST(longest_at AS BIGINT) AS longest_at
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN lng USING (doc_id)"""
}
