"""Secret scans through a trigram inverted index.

Each rule's regular expression is read into a Boolean query over three-byte
sequences that any match must contain.  Every slab of documents is an index shard:
it posts, for the trigrams that some query names, the rows that have them.  A
rule's query is evaluated by intersecting and uniting postings, and only the rows
it leaves are searched with the rule's expression.  A rule without mandatory
trigrams scans all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import read
from .textkit import Slab, char_count, slabs

_FLAGS = re.IGNORECASE | re.ASCII


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of a match must have ``least`` characters or more.

    ``hex_runs`` says that the matches are the maximal runs of lower-case hex digits,
    which a full scan of a slab finds in numpy.
    """

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    hex_runs: bool = False


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _FLAGS, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32, hex_runs=True),
)
#: The method's own kinds, after the base ones.
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", _FLAGS),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
)

#: A query: True (all rows), a trigram, or ("and" | "or", parts).
Query = object


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """What the lower-cased bytes of any text with a match must contain."""
    exact, query = _analyse(rp.parse(pattern, flags))
    return _both(query, _any(exact)) if exact else query


def _both(a: Query, b: Query) -> Query:
    return b if a is True else a if b is True else ("and", (a, b))


def _any(strings: set[str]) -> Query:
    """One of the strings occurs: all trigrams of one of them."""
    parts = []
    for s in sorted(strings):
        raw = s.encode().lower()
        grams = sorted({raw[i : i + 3] for i in range(len(raw) - 2)})
        if not grams:
            return True
        parts.append(("and", tuple(grams)))
    return ("or", tuple(parts))


_MOST = 64


def _analyse(seq) -> tuple[set[str] | None, Query]:
    """(every string that the sequence matches, if few; a query that holds besides)."""
    exact: set[str] | None = {""}
    query: Query = True
    held: set[str] = {""}  # strings of which one must stand just here

    def close() -> None:
        nonlocal query, held
        query, held = _both(query, _any(held)), {""}

    for op, arg in seq:
        strings, inner = _node(op, arg)
        query = _both(query, inner)
        if strings is None:
            close()
            exact = None
            continue
        if len(held) * len(strings) > _MOST:
            close()
            exact = None
        held = {a + b for a in held for b in strings}
        if exact is not None:
            exact = {a + b for a in exact for b in strings}
            if len(exact) > _MOST:
                exact = None
    if exact is not None:
        return exact, query
    close()
    return None, query


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is rc.LITERAL:
        return {chr(arg)}, True
    if op is rc.AT:
        return {""}, True
    if op is rc.IN and all(k in (rc.LITERAL, rc.RANGE) for k, _ in arg):
        found = {chr(c) for k, v in arg for c in ([v] if k is rc.LITERAL else range(v[0], min(v[1], v[0] + 8) + 1))}
        small = all(k is rc.LITERAL or v[1] - v[0] < 8 for k, v in arg) and len(found) <= 8
        return (found if small else None), True
    if op is rc.SUBPATTERN:
        return _analyse(arg[3])
    if op is rc.BRANCH:
        sides = [_analyse(s) for s in arg[1]]
        if all(e is not None for e, _ in sides):
            return set().union(*(e for e, _ in sides)), True
        each = tuple(_both(q, _any(e)) if e is not None else q for e, q in sides)
        return None, True if True in each else ("or", each)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, item = arg
        strings, query = _analyse(item)
        if low == 0:
            return (strings | {""}, True) if high == 1 and strings is not None else (None, True)
        if low == high == 1:
            return strings, query
        return None, _both(query, _any(strings)) if strings is not None else query
    return None, True


def _grams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1]))


class Shard:
    """Postings of one slab for the wanted trigrams: of each, the sorted rows that have it."""

    def __init__(self, slab: Slab, wanted: dict[bytes, int], lookup: np.ndarray):
        self.n = slab.n
        b = slab.buf.copy()
        upper = (b >= 65) & (b <= 90)
        b[upper] += 32
        self.wanted = wanted
        self.rows: list[np.ndarray] = [np.empty(0, np.int64)] * len(wanted)
        if len(b) < 3:
            return
        code = (b[:-2].astype(np.int32) << 16) | (b[1:-1].astype(np.int32) << 8) | b[2:]
        which = lookup[code]
        at = np.flatnonzero(which)
        row = np.searchsorted(slab.off, at, "right") - 1
        inside = at + 3 <= slab.off[row + 1]
        pairs = np.unique(which[at[inside]].astype(np.int64) * (slab.n + 1) + row[inside])
        for g in range(len(wanted)):
            lo, hi = np.searchsorted(pairs, [(g + 1) * (slab.n + 1), (g + 2) * (slab.n + 1)])
            self.rows[g] = pairs[lo:hi] - (g + 1) * (slab.n + 1)

    def search(self, query: Query) -> np.ndarray:
        """Candidate rows."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.rows[self.wanted[query]]
        kind, parts = query
        if kind == "or":
            return np.unique(np.concatenate([self.search(p) for p in parts]))
        found = None
        for rows in sorted((self.search(p) for p in parts), key=len):
            found = rows if found is None else np.intersect1d(found, rows, assume_unique=True)
            if not len(found):
                break
        return found


def _spans(rule: Rule, find: Callable, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in find(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _hex_runs(slab: Slab, least: int) -> dict[int, list[tuple[int, int]]]:
    """All maximal runs of hex digits of a slab, ``least`` or longer: the full scan of the rule without trigrams, vectorised."""
    inside = np.zeros(len(slab.buf) + 2, np.int8)
    inside[1:-1] = _HEX[slab.buf]
    steps = np.flatnonzero(np.diff(inside))
    start, end = steps[::2], steps[1::2]
    keep = end - start >= least
    found: dict[int, list[tuple[int, int]]] = {}
    chars = None
    for a, b in zip(start[keep].tolist(), end[keep].tolist()):
        row = int(np.searchsorted(slab.off, a, "right")) - 1
        chars = char_count(slab) if chars is None else chars
        while a < b:  # a run over a row's end is two
            stop = min(b, int(slab.off[row + 1]))
            if stop - a >= least:
                zero = int(chars[slab.off[row]])
                found.setdefault(row, []).append((int(chars[a]) - zero, int(chars[stop]) - zero))
            a, row = stop, row + 1
    return found


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id, spans of each kind, and digests of the base kinds, for each row.

    Spans count code points, the end exclusive; they are ordered by start, then by
    the rules' order.  A null or empty text has none: zero counts, the digest of
    an empty string, an empty list.  Repeated rows get equal results, an empty
    table gives no rows, other columns are ignored.
    """
    queries = [trigram_query(r.pattern, r.flags) for r in rules]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {g: i for i, g in enumerate(sorted(set().union(*map(_grams, queries))))}
        lookup = np.zeros(1 << 24, np.int16)
        for g, i in wanted.items():
            lookup[(g[0] << 16) | (g[1] << 8) | g[2]] = i + 1
        finders = [re.compile(r.pattern, r.flags).finditer for r in rules]
        base = [r.kind for r in BASE]
        for batch in batches:
            for slab in slabs(batch.column(1)):
                shard = Shard(slab, wanted, lookup)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(slab.n)]
                texts: dict[int, str] = {}
                for k, (rule, query, finder) in enumerate(zip(rules, queries, finders)):
                    if rule.hex_runs:
                        for row, spans in _hex_runs(slab, rule.least).items():
                            found[row] += [(a, k, b) for a, b in spans]
                        continue
                    for row in shard.search(query).tolist():
                        if row not in texts:
                            texts[row] = slab.text(row)
                        found[row] += [(a, k, b) for a, b in _spans(rule, finder, texts[row])]
                counts, digests, all_spans = {k: [] for k in base}, [], []
                for spans in found:
                    spans.sort()
                    shown = [(rules[k].kind, f"{rules[k].kind}:{a}:{b}") for a, k, b in spans]
                    for kind in base:
                        counts[kind].append(sum(k == kind for k, _ in shown))
                    digests.append(hashlib.sha256(",".join(s for k, s in shown if k in base).encode()).hexdigest())
                    all_spans.append(",".join(s for _, s in shown))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(slab.first, slab.n), *(pa.array(counts[k], pa.int64()) for k in base), pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                    ["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
                )

    return docs.select("doc_id", text).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE_SQL: dict[str, str] = {}
