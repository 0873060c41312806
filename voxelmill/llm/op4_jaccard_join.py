"""Exact n-gram Jaccard join in metric space.

The points are sets of word shingles under Jaccard distance, a metric.  Documents
with equal sets are one point.  Two points link at a distance of r = 1 - percent / 100
or less; all that is asked for are the components that links make.

Finding pivots.  Nearly all distances in a corpus are 1, so the distance to a pivot
drawn anywhere tells nothing.  An inverted list of shingles names the points that can
be near each other: ordered rarest first, two linked points share one of their first
size - ceil(t * size) + 1 shingles.  A list's pivot is one of its documents, the one
with the shared shingle earliest in its order; whole sets are measured against it.

Voronoi cells.  A point within r of a pivot belongs to the cell of its nearest pivot.
As all of a cell link with its pivot, a cell is connected and never compared within.

Recursion.  Lists whose points all are in one component are done.  In what is left
the points outside all cells get fresh pivots, their lists are measured again, and so
on while a list is large; then each point that is still outside is a pivot itself, with
a cell of its own.

Windows.  A link between x in the cell of p and y means, by the triangle inequality,
d(y, p) <= d(x, p) + r, and x and y share a list.  So every pivot whose cell has a
point in a list is measured against the list's points of other components: y within r
of p links, y within the cell's radius + r is copied to the region of p, and all else
is out of reach.  In a region x and y can link only if d(y, p) - d(x, p) <= r; these
are measured exactly, the rest of the cell's shell isn't touched.

Bounds that cost little go before each measurement: sizes, places in the list, and
parity sketches, all lower bounds of the symmetric difference.  Hot lists and hot
regions are dealt out in pairs of blocks, hot pivots by salted keys.  Links are joined
into components by distributed label propagation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, read, small_batches, written
from .textkit import NOT_SPACE, Slab, gram_hashes, slabs, span_hashes, words

SHINGLE = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Counters of the shingle order, least and most; their number bounds what is broadcast, and is a quarter of the documents in between.
ORDER_BUCKETS = (1 << 18, 1 << 22)
#: Bits of the filter by which a task knows that a set is needed, least and most; a full filter costs shuffle, not results.
FILTER_BITS = (1 << 18, 1 << 27)
_SKETCH = [f"k{i}" for i in range(4)]
#: Members of a list or region that one task compares with each other, at most.
BLOCK = 1024
#: A key on more than one in so many rows is hot, so there are fewer hot keys than this; each is dealt to SALTS tasks.
HOT_KEYS, SALTS = 1000, 64
#: Lists of more points are measured again with fresh pivots, for so many levels; then all points outside the cells are pivots.
LARGE, LEVELS = 64, 3
_SLACK = 1e-6


def _power(n: float, bounds: tuple[int, int]) -> int:
    """The power of two above n, within the bounds."""
    return min(max(1 << int(n).bit_length(), bounds[0]), bounds[1])


def shingle_sets(slab: Slab, n: int) -> Iterator[np.ndarray]:
    """Of each row, the sorted distinct hashes of its n-word shingles; fewer words are one shingle, none is an empty set."""
    w = words(slab, NOT_SPACE)
    h = span_hashes(slab, w.start, w.end, fold=True)
    grams = gram_hashes(h, n)
    for a, b in zip(w.bound[:-1].tolist(), w.bound[1:].tolist()):
        if b - a >= n:
            s = np.sort(grams[a : b - n + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s
        else:
            yield gram_hashes(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


def _order_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents have a shingle of each bucket, over all documents."""
    buckets = _power(docs.count() / 4, ORDER_BUCKETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for slab in slabs(batch.column(0)):
                found = list(shingle_sets(slab, n))
                total += np.bincount((np.concatenate(found) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    with small_batches(docs.sparkSession):
        table = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def _parities(s: np.ndarray, width: int) -> bytes:
    """A bit for each of ``width`` slots (a power of two): is the number of shingles in it odd."""
    slots = ((s >> np.uint64(16)) & np.uint64(max(width, 1) - 1)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=width) & 1).astype(np.uint8)).tobytes() if width else b""


def _differing(a: bytes, b: bytes) -> int:
    """Slots in which two sketches differ; the wider one's halves are laid over each other until it is as wide as the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, size of its set, a 128-bit digest of it, its window's shingles, and its parity sketches, narrow and wide."""
    order = docs.sparkSession.sparkContext.broadcast(_order_counts(docs, n))
    names = ["doc_id", "n", "h0", "h1", "window", "wide", *_SKETCH]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            for slab in slabs(batch.column(1)):
                size, digest, window, wide, sketch = [], [], [], [], []
                for s in shingle_sets(slab, n):
                    size.append(len(s))
                    digest.append(_digest(s))
                    keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    window.append(s[np.argsort(counts[(s % np.uint64(len(counts))).astype(np.int64)], kind="stable")[:keep]].view(np.int64))
                    wide.append(_parities(s, max(256, 1 << (len(s) - 1).bit_length()) if len(s) else 0))
                    sketch.append(np.packbits((np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8)))
                bits = np.concatenate(sketch).view("<i8").reshape(-1, 4)
                lens = np.r_[0, np.cumsum([len(w) for w in window])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(slab.first, slab.n), pa.array(np.array(size, np.int64)), *_digest_columns(digest), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(window))), pa.array(wide, pa.binary()), *(pa.array(bits[:, i]) for i in range(4))],
                    names,
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, h0 long, h1 long, window array<long>, wide binary, " + ", ".join(f"{k} long" for k in _SKETCH))


def _filter(ids: DataFrame, name: str, n: int) -> tuple[np.ndarray, int]:
    """A bit for the hash of each of about n ids, set by distributed ORs, and the number of bits: some sixteen for each id while they are few."""
    size = _power(16 * n, FILTER_BITS)
    slot = F.pmod(F.xxhash64(name), F.lit(size))
    words_ = ids.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({name}), {size}) % 64 as int))").alias("bit"))
    parts = words_.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[parts.column("at").to_numpy()] = parts.column("bits").to_numpy()
    return bits, size


def _passing(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return np.flatnonzero((bits[slot >> 6] >> (slot & 63)) & 1)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _digest_columns(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    keys = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return pa.array(keys[:, 0]), pa.array(keys[:, 1])


def _sets(docs: DataFrame, classes: DataFrame, count: int, n: int) -> DataFrame:
    """(x, items): the sets, as bytes, of ``classes`` (x, doc, h0, h1), each once, however many rows have it; made anew from the texts, so no copy of all sets is kept."""
    bits, size = _filter(classes, "doc", count)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(_passing(shared.value, batch.column(1).to_numpy())))
            for slab in slabs(batch.column(2)):
                found = list(shingle_sets(slab, n))
                yield pa.RecordBatch.from_arrays([*_digest_columns([_digest(s) for s in found]), pa.array([s.tobytes() for s in found], pa.binary())], ["h0", "h1", "items"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    sets = docs.where("doc_id IS NOT NULL").select("doc_id", slot.alias("slot"), "text").mapInArrow(make, "h0 long, h1 long, items binary")
    return classes.join(sets, ["h0", "h1"]).groupBy("x").agg(F.first("items").alias("items"))


def _hot(rows: DataFrame, total: int, *keys: str) -> list[list]:
    """Of each key column, its values on more than one in HOT_KEYS of the ``total`` rows: fewer than HOT_KEYS of them."""
    each = rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("at"), F.col(c).alias("value")) for k, c in enumerate(keys)])))
    found = each.where("value IS NOT NULL").groupBy("at", "value").agg(F.count("*").alias("n")).where(F.col("n") > total / HOT_KEYS).collect()
    return [[r.value for r in found if r["at"] == k] for k in range(len(keys))]


def _attached(rows: DataFrame, table: DataFrame, key: str, hot: list, how: str = "inner", also: tuple[str, ...] = ()) -> DataFrame:
    """rows with the columns of ``table``, which has one row for each key (and ``also``); the rows of a hot key are dealt to SALTS tasks, its row to all of them."""
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.when(is_hot, F.lit(SALTS)).otherwise(1)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(table.withColumn("salt", F.explode(copies.cast("array<long>"))), [key, *also, "salt"], how).drop("salt")


def _room(most: Column | float) -> Column:
    """How many shingles sets of n and m may differ in at a distance of ``most``."""
    return (F.col("n") + F.col("m")) * (most / (2 - most)) + _SLACK


def _apart(i: str, j: str) -> Column:
    """A lower bound of what sets of n and m differ in, if the first shingle in order that both have is at places i and j."""
    return F.col(i) + F.col(j) + F.abs((F.col("n") - F.col(i)) - (F.col("m") - F.col(j)))


def _sketched() -> Column:
    """A lower bound of the same from the narrow sketches k0 .. k3 and l0 .. l3."""
    return sum((F.bit_count(F.col(f"k{i}").bitwiseXOR(F.col(f"l{i}"))) for i in range(1, 4)), F.bit_count(F.col("k0").bitwiseXOR(F.col("l0"))))


class _Join:
    """One run of the join: its documents, classes, threshold and tables."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int, percent: int, scratch: Scratch):
        self.docs, self.reps, self.n, self.percent, self.keep, self.counted = docs, reps, n, percent, scratch.written, scratch.counted
        self.scratch, self.reach = scratch, (100 - percent) / 100
        self.narrow = reps.select("x", "n", *_SKETCH)
        self.other = reps.select(F.col("x").alias("p"), F.col("n").alias("m"), *(F.col(k).alias(f"l{k[1:]}") for k in _SKETCH))

    def lists(self) -> tuple[DataFrame, int]:
        """(s, x, i, n, size, p, pi, m), and how many rows: the points of every list of two or more, their place i of s, and the list's pivot p with its place and size.

        Lists are counted first; only rows of those with two points or more, by a
        filter of bounded size, are then fingerprinted and dealt out by list.  Of
        lists with the same points the first in order stays, so the first shingle
        that a pair shares is never lost.
        """
        shared, total = self.counted(self.reps.select(F.explode("window").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s"))
        bits, width = _filter(shared, "s", total)
        bits = self.docs.sparkSession.sparkContext.broadcast(bits)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([0, 1, 2, 3]).take(pa.array(_passing(bits.value, batch.column(4).to_numpy())))

        cells = self.reps.select(F.posexplode("window").alias("i", "s"), "x", "n")
        slotted = cells.select("s", "x", "i", "n", F.pmod(F.xxhash64("s"), F.lit(width)).alias("slot"))
        cells, total = self.counted(slotted.mapInArrow(pick, "s long, x long, i int, n long"))
        kinds = cells.groupBy("s").agg(F.count("*").alias("size"), F.min(F.struct("x", "i")).alias("low"), F.bit_xor(F.xxhash64("x")).alias("f"), F.min(F.struct("i", F.xxhash64("x").alias("o"), "x", "n")).alias("v"))
        first = kinds.where("size > 1").groupBy("size", F.col("low.x").alias("low"), "f").agg(F.min_by(F.struct("s", "v"), F.col("low.i")).alias("k"))
        lists = self.keep(first.select("k.s", "size", F.col("k.v.x").alias("p"), F.col("k.v.i").alias("pi"), F.col("k.v.n").alias("m")))
        return self.counted(_attached(cells, lists, "s", _large(lists, total))) if total else (lists.select("s", F.col("p").alias("x")), 0)

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(x, p, d, link) of the pairs (x, p, most) that may be within ``most``, from their whole sets."""
        percent = self.percent
        asked, total = self.counted(pairs.groupBy("x", "p").agg(F.max("most").alias("most")))
        hot = _hot(asked, total, "x", "p") if total else [[], []]
        near, total = self.counted(self._possible(asked, hot))
        ends = near.select("x").unionByName(near.select(F.col("p").alias("x"))).distinct()
        sets = self.keep(_sets(self.docs, ends.join(self.reps.select("x", "doc", "h0", "h1"), "x"), 2 * total, self.n)) if total else near.select("x", F.lit(b"").alias("items"))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, link = [], []
                for x, y in zip(batch.column(2), batch.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.sort(np.concatenate([x, y]))
                    common = int((both[1:] == both[:-1]).sum())
                    union = len(x) + len(y) - common
                    d.append(1 - common / union if union else 1.0)
                    link.append(bool(union) and 100 * common >= percent * union)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d, pa.float64()), pa.array(link, pa.bool_())], ["x", "p", "d", "link"])

        one = _attached(near, sets, "x", hot[0]).withColumnRenamed("items", "items_x")
        both = _attached(one, sets.withColumnRenamed("x", "p"), "p", hot[1])
        return self.keep(both.select("x", "p", "items_x", "items").mapInArrow(measure, "x long, p long, d double, link boolean"))

    def _possible(self, pairs: DataFrame, hot: list[list]) -> DataFrame:
        """Pairs (x, p, most) whose wide sketches differ in no more slots than their sets may differ in shingles."""

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                room, a, b = (batch.column(k).to_pylist() for k in range(2, 5))
                yield batch.select([0, 1]).filter(pa.array([_differing(u, v) <= most for most, u, v in zip(room, a, b)], pa.bool_()))

        wide = self.reps.select("x", "n", "wide")
        other = self.reps.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("wide").alias("wide_p"))
        both = _attached(_attached(pairs, wide, "x", hot[0]), other, "p", hot[1])
        return both.select("x", "p", _room(F.col("most")).alias("room"), "wide", "wide_p").mapInArrow(compare, "x long, p long")

    def links(self) -> DataFrame:
        """(a, b): links between classes of equal sets, by their numbers x, enough of them to connect all that links connect."""
        rows, total = self.lists()
        if not total:
            return rows.select(F.col("x").alias("a"), F.col("x").alias("b"))
        pairs, edges, cells = rows.where("x <> p").where(_apart("i", "pi") <= _room(self.reach)), None, None
        for level in range(LEVELS):
            found = self.measured(pairs.select("x", "p", F.lit(self.reach).alias("most"))).where("link")
            edges = self.keep(found.select("x", "p") if edges is None else edges.unionByName(found.select("x", "p")))
            nearest = found.select("x", "p", "d").unionByName(found.select(F.col("p").alias("x"), "p", F.lit(0.0).alias("d"))).groupBy("x").agg(F.min(F.struct("d", "p")).alias("c"))
            own = nearest.select("x", F.col("c.p").alias("q"), F.col("c.d").alias("d"))
            cells = self.keep(own if cells is None else cells.unionByName(own.join(cells, "x", "left_anti")))
            labels = _components(edges, self.scratch)
            placed = rows.select("s", "x", "i", "n").join(labels, "x", "left").withColumn("comp", F.coalesce("component", "x")).drop("component").join(cells, "x", "left")
            outside = F.min(F.when(F.col("q").isNull(), F.struct("i", F.xxhash64("x").alias("o"), "x", "n", "comp")))
            large = (F.col("size") > LARGE) & F.col("v").isNotNull()
            counts = placed.groupBy("s").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), outside.alias("v")).where("lo <> hi").drop("lo", "hi")
            lists, again = self.counted(counts, large)
            rows, total = self.counted(_attached(placed, lists, "s", _large(lists, total)))
            if not again:
                break
            fresh = rows.where(large).withColumns({"p": F.col("v.x"), "pi": F.col("v.i"), "m": F.col("v.n")}).where("x <> p AND comp <> v.comp")
            pairs = fresh.where(_apart("i", "pi") <= _room(self.reach))
        if total:
            found = self.measured(self._to_pivots(rows))
            edges = self.keep(edges.unionByName(found.where("link").select("x", "p")))
            across = self._in_regions(found.where("NOT link"), cells, edges)
            if across is not None:
                edges = self.keep(edges.unionByName(self.measured(across).where("link").select("x", "p")))
        return edges.select(F.col("x").alias("a"), F.col("p").alias("b"))

    def _to_pivots(self, rows: DataFrame) -> DataFrame:
        """(x, p, most): points of lists and the pivots of other components whose cells have points in the same list, where x may be in reach of the cell.

        A point outside all cells is a pivot whose cell is itself.
        """
        pivots = rows.groupBy("s", "size", F.coalesce("q", "x").alias("p")).agg(F.max(F.coalesce("d", F.lit(0.0))).alias("radius"), F.first("comp").alias("pc"), F.max(F.when(F.col("q").isNull(), F.col("i"))).alias("pi"))
        pivots, total = self.counted(pivots)
        pivots = _dealt(_attached(pivots, self.other, "p", *_hot(pivots, total, "p")), "p", _blocks("size"), _blocks("size"), "b", "a").drop("size")
        points = _dealt(rows.select("s", "x", "i", "comp", "size").join(self.narrow, "x"), "x", _blocks("size"), _blocks("size"), "a", "b").drop("size")
        most = F.col("radius") + self.reach
        near = F.abs(F.col("n") - F.col("m")) <= _room(most)
        placed = F.when(F.col("pi").isNull(), near).otherwise(_apart("i", "pi") <= _room(most))
        both = points.join(pivots, ["s", "a", "b"]).where(F.col("comp") != F.col("pc")).where(placed).where(_sketched() <= _room(most))
        return both.select("x", "p", most.alias("most"))

    def _in_regions(self, apart: DataFrame, cells: DataFrame, edges: DataFrame) -> DataFrame | None:
        """(x, p, most): points of a cell and points in the window of its pivot, in other components, that the triangle inequality lets link; None without any.

        ``apart`` are the measured pairs (x, p, d) without a link.
        """
        slack = 1e-9
        radius = cells.groupBy(F.col("q").alias("p")).agg(F.max("d").alias("radius")).where("radius > 0")
        window, total = self.counted(apart.join(radius, "p").where(F.col("d") <= F.col("radius") + self.reach + slack).select("p", F.col("x").alias("y"), F.col("d").alias("dy")))
        if not total:
            return None
        hot = _hot(window, total, "y", "p")
        comp = _components(edges, self.scratch).select("x", F.col("component").alias("comp"))
        named = _attached(window, comp.select(F.col("x").alias("y"), F.col("comp").alias("cy")), "y", hot[0], "left").withColumn("cy", F.coalesce("cy", "y"))
        named = _attached(named, comp.select(F.col("x").alias("p"), "comp"), "p", hot[1])  # a pivot of a cell has links, and so a label
        window, total = self.counted(named.where("cy <> comp").drop("comp", "cy"))
        if not total:
            return None
        low = window.groupBy("p").agg(F.min("dy").alias("low"), F.count("*").alias("w"))
        members = cells.withColumnRenamed("q", "p").where("d > 0").join(F.broadcast(low) if total <= BLOCK else low, "p")
        shell = self.keep(members.where(F.col("d") >= F.col("low") - self.reach - slack).select("p", "x", F.col("d").alias("dx"), "w"))
        size, total = self.counted(shell.groupBy("p").agg(F.count("*").alias("k"), F.first("w").alias("w")))
        if not total:
            return None
        shell = _dealt(shell.drop("w").join(size, "p").join(self.narrow, "x"), "x", _blocks("k"), _blocks("w"), "a", "b").drop("k", "w")
        beyond = _attached(window.join(size, "p"), self.other.withColumnRenamed("p", "y"), "y", hot[0])
        beyond = _dealt(beyond, "y", _blocks("w"), _blocks("k"), "b", "a").drop("k", "w")
        room = _room(self.reach)
        pairs = shell.join(beyond, ["p", "a", "b"]).where(F.col("dy") - F.col("dx") <= self.reach + slack).where(F.abs(F.col("n") - F.col("m")) <= room).where(_sketched() <= room)
        return pairs.select("x", F.col("y").alias("p"), F.lit(self.reach).alias("most"))


def _large(lists: DataFrame, total: int) -> list:
    """The lists that hold more than one in HOT_KEYS of the ``total`` rows."""
    return [r.s for r in lists.where(F.col("size") > total / HOT_KEYS).select("s").collect()]


def _blocks(size: str) -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("int")


def _dealt(rows: DataFrame, key: str, mine: Column, others: Column, own: str, other: str) -> DataFrame:
    """rows with their own block and a copy for each block of the other side, so that a pair of blocks is one task's work."""
    return rows.withColumns({own: F.pmod(F.xxhash64(key, F.lit(5)), mine).cast("int"), other: F.explode(F.sequence(F.lit(0), others - 1))})


def _components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, component): the smallest number that each end of an edge (its two columns) reaches.

    Labels spread to neighbours and then jump to their label's label, one round for
    each table, until none changes.  A round reads the labels three times, so two in
    one plan would be nine readings for the driver to plan.
    """
    a, b = edges.columns
    both, total = scratch.counted(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).unionByName(edges.select(F.col(b).alias("a"), F.col(a).alias("b"))))
    labels = scratch.written(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("low")).select("x", F.least("low", "x").alias("component")))
    hubs = _hot(both, total, "b")[0] if total else []
    moved = total
    while moved:
        heard = _attached(both, labels.select(F.col("x").alias("b"), "component"), "b", hubs).groupBy("a").agg(F.min("component").alias("heard"))
        spread = labels.join(heard, labels.x == heard.a).select("x", "component", F.least("component", "heard").alias("c"))
        jump = labels.select(F.col("x").alias("c"), F.col("component").alias("cc"))
        lowest = F.least("c", F.coalesce("cc", "c"))
        labels, moved = scratch.counted(spread.join(jump, "c", "left").select("x", lowest.alias("component"), (lowest != F.col("component")).alias("moved")), F.col("moved"))
    return labels.select("x", "component")


def _same_id(rows: DataFrame) -> DataFrame:
    """(a, b): edges that connect the classes (named by their smallest doc_id) of each doc_id that has several."""
    own = rows.where("doc_id IS NOT NULL AND doc IS NOT NULL").select("doc_id", "doc").distinct()
    several = own.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    return own.join(several, "doc_id").where("doc_id <> doc").select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))


def _named(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, the digest (h0, null for an empty set, and h1) and component_id of each row of ``docs``, as a table."""
    scratch = Scratch(docs.sparkSession)
    keep = scratch.written
    signed = keep(_signatures(docs, n, percent))
    classes = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h0", "h1").agg(F.min("doc_id").alias("doc"), F.first(F.struct("n", "window", "wide", *_SKETCH)).alias("v"))
    reps = keep(classes.select(F.monotonically_increasing_id().alias("x"), "doc", "h0", "h1", "v.*"))
    found = _Join(docs, reps, n, percent, scratch).links()
    number, (found, total) = reps.select("x", "doc"), scratch.counted(found)
    hot = _hot(found, total, "a", "b") if total else [[], []]
    linked = _attached(found, number.withColumnsRenamed({"x": "a", "doc": "c"}), "a", hot[0])
    linked = _attached(linked, number.withColumnsRenamed({"x": "b", "doc": "d"}), "b", hot[1])
    keys, total = scratch.counted(signed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("h0")).alias("h0"), "h1"))
    copies = _hot(keys, total, "h0")[0] if total else []
    rows = keep(_attached(keys, reps.select("h0", "h1", "doc"), "h0", copies, "left", ("h1",)))
    edges = linked.where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b")).unionByName(_same_id(rows))
    labels = _components(keep(edges), scratch)
    named = reps.select("doc").distinct().join(labels.withColumnRenamed("x", "doc"), "doc", "left")
    with_set = _attached(rows.where("doc IS NOT NULL"), named, "doc", _hot(rows, total, "doc")[0] if total else []).select("doc_id", "n", "h0", "h1", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))
    # A row without words belongs to what its doc_id's other rows belong to.
    others = with_set.where("doc_id IS NOT NULL").select("doc_id", "component_id").distinct()
    without = rows.where("doc IS NULL").join(others, "doc_id", "left").select("doc_id", "n", "h0", "h1", F.coalesce("component_id", "doc_id").alias("component_id"))
    result = written(with_set.unionByName(without))
    scratch.clear()
    return result


def jaccard_join(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each row of ``docs``.

    A null, empty or wordless text has an empty set and links with nothing.  Rows
    with the same doc_id are one document, whatever their texts, with a row each:
    what any of their texts links with is one component, which all of them have.
    A null doc_id links with nothing and has a null component.  Other columns are
    ignored; an empty table gives no rows.  Ties need no rule: links have a
    threshold only, and components take the smallest id.
    """
    return _named(docs, n, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _with_digests(docs: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with the size and the digest of their sets."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1)):
                found = list(shingle_sets(slab, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(slab.first, slab.n), pa.array([len(s) for s in found], pa.int64()), *_digest_columns([_digest(s) for s in found])], ["row", "n", "h0", "h1"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return rows.mapInArrow(digest, f"row {rows.schema['row'].dataType.simpleString()}, n long, h0 long, h1 long")


def _one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the rows (struct ``row``) with the same keys the first one: texts with words before others, then by the text, then by all columns."""
    wordless = ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = F.struct(wordless.alias("wordless"), F.col("row.text").alias("text"), F.xxhash64(F.to_json("row")).alias("hash"))
    return rows.groupBy(*keys).agg(F.min_by("row", order).alias("row")).select("row.*")


def deduplicated(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all their columns: one row of each component, of the document with the smallest doc_id.

    A doc_id that stands on several rows gives one of them, with words if one has
    any.  Rows with a null doc_id link with nothing; of those with equal sets one
    stays, and all without words.
    """
    named = _named(docs, n, percent)
    repeated = written(named.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"))
    gone = named.where("component_id <> doc_id").select("doc_id").distinct().unionByName(repeated)
    kept = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
    copies = named.where("doc_id IS NULL AND n > 0").groupBy("h0", "h1").agg(F.count("*").alias("k")).where("k > 1")
    if not copies.isEmpty():
        unnamed = _with_digests(kept.where("doc_id IS NULL"), n)
        kept = kept.where("doc_id IS NOT NULL").unionByName(unnamed.where("n = 0").select("row.*")).unionByName(_one_of_each(unnamed.where("n > 0"), "h0", "h1"))
    if not repeated.isEmpty():
        rows = docs.join(repeated, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"))
        kept = kept.unionByName(_one_of_each(rows.withColumn("key", F.col("row.doc_id")), "key"))
    return kept


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
ORACLE_SQL = {
    "op4_jaccard_join": r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(4, len(w))], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(4, len(w)) + 1)) AS i FROM w WHERE len(w) > 0) t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
    e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
    FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)"""
}
