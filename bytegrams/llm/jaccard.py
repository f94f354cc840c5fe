"""N-gram Jaccard join with count vectors in R-trees.

Documents link when 100 |A n B| >= 80 |A u B| for their sets of word shingles.
Equal sets are one node. Shingles are dealt into groups by hash, and a set's
counts by group are its point. Two sets share at most the sum of the minima of
their coordinates; an R-tree over points bounds a whole box by its corner of
largest coordinates.

Boxes of random sets overlap in many dimensions, so one tree over a corpus
would prune little. The trees are built in blocks that lose no link:

* a set's first d + 1 shingles in a fixed order are its block keys, where d
  bounds how many of its shingles a linked set can lack (prefix filter), so
  linked sets have a block in common. The first shingle that they share tells
  that all before it differ: the places of both add up to what may differ at
  most (positional filter);
* shingles that many documents have come last in that order, so a common
  passage makes blocks only for texts that are little else. Any order is right;
* the tree of a block joins its nodes to clusters by pairs that finer points
  allow. Of these pairs only a spanning forest leaves the task, so a block of m
  nodes makes m - 1 rows at most, however many of them are alike;
* linked sets are in one cluster, and few others are. Clusters get their sets,
  and a tree in each finds the pairs that are verified, again a spanning forest.

A block or cluster too large for a task is cut into pieces by size, and every
two pieces whose sizes allow a link meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import bounded_rows, cut, fresh
from bytegrams.llm.components import components

#: Coordinates of a point in a tree.
GROUPS = 64
#: A node's fine point has about a group for each eight shingles, a byte each, in powers of two between these.
FINE, FINE_FULL = (GROUPS, 1024), 255
#: Counts from here on mean "any number".
FULL = np.iinfo(np.uint16).max
#: Ids that may be broadcast: 16 bytes each, a few times that as a hash table.
MOST_IDS = 500_000
#: Nodes of a block, and shingles of a cluster, that a task compares among themselves.
PIECE, PIECE_SHINGLES = 8192, 2_000_000
#: Children of a box.
FAN = 16
#: Groups of so many rows at most share one tree, which is searched for all of them at once.
SMALL = 32
#: Nodes nearest to the middle of a group, which ask first.
LEADERS = 4
#: Shingles whose repeats are counted together before Spark adds them up.
TOGETHER = 1_000_000
#: Shingles that come last: the most frequent ones, so many at most, of those counted so often at least.
MOST_COMMON, COMMON = 500_000, 8


def sets_of(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as (text number, hash), sorted. A shorter text is one shingle, one without words has none."""
    w = kn.words(column, lower=True)
    counts = np.where(w.counts >= size, w.counts - size + 1, (w.counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = w.first[doc] + kn.spread(counts)
    h = kn.window_hashes(w.hash, begin, np.minimum(begin + size, w.first[doc + 1]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit numbers by document, modulo 2 ** 64."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two signatures) of each document's set; together they name the set with 128 bits."""
    size = np.bincount(doc, minlength=n)
    one = kn.mix(h)
    return size, *(kn.mix(_sums(x, doc, n) + size.astype(np.uint64)) for x in (one, kn.mix(one + np.uint64(1))))


def fine_points(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Counts by the first bits of the hash; a point folds into one of fewer groups by adding neighbours."""
    bits = np.clip(np.frexp(np.maximum(n, 1) / 8)[1], *(x.bit_length() - 1 for x in FINE))
    base = np.r_[0, np.cumsum(1 << bits)]
    count = np.bincount(base[doc] + (h >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64), minlength=int(base[-1]))
    raw = np.minimum(count, FINE_FULL).astype(np.uint8).tobytes()
    return [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


class FinePoints:
    """Fine points of a batch of nodes, by their number of groups."""

    def __init__(self, raw: list[bytes]):
        width = np.fromiter(map(len, raw), np.int64, len(raw))
        self.width, self.row = width, np.zeros(len(raw), np.int64)
        self.of: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            self.row[at] = np.arange(len(at))
            counts = np.frombuffer(b"".join([raw[k] for k in at.tolist()]), np.uint8).reshape(len(at), w).astype(np.uint16)
            self.of[w, w] = np.where(counts == FINE_FULL, np.uint16(FULL), counts)

    def folded(self, width: int, to: int) -> np.ndarray:
        if (width, to) not in self.of:
            full = self.of[width, width].reshape(-1, to, width // to).astype(np.int64).sum(2)
            self.of[width, to] = np.minimum(full, FULL).astype(np.uint16)
        return self.of[width, to]

    def coarse(self) -> np.ndarray:
        out = np.zeros((len(self.row), GROUPS), np.uint16)
        for w in np.unique(self.width).tolist():
            out[self.width == w] = self.folded(w, GROUPS)
        return out

    def shared(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """At most so many shingles do the nodes q and p share, pair by pair."""
        out = np.zeros(len(q), np.int64)
        kinds = self.width[q] << 20 | self.width[p]
        for kind in np.unique(kinds).tolist():
            at = np.flatnonzero(kinds == kind)
            a, b = kind >> 20, kind & (1 << 20) - 1
            fewer = min(a, b)
            out[at] = least_sums(self.folded(a, fewer), self.row[q[at]], self.folded(b, fewer), self.row[p[at]])
        return out


def least_sums(a: np.ndarray, q: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums of the minima of a[q] and b[p], pair by pair."""
    out = np.empty(len(q), np.int64)
    step = max(1, (1 << 23) // max(1, a.shape[1]))
    for k in range(0, len(q), step):
        out[k : k + step] = np.minimum(a[q[k : k + step]], b[p[k : k + step]]).sum(1)
    return out


def once(n: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Sizes with 0 for all but the first of equal sets."""
    first = np.zeros(len(n), bool)
    first[np.unique(sig, return_index=True)[1]] = True
    return np.where(first, n, 0)


def nodes_of(docs: DataFrame, size: int) -> DataFrame:
    """docs (row, doc_id, content, text) -> (row, doc_id, content, n, sig, sig2, fine binary, key, times).

    A row a document, whose last two columns are null, and whose signatures
    and point are null for an empty set; and rows (key, times) for shingles
    that several documents of a part of the input have.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("row", "doc_id", "content", "n", "sig", "sig2")] + [("fine", pa.binary()), ("key", pa.int64()), ("times", pa.int64())])

    def repeated(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, times = np.unique(np.concatenate(keys), return_counts=True)
        key, times = key[times > 1], times[times > 1]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(key), t) for t in schema.types[:7]], kn.signed(key), pa.array(times.astype(np.int64))], schema=schema)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h = sets_of(part.column("text"), size)
                n, sig, sig2 = signatures(doc, h, part.num_rows)
                none = n == 0
                fine = [None if empty else p for empty, p in zip(none.tolist(), fine_points(doc, h, n), strict=True)]
                names = [pa.array(x.view(np.int64), mask=none) for x in (sig, sig2)]
                yield pa.RecordBatch.from_arrays([*map(part.column, ("row", "doc_id", "content")), pa.array(n.astype(np.int64)), *names, pa.array(fine, pa.binary()), *[pa.nulls(len(n), pa.int64())] * 2], schema=schema)
                keys.append(h[once(n, sig)[doc] > 0])
                if sum(map(len, keys)) > TOGETHER:
                    yield repeated(keys)
                    keys = []
        if keys:
            yield repeated(keys)

    return docs.mapInArrow(found, "row long, doc_id long, content long, n long, sig long, sig2 long, fine binary, key long, times long")


def common_shingles(nodes: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that come last; MOST_COMMON numbers at most reach the driver."""
    counted = nodes.filter("key IS NOT NULL").groupBy("key").agg(F.sum("times").alias("times")).filter(F.col("times") >= COMMON)
    found = counted.orderBy(F.desc("times"), "key").limit(MOST_COMMON).select("key").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def keys_of(docs: DataFrame, size: int, percent: int, common: np.ndarray) -> DataFrame:
    """docs (text) -> (key, sig, n, place): the first shingles of each set, by whether they are common, then by hash, and
    where in that order they are. Equal sets of a part are taken once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h = sets_of(part.column("text"), size)
                n, sig, _ = signatures(doc, h, part.num_rows)
                inside = once(n, sig)[doc] > 0
                doc, h = doc[inside], h[inside]
                at = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
                last = common[at] == h if len(common) else np.zeros(len(h), bool)
                order = np.lexsort((last, doc))  # by hash already
                doc, h = doc[order], h[order]
                place = kn.spread(np.bincount(doc, minlength=part.num_rows))
                # a linked set has percent percent of these at least
                keep = place <= n[doc] - (n[doc] * percent + 99) // 100
                of = doc[keep]
                yield pa.RecordBatch.from_arrays([kn.signed(h[keep]), kn.signed(sig[of]), pa.array(n[of].astype(np.int32)), pa.array(place[keep].astype(np.int32))], ["key", "sig", "n", "place"])

    return docs.select("text").mapInArrow(found, "key long, sig long, n int, place int")


def _may_link(shared: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b that share at most ``shared`` can link."""
    shared = np.minimum(shared, np.minimum(a, b))
    return 100 * shared >= percent * (a + b - shared)


def _may_differ(places: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether linked sets of these sizes, added up, can have so many shingles before the first that they share."""
    return places * (100 + percent) <= sizes * (100 - percent)


@dataclass
class Tree:
    """A packed R-tree. levels[0] are the rows in ``order``; each further level has a box for FAN of the one below: its
    corner of largest counts, its smallest and largest size, its smallest place, its first and last group."""

    order: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def packed(points: np.ndarray, n: np.ndarray, place: np.ndarray, group: np.ndarray) -> Tree:
    """Rows are sorted by group, into slabs by size, and in a slab by the two coordinates of largest spread. The group is one
    more coordinate of a box, with a smallest and a largest value."""
    by_size = np.argsort(n, kind="stable")
    by_size = by_size[np.argsort(group[by_size], kind="stable")]
    slab = np.empty(len(n), np.int64)
    slab[by_size] = np.arange(len(n)) // (FAN * FAN)
    one, two = np.argsort(-points.var(0))[:2]
    order = np.lexsort((points[:, two], points[:, one], slab, group))
    levels = [(points[order], n[order], n[order], place[order], group[order], group[order])]
    while len(levels[-1][1]) > FAN:
        corner, small, large, near, first, last = levels[-1]
        begin = np.arange(0, len(small), FAN)
        levels.append((np.maximum.reduceat(corner, begin, axis=0), np.minimum.reduceat(small, begin), np.maximum.reduceat(large, begin), np.minimum.reduceat(near, begin), np.minimum.reduceat(first, begin), np.maximum.reduceat(last, begin)))
    return Tree(order, levels)


def search(tree: Tree, points: np.ndarray, n: np.ndarray, place: np.ndarray, group: np.ndarray, queries: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, bound): the pairs in a group that points, sizes and places allow, and how many shingles they share at most."""
    top = len(tree.levels[-1][1])
    q, box = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
    bound = np.zeros(0, np.int64)
    for depth in range(len(tree.levels) - 1, -1, -1):
        corner, small, large, near, first, last = tree.levels[depth]
        inside = (first[box] <= group[q]) & (group[q] <= last[box])
        q, box = q[inside], box[inside]
        # the size in the box that suits the query best
        ok = _may_differ(place[q] + near[box], n[q] + large[box], percent) & _may_link(large[box], n[q], np.clip(n[q], small[box], large[box]), percent)
        q, box = q[ok], box[ok]
        bound = least_sums(points, q, corner, box)
        # where no more than bound can be shared, a smaller set suits better
        ok = _may_link(bound, n[q], np.clip(np.minimum(n[q], bound), small[box], large[box]), percent)
        q, box, bound = q[ok], box[ok], bound[ok]
        if depth:
            inside = np.minimum(FAN, len(tree.levels[depth - 1][1]) - box * FAN)
            q, box = np.repeat(q, inside), np.repeat(box * FAN, inside) + kn.spread(inside)
    return q, tree.order[box], bound


Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Forest:
    """Components of the rows 0 to m - 1, and the pairs that joined them."""

    def __init__(self, m: int):
        self.of, self.pairs = np.arange(m), []

    def join(self, q: np.ndarray, p: np.ndarray) -> None:
        for a, b in zip(q.tolist(), p.tolist(), strict=True):
            if self.of[a] != self.of[b]:
                self.pairs.append((a, b))
                self.of[self.of == self.of[b]] = self.of[a]


def tree_forest(points: np.ndarray, n: np.ndarray, place: np.ndarray, half: np.ndarray, percent: int, check: Check) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the tree finds and check(q, p) confirms.

    Pairs are of different halves where there are two. The rows nearest to
    the middle ask first. What they are joined with need not ask any more:
    whoever isn't in that component asks, and meets it.
    """
    alone = np.zeros(len(n), np.int64)  # one group
    tree, forest, across = packed(points, n, place, alone), Forest(len(n)), bool(half.any())
    middle = np.median(points, axis=0)
    central = np.argsort(-np.minimum(points, middle).sum(1) / np.maximum(points, middle).sum(1), kind="stable")

    def settle(queries: np.ndarray) -> None:
        q, p, bound = search(tree, points, n, place, alone, queries, percent)
        keep = (forest.of[q] != forest.of[p]) & ((half[q] != half[p]) | (not across))
        q, p, bound = q[keep], p[keep], bound[keep]
        order = np.argsort(-bound / (n[q] + n[p]), kind="stable")
        q, p = q[order], p[order]
        tries = 1
        while len(q):  # of each query and component the likeliest first, then more at a time
            group = np.lexsort((np.arange(len(q)), forest.of[p], q))
            new = np.ones(len(q), bool)
            new[1:] = (q[group][1:] != q[group][:-1]) | (forest.of[p[group]][1:] != forest.of[p[group]][:-1])
            rank = np.empty(len(q), np.int64)
            rank[group] = kn.spread(np.diff(np.r_[np.flatnonzero(new), len(q)]))
            now = rank < tries
            ok = check(q[now], p[now])
            forest.join(q[now][ok], p[now][ok])
            q, p = q[~now], p[~now]
            keep = forest.of[q] != forest.of[p]
            q, p = q[keep], p[keep]
            tries *= 4

    settle(central[:1])
    settle(central[1:LEADERS])
    step = max(1, (1 << 19) // len(n))
    k = LEADERS
    while k < len(central):
        queries = central[k : k + step]
        k += step
        if len(queries := queries[forest.of[queries] != forest.of[central[0]]]):
            settle(queries)
    return forest.pairs


def small_forest(points: np.ndarray, n: np.ndarray, place: np.ndarray, half: np.ndarray, begin: np.ndarray, size: np.ndarray, percent: int, check: Check) -> list[tuple[int, int]]:
    """The same for many small groups at once: rows begin to begin + size are a group. They share a tree, in which the group
    is a coordinate, and every row asks it."""
    if not len(begin):
        return []
    row = np.repeat(begin, size) + kn.spread(size)
    group = np.repeat(np.arange(len(begin)), size)
    across = np.maximum.reduceat(half[row], np.cumsum(size) - size) > 0
    tree = packed(points[row], n[row], place[row], group)
    found = []
    for k in range(0, len(row), 1 << 16):
        q, p, _ = search(tree, points[row], n[row], place[row], group, np.arange(k, min(k + (1 << 16), len(row))), percent)
        ok = (q < p) & ((half[row[q]] != half[row[p]]) | ~across[group[q]])
        found.append((row[q[ok]], row[p[ok]]))
    q, p = (np.concatenate(x) for x in zip(*found, strict=True))
    ok = check(q, p)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(y, y)
        return x

    pairs = []
    for a, b in zip(q[ok].tolist(), p[ok].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            pairs.append((a, b))
    return pairs


def forests(points: np.ndarray, n: np.ndarray, place: np.ndarray, half: np.ndarray, begin: np.ndarray, percent: int, check: Check) -> np.ndarray:
    """Pairs of rows that span the components of each group; groups begin at ``begin`` and end where the next begins."""
    size = np.diff(np.r_[begin, len(n)])
    small = (size <= SMALL) & (size > 1)
    pairs = []
    few, few_size = begin[small], size[small]
    share = np.cumsum(few_size**2) // 1_000_000
    for k in np.unique(share):
        at = share == k
        pairs += small_forest(points, n, place, half, few[at], few_size[at], percent, check)
    for lo, m in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        s = slice(lo, lo + m)
        pairs += [(a + lo, b + lo) for a, b in tree_forest(points[s], n[s], place[s], half[s], percent, lambda q, p, lo=lo: check(q + lo, p + lo))]
    return np.array(pairs, np.int64).reshape(-1, 2)


MEET = ["group", "i", "j"]


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str] = MEET) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of a part that is sorted by those columns, in batches that end between groups, and where the groups begin."""
    held: list[pa.RecordBatch] = []

    def ends(batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column(c).to_numpy() for c in by]
        return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        first, last = held[0], batch
        if all(first.column(c)[0] == last.column(c)[-1] for c in by):
            continue  # one group so far
        rows = pa.concat_batches(held)
        begin = ends(rows)
        yield rows.slice(0, int(begin[-1])), begin[:-1]
        held = [rows.slice(int(begin[-1]))]
    if held:
        yield pa.concat_batches(held), np.zeros(1, np.int64)


def meeting(rows: DataFrame, weight: Column, most: int, percent: int, name: str) -> DataFrame:
    """rows (group, n, a column called name, ...) with meets array<struct<i,j,half>>: where each row meets others of its group.

    A group whose weights add up to ``most`` is one piece. A larger one is cut
    by size into classes that are so wide that linked sets are of the same or
    of neighbouring ones, and a class that is too large by ``name``. Every two
    pieces that may have links meet in (i, j): half 0 of them with half 1.
    """
    step = math.log(100 / percent) * 1.001
    rows = rows.withColumn("class", F.floor(F.log("n") / F.lit(step)).cast("int"))
    weights = rows.groupBy("group", "class").agg(F.sum(weight).alias("weight"))
    large = weights.groupBy("group").agg(F.sum("weight").alias("weight"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("weight") / most).cast("int").alias("parts")))).alias("parts"))
    joined = rows.join(large.filter(F.col("weight") > most).select("group", "parts"), "group", "left")
    parts = lambda c: F.coalesce(F.try_element_at("parts", c), F.lit(0))
    piece = lambda c, r: c.cast("long") * (1 << 32) + r
    own = piece(F.col("class"), F.pmod(F.xxhash64(name), parts(F.col("class"))))
    others = F.flatten(F.transform(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1), lambda c: F.when(parts(c) > 0, F.transform(F.sequence(F.lit(0), parts(c) - 1), lambda r: piece(c, r))).otherwise(F.array().cast("array<bigint>"))))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("half")))
    meets = F.transform(others, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("int").alias("half")))
    return joined.withColumn("meets", F.when(F.col("parts").isNull(), whole).otherwise(meets)).drop("class", "parts")


def met(rows: DataFrame) -> DataFrame:
    """rows with meets -> a row for each of them, those of one meeting together."""
    each = rows.withColumn("m", F.explode("meets")).select("m.*", *[c for c in rows.columns if c != "meets"])
    return each.repartition(*MEET).sortWithinPartitions(*MEET)


def partnered(rows: DataFrame, percent: int) -> DataFrame:
    """rows (group, i, j, half, sig, n, place) that another one of their meeting suits in size and place; repeats once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in whole_groups(batches):
            half, sig, n, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("half", "sig", "n", "place"))
            number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(n)]))
            order = np.lexsort((half, sig, number))
            same = (number[order][1:] == number[order][:-1]) & (sig[order][1:] == sig[order][:-1])
            order = order[np.r_[True, ~same]]
            half, n, place, number = half[order], n[order], place[order], number[order]
            begin = np.searchsorted(number, np.arange(len(begin)))
            size = np.diff(np.r_[begin, len(n)])
            keep = size[number] > SMALL
            few = (size <= SMALL) & (size > 1)
            share = np.cumsum(np.where(few, size**2, 0)) // 1_000_000
            for k in np.unique(share[few]):
                b, s = begin[few & (share == k)], size[few & (share == k)]
                row = np.repeat(b, s) + kn.spread(s)
                rest = np.repeat(s, s) - 1 - kn.spread(s)
                q = np.repeat(row, rest)
                p = q + 1 + kn.spread(rest)
                ok = _may_differ(place[q] + place[p], n[q] + n[p], percent) & _may_link(n[p], n[q], n[p], percent)
                keep[q[ok]] = keep[p[ok]] = True
            yield batch.take(pa.array(order[keep]))

    return rows.mapInArrow(found, rows.schema)


def block_forests(rows: DataFrame, percent: int) -> DataFrame:
    """rows (group, i, j, half, node, n, place, fine), meeting by meeting -> (u, v): nodes that finer points let link."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in whole_groups(batches):
            half, node, n, place = (batch.column(c).to_numpy().astype(np.int64) for c in ("half", "node", "n", "place"))
            fine = FinePoints(batch.column("fine").to_pylist())
            pairs = node[forests(fine.coarse(), n, place, half, begin, percent, lambda q, p: _may_link(fine.shared(q, p), n[q], n[p], percent))]
            pairs = np.unique(np.stack([pairs.max(1), pairs.min(1)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return rows.mapInArrow(found, "u long, v long")


def shared_shingles(ids: np.ndarray, edge: np.ndarray, q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How many ids the sets q and p share, pair by pair; set k has ids[edge[k] : edge[k + 1]], each once."""
    out = np.zeros(len(q), np.int64)
    if not len(q):
        return out
    mark = np.zeros(int(ids.max(initial=0)) + 1, bool)
    order = np.argsort(q, kind="stable")
    begin = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
    for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(q)], strict=True):
        own = ids[edge[q[order[lo]]] : edge[q[order[lo]] + 1]]
        mark[own] = True
        for k in range(lo, hi, 256):
            at = order[k : min(k + 256, hi)]
            size = edge[p[at] + 1] - edge[p[at]]
            hit = mark[ids[np.repeat(edge[p[at]], size) + kn.spread(size)]]
            out[at] = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        mark[own] = False
    return out


def verified_forests(rows: DataFrame, percent: int) -> DataFrame:
    """rows (group, i, j, half, node, shingles), meeting by meeting -> (u, v): links that span its linked nodes."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in whole_groups(batches):
            lists = batch.column("shingles")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            h = lists.values.to_numpy().view(np.uint64)
            half, node = (batch.column(c).to_numpy().astype(np.int64) for c in ("half", "node"))
            # groups go in parts of about PIECE_SHINGLES shingles
            part = (offsets[begin] - offsets[0]) // PIECE_SHINGLES
            starts = begin[np.r_[True, part[1:] != part[:-1]]]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                edge = offsets[lo : hi + 1] - offsets[lo]
                own = h[offsets[lo] : offsets[hi]]
                n = np.diff(edge)
                doc = np.repeat(np.arange(hi - lo), n)
                points = np.bincount(doc * GROUPS + (own >> np.uint64(58)).astype(np.int64), minlength=(hi - lo) * GROUPS).reshape(-1, GROUPS)
                points = np.minimum(points, FULL).astype(np.uint16)
                ids = np.unique(own, return_inverse=True)[1]
                inside = begin[(begin >= lo) & (begin < hi)] - lo
                check = lambda q, p, ids=ids, edge=edge, n=n: _may_link(shared_shingles(ids, edge, q, p), n[q], n[p], percent)
                pairs = node[lo:hi][forests(points, n, np.zeros(hi - lo, np.int64), half[lo:hi], inside, percent, check)]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.max(1)), pa.array(pairs.min(1))], ["u", "v"])

    return rows.mapInArrow(found, "u long, v long")


def shingled(rows: DataFrame, size: int) -> DataFrame:
    """rows (group, meets, node, text) with the shingles of text in its place."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h = sets_of(part.column("text"), size)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*map(part.column, ("group", "meets", "node")), pa.ListArray.from_arrays(pa.array(edge), kn.signed(h))], ["group", "meets", "node", "shingles"])

    return rows.select("group", "meets", "node", "text").mapInArrow(found, "group long, meets array<struct<i:long,j:long,half:int>>, node long, shingles array<long>")


def clusters_of(docs: DataFrame, nodes: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(node, component): nodes that links connect are in one component; it may hold others."""
    keys = keys_of(docs, size, percent, common)
    several = keys.groupBy("key").agg(F.min("sig").alias("least"), F.max("sig").alias("most")).filter("least <> most")
    # copies in other parts of the input have the same keys: a set is in a block once
    shared = cut(keys.join(several.select("key"), "key", "left_semi").dropDuplicates(["key", "sig"]).withColumnRenamed("key", "group"))
    blocks = partnered(met(meeting(shared, F.lit(1), PIECE, percent, "sig")), percent)
    with_points = blocks.join(nodes.select("sig", "node", "fine"), "sig")
    return components(block_forests(with_points.repartition(*MEET).sortWithinPartitions(*MEET), percent))


def link_nodes(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): links between nodes, enough to connect all that the full graph of links connects."""
    members = clusters.select("node", F.col("component").alias("group")).join(nodes.select("node", "n", "doc_id", "content"), "node")
    needed = cut(meeting(members, F.col("n"), PIECE_SHINGLES, percent, "node").select("group", "meets", "node", F.col("doc_id").alias("needed"), F.col("content").alias("wanted")))
    if needed.isEmpty():
        return needed.select(F.col("node").alias("u"), F.col("node").alias("v"))
    small = F.broadcast(needed) if bounded_rows(needed, MOST_IDS) else needed
    # a node's text is found by id and content: several texts may have one id, and several rows may be the same
    found = docs.join(small, F.col("doc_id").eqNullSafe(F.col("needed")) & (F.col("content") == F.col("wanted"))).groupBy("node").agg(*[F.first(c).alias(c) for c in ("group", "meets", "text")])
    return verified_forests(met(shingled(found, size)), percent)


def _named(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, content, text)."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), _content_of(docs).alias("content"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def _content_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def classed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row of docs: doc_id, content, n, and the smallest row that it is linked with as the struct ``least`` of
    (none: whether the id is null, doc_id, content); null for a row without shingles."""
    docs = _named(docs)
    every = cut(nodes_of(docs.withColumn("row", F.monotonically_increasing_id()), size))
    rows = every.filter("key IS NULL").select("row", "doc_id", "content", "n", "sig", "sig2", "fine")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    nodes = cut(rows.filter("sig IS NOT NULL").groupBy("sig", "sig2").agg(F.min("row").alias("node"), F.min(own).alias("least"), F.first("n").alias("n"), F.first("fine").alias("fine")))
    clusters = clusters_of(docs, nodes, common_shingles(every), size, percent)
    return least_of(rows, nodes, link_nodes(docs, nodes.select("node", "n", "least.doc_id", "least.content"), clusters, size, percent))


def least_of(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rows (doc_id, content, n, sig, sig2) with ``least`` of the component that their node is in."""
    found = components(links)
    named = nodes.join(found, "node", "left").select("sig", "sig2", "least", F.coalesce("component", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("least").alias("least"))
    of = named.select("sig", "sig2", "class").join(least, "class").select("sig", "sig2", "least")
    return rows.join(of, ["sig", "sig2"], "left").select("doc_id", "content", "n", "least")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing.
    Repeated rows and copies have one node; rows of one id but different
    texts are nodes of their own and share no component for that. Rows of
    null id are linked, but name no component; one of such rows alone has
    null. Very long texts are sets like others. No rows: no rows. Further
    columns are ignored.
    """
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return classed(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that stand for what they are linked with: one row of each component, of its smallest
    id and of that id's smallest content. Null ids come last.

    Rows are told apart by id and text. Rows of null id, and rows that share an id, stay unless they are themselves linked
    with a row that stays. Any one stays of rows whose id and text are the same; those without shingles all stay.
    """
    rows = classed(docs, size, percent).filter("least IS NOT NULL").groupBy("doc_id", "content").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("times"))
    stands = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.content") == F.col("content"))
    name = fresh(docs, "id_of_row", "content_of_row")
    moved = cut(rows.select(stands.alias("stands"), "times", F.col("doc_id").alias(name[0]), F.col("content").alias(name[1])).filter("NOT stands OR times > 1"))
    same = lambda: docs["doc_id"].cast("long").eqNullSafe(F.col(name[0])) & (_content_of(docs) == F.col(name[1]))
    kept = docs.join(moved.select(*name), same(), "left_anti")
    repeated = moved.filter("stands").select(*name)
    if repeated.isEmpty():
        return kept
    return kept.union(docs.join(repeated, same()).dropDuplicates(name).drop(*name))


#: All pairs that share a shingle; fit for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(reached) FROM r WHERE r.doc_id = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
"""
