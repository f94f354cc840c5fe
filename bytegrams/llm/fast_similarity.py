"""Near duplicates by fast similarity sketching.

A set's sketch has COORDINATES values. In each round every shingle is placed
in one coordinate by a hash of that round, and an empty or larger value there
gives way; values of earlier rounds are smaller than those of later ones. A set
is ready when each coordinate has a value. After as many rounds as there are
coordinates, round by round one coordinate that is still empty gets the least
hash of all shingles, so every coordinate fills, however small the set is. Two
sets agree in a coordinate with the probability of their likeness, and the
number of agreements is concentrated as if coordinates were drawn apart.

Bands of coordinates are keys: sets of likeness 0.8 share none of 32 keys of
four coordinates with a probability of 5e-8. Groups of the same sets behind
several keys are one group. In a group, sets whose sketches agree in ``least``
coordinates (fewer with a probability below 1e-6 at likeness 0.8) join a
cluster; pairs don't leave the task, only those that join do. The clusters are
verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import cut
from bytegrams.llm.components import components
from bytegrams.llm.jaccard import MEET, PIECE, _named, least_of, link_nodes, meeting, met, sets_of, signatures, whole_groups

COORDINATES, ROWS = 128, 4
BANDS = COORDINATES // ROWS
#: Groups of so many sets at most are compared together with others.
FEW = 32
U64 = np.uint64
EMPTY = ~U64(0)
#: A number for each round, and one for each band.
ROUNDS = kn.mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xA0761D6478BD642F))
BAND = kn.mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0xE7037ED1A0B428DB))


def sketches(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """The sketches of n sets, given as (set number, hash of a shingle), sorted; those of empty sets stay EMPTY."""
    out = np.full(n * COORDINATES, EMPTY)
    low = U64((1 << 56) - 1)
    for k in range(COORDINATES):
        x = kn.mix(h ^ ROUNDS[k])
        # the coordinate is taken from the first bits, the value is the round and the other bits
        np.minimum.at(out, doc * COORDINATES + (x >> U64(57)).astype(np.int64), U64(k << 56) | (x & low))
        open_ = (out.reshape(n, COORDINATES) == EMPTY).any(1)[doc]
        doc, h = doc[open_], h[open_]
        if not len(doc):
            break
    for k in range(COORDINATES if len(doc) else 0):
        at = doc * COORDINATES + k
        open_ = out[at] == EMPTY
        if open_.any():
            x = kn.mix(h[open_] ^ ROUNDS[COORDINATES + k])
            np.minimum.at(out, at[open_], U64(COORDINATES + k << 56) | (x & low))
    return out.reshape(n, COORDINATES)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    x = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(BAND, x.shape[:2])
    for k in range(ROWS):
        key = kn.mix(key ^ x[:, :, k])
    return key


def least_agreements(percent: int) -> int:
    """How many coordinates two linked sets agree in at least, but for five and a half standard deviations."""
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - 5.5 * math.sqrt(COORDINATES * p * (1 - p))))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """docs (row, doc_id, content, text) -> (row, doc_id, content, n, sig, sig2, bands array, sketch binary, a byte a
    coordinate); null from sig on for an empty set."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h = sets_of(part.column("text"), size)
                n, sig, sig2 = signatures(doc, h, part.num_rows)
                sketch, none = sketches(doc, h, part.num_rows), n == 0
                short = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), len(n), [None, pa.py_buffer(kn.mix(sketch).astype(np.uint8).tobytes())]).cast(pa.binary())
                edge = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS)
                names = [pa.array(x.view(np.int64), mask=none) for x in (sig, sig2)]
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ("row", "doc_id", "content")), pa.array(n.astype(np.int64)), *names, pa.ListArray.from_arrays(edge, kn.signed(band_keys(sketch).ravel())), short],
                    ["row", "doc_id", "content", "n", "sig", "sig2", "bands", "sketch"],
                )

    return docs.mapInArrow(found, "row long, doc_id long, content long, n long, sig long, sig2 long, bands array<long>, sketch binary")


class Clusters:
    """Which rows belong together so far, and the pairs that joined them."""

    def __init__(self, n: int):
        self.up, self.pairs = list(range(n)), []

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, q: np.ndarray, p: np.ndarray) -> None:
        for a, b in zip(q.tolist(), p.tolist(), strict=True):
            if (x := self.of(a)) != (y := self.of(b)):
                self.up[max(x, y)] = min(x, y)
                self.pairs.append((a, b))


def agreeing(sketch: np.ndarray, n: np.ndarray, half: np.ndarray, begin: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows that span the clusters of each group; groups begin at ``begin``. Where a group has two halves, pairs are
    of both. In a large group the first row asks all; who is in its cluster then need not ask, as the others meet it."""
    least, ends = least_agreements(percent), np.r_[begin[1:], len(n)]
    clusters = Clusters(len(n))

    def alike(q: np.ndarray, p: np.ndarray, across: np.ndarray) -> np.ndarray:
        ok = (100 * np.minimum(n[q], n[p]) >= percent * np.maximum(n[q], n[p])) & ((half[q] != half[p]) | ~across)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 1 << 16):
            s = at[k : k + (1 << 16)]
            ok[s] = (sketch[q[s]] == sketch[p[s]]).sum(1) >= least
        return ok

    size = ends - begin
    across = np.maximum.reduceat(half, begin) > 0
    few = np.flatnonzero((size > 1) & (size <= FEW))
    share = np.cumsum(size[few] ** 2) // 1_000_000
    for k in np.unique(share).tolist():
        b, s, two = begin[few[share == k]], size[few[share == k]], across[few[share == k]]
        row = np.repeat(b, s) + kn.spread(s)
        rest = np.repeat(s, s) - 1 - kn.spread(s)
        q = np.repeat(row, rest)
        p = q + 1 + kn.spread(rest)
        ok = alike(q, p, np.repeat(np.repeat(two, s), rest))
        clusters.join(q[ok], p[ok])
    for lo, hi, two in zip(begin[size > FEW].tolist(), ends[size > FEW].tolist(), across[size > FEW].tolist(), strict=True):
        rows = np.arange(lo, hi)
        for a in range(lo, hi):
            if a > lo and clusters.of(a) == clusters.of(lo):
                continue
            q = np.full(len(rows), a)
            ok = alike(q, rows, np.full(len(rows), two)) & (rows != a)
            clusters.join(q[ok], rows[ok])
    return np.array(clusters.pairs, np.int64).reshape(-1, 2)


def bucket_forests(rows: DataFrame, percent: int) -> DataFrame:
    """rows (group, i, j, half, node, n, sketch), meeting by meeting -> (u, v): nodes whose sketches agree."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, begin in whole_groups(batches):
            half, node, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("half", "node", "n"))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            pairs = node[agreeing(sketch, n, half, begin, percent)]
            pairs = np.unique(np.stack([pairs.max(1), pairs.min(1)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return rows.mapInArrow(found, "u long, v long")


def clusters_of(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes (node, n, bands, sketch) -> (node, component): nodes that links connect are in one component."""
    keys = nodes.select("node", F.explode("bands").alias("group"))
    # keys behind which the same nodes stand give the same pairs: one of them is enough
    behind = keys.groupBy("group").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("one"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("two"))
    several = behind.filter("nodes > 1").groupBy("nodes", "one", "two").agg(F.min("group").alias("group")).select("group")
    shared = cut(keys.join(several, "group", "left_semi").join(nodes.select("node", "n"), "node"))
    meets = meeting(shared, F.lit(1), PIECE, percent, "node").join(nodes.select("node", "sketch"), "node")
    return components(bucket_forests(met(meets), percent))


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Null and empty texts have no shingles, are linked with nothing and kept.
    Equal sets are one node, so copies and repeated rows are compared once;
    rows of one id but different texts are nodes of their own. kept: the row's
    id names its component. Rows of null id are linked, but name no component;
    such rows alone have null and are kept. Very long texts are sets like
    others. No rows: no rows. Further columns are ignored.
    """
    docs = _named(docs)
    rows = cut(sketched(docs.withColumn("row", F.monotonically_increasing_id()), size))
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")
    nodes = cut(rows.filter("sig IS NOT NULL").groupBy("sig", "sig2").agg(F.min("row").alias("node"), F.min(own).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    clusters = clusters_of(nodes, percent)
    links = link_nodes(docs, nodes.select("node", "n", "least.doc_id", "least.content"), clusters, size, percent)
    component = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    found = least_of(rows, nodes, links).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: All pairs that share a shingle; fit for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
