"""Ranked lexical search with hashed max-sketches.

A document's sketch has 2 ** 16 coordinates. Each of its terms has an impact,
what it would add to a score; a coordinate holds the largest impact of the
terms that hash to it, rounded up to one of LEVELS. Only coordinates above 0
are stored. The sum of the coordinates of a query's terms is no less than the
document's score. The index is made of all documents once and knows no query.

Queries are looked up in blocks, all of a block at once over a task's
sketches. The documents of largest bound are scored exactly on their texts;
the k-th best score so far is a query's threshold. Then all documents whose
bound reaches it are scored, from the largest bounds down, in slices between
which thresholds rise, until none is left. Nothing else is left out.

Copies of a text are one content with its k smallest ids: more of them can't
be among the first k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import bounded_rows, cut, remove, stored

#: Bytes that no term has.
APART = np.zeros(256, bool)
APART[:128] = ~np.array([chr(b).isalnum() for b in range(128)])
#: A sketch has 2 ** BITS coordinates, 16 at most.
BITS, LEVELS = 16, 4095
#: Terms whose weights the sketching tasks know; rarer ones get the largest weight there, which keeps bounds true.
MOST_TERMS = 500_000
#: Queries, and query terms times documents, that a task looks up together.
BLOCK, CELLS = 512, 4_000_000
#: Contents that may be broadcast to be scored.
MOST_IDS = 200_000
#: Slices of bounds between which thresholds rise.
SLICES = 3
#: Terms whose documents a task counts together before they become rows.
TOGETHER = 2_000_000
U64 = np.uint64


def weight(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def frequency_part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_part(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 90 + 90 * n / the mean number of terms, rounded down."""
    return 10 + (90 * n * documents) // max(terms, 1)


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), each term of a document once, sorted; and how many terms each document has."""
    w = kn.words(column, lower=True, between=APART)
    doc = np.repeat(np.arange(len(column)), w.counts)
    order = np.lexsort((w.hash, doc))
    doc, h = doc[order], w.hash[order]
    begin = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return doc[begin], h[begin], np.diff(np.r_[begin, len(h)]), w.counts


def document_frequencies(docs: DataFrame) -> DataFrame:
    """docs (text) -> (term, df, length): documents of each term; the row of a null term has how many documents have any, and
    the number of all terms."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        some = length = 0

        def summed() -> pa.RecordBatch:
            h, df = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([kn.signed(h), pa.array(df.astype(np.int64)), pa.nulls(len(h), pa.int64())], ["term", "df", "length"])

        for batch in batches:
            for part in kn.parts(batch, "text"):
                _, h, _, n = terms_of(part.column("text"))
                held.append(h)
                some, length = some + int((n > 0).sum()), length + int(n.sum())
                if sum(map(len, held)) > TOGETHER:
                    yield summed()
        if held:
            yield summed()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([some]), pa.array([length])], ["term", "df", "length"])

    return docs.select("text").mapInArrow(found, "term long, df long, length long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("length").alias("length"))


class Statistics:
    """What scores need of the corpus: the numbers of documents and terms, and the weights of its most frequent terms. bits:
    a sketch has 2 ** bits coordinates."""

    def __init__(self, counted: DataFrame, bits: int):
        self.bits = bits
        whole = counted.filter("term IS NULL").first()
        self.documents, self.terms = (int(whole["df"]), int(whole["length"])) if whole else (0, 0)
        common = counted.filter("term IS NOT NULL").orderBy(F.desc("df"), "term").limit(MOST_TERMS).select("term", "df").toArrow()
        term, df = common.column("term").to_numpy().view(U64), common.column("df").to_numpy()
        order = np.argsort(term)
        self.known, self.weights = term[order], weight(df[order], self.documents)
        self.most = int(weight(np.ones(1), self.documents)[0])
        #: An impact of a level; no impact is above the last one.
        self.unit = max(1, -(-self.most * 1_000_000 // LEVELS))

    def weight_bound(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(h), self.most)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, self.weights[at], self.most)


def content_of(text: Column) -> list[Column]:
    """Two hashes that name a text."""
    return [F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")]


def sketch_index(docs: DataFrame, statistics: Statistics) -> DataFrame:
    """docs (one, two, text) -> (one, two, coordinates binary, levels binary): 16-bit numbers, ascending coordinates."""
    shared = docs.sparkSession.sparkContext.broadcast(statistics)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h, tf, n = terms_of(part.column("text"))
                impact = s.weight_bound(h) * frequency_part(tf, length_part(n, s.documents, s.terms)[doc])
                level = -(-impact // s.unit)
                place = doc << s.bits | (h >> U64(64 - s.bits)).astype(np.int64)  # ascending, as hashes are
                begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
                largest = np.maximum.reduceat(level, begin) if len(begin) else level
                begin, largest = begin[largest > 0], largest[largest > 0]
                edge = np.searchsorted(doc[begin], np.arange(part.num_rows + 1)).astype(np.int32) * 2
                binary = lambda x, edge=edge: pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.tobytes()), pa.py_buffer(x.astype(np.uint16).tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("one"), part.column("two"), binary(place[begin] & (1 << s.bits) - 1), binary(largest)], ["one", "two", "coordinates", "levels"])

    return docs.select("one", "two", "text").mapInArrow(found, "one long, two long, coordinates binary, levels binary")


class Block:
    """The queries of a block: their numbers, and the hash, weight and largest level of each term, query by query."""

    def __init__(self, rows: pa.Table, statistics: Statistics):
        q, h, df = (rows.column(c).to_numpy() for c in ("q", "term", "df"))
        order = np.lexsort((h, q))
        self.term, self.weight = h[order].view(U64), weight(df[order], statistics.documents)
        self.q, self.begin = np.unique(q[order], return_index=True)
        self.end = np.r_[self.begin[1:], len(q)]
        self.statistics = statistics
        # each distinct term is a row of what is looked up
        own, row = np.unique(self.term, return_inverse=True)
        first = np.zeros(len(own), np.int64)
        first[row] = self.weight
        self.rows_of = [row[a:b] for a, b in zip(self.begin.tolist(), self.end.tolist(), strict=True)]
        self.cap = -(-first * 1_000_000 // statistics.unit)
        self.count = np.bincount((own >> U64(64 - statistics.bits)).astype(np.int64), minlength=1 << statistics.bits)
        self.first = np.cumsum(self.count) - self.count  # terms are in the order of their coordinates

    def bounds(self, coordinates: pa.Array, levels: pa.Array) -> np.ndarray:
        """Of each query (row) and sketch (column), in levels."""
        edge = np.frombuffer(coordinates.buffers()[1], np.int32)[coordinates.offset : coordinates.offset + len(coordinates) + 1]
        place, level = (np.frombuffer(x.buffers()[2] or b"", np.uint16)[edge[0] // 2 : edge[-1] // 2].astype(np.int64) for x in (coordinates, levels))
        doc = np.repeat(np.arange(len(coordinates)), np.diff(edge) // 2)
        ask = self.count[place] > 0
        place, level, doc = place[ask], level[ask], doc[ask]
        times = self.count[place]
        term = np.repeat(self.first[place], times) + kn.spread(times)
        table = np.zeros((len(self.cap), len(coordinates)), np.int32)
        table[term, np.repeat(doc, times)] = np.minimum(np.repeat(level, times), self.cap[term])
        return np.stack([table[rows].sum(0, dtype=np.int64) for rows in self.rows_of])

    def score(self, asked: list[int], h: np.ndarray, tf: np.ndarray, m: int) -> np.ndarray:
        """Exact scores of a document with these terms for the queries asked for."""
        at = np.searchsorted(self.q, asked)
        size = self.end[at] - self.begin[at]
        own = np.repeat(self.begin[at], size) + kn.spread(size)
        if not len(h):
            return np.zeros(len(at), np.int64)
        found = np.minimum(np.searchsorted(h, self.term[own]), len(h) - 1)
        each = np.where(h[found] == self.term[own], self.weight[own] * frequency_part(tf[found], np.int64(m)), 0)
        return np.add.reduceat(each, np.cumsum(size) - size)


def bounded(index: DataFrame, block: Block, k: int, thresholds: np.ndarray | None = None) -> DataFrame:
    """(q, one, two, bound): for each query of the block the k contents of largest bound in a task at least; or, with
    thresholds, all whose bound reaches the query's. Copies in a batch are one row."""
    shared = index.sparkSession.sparkContext.broadcast((block, thresholds))
    names = ["q", "one", "two", "bound"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        unit, step = block.statistics.unit, max(1, CELLS // max(1, len(block.cap)))
        held: list[tuple[np.ndarray, ...]] = []
        floor = np.zeros(len(block.q), np.int64)  # in levels

        def gathered(best: bool) -> tuple[np.ndarray, ...]:
            q, one, two, bound = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((two, one, -bound, q))
            q, one, two, bound = q[order], one[order], two[order], bound[order]
            new = np.r_[True, (q[1:] != q[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
            q, one, two, bound = q[new], one[new], two[new], bound[new]
            if best:
                keep = kn.spread(np.bincount(q, minlength=len(floor))) < k
                q, one, two, bound = q[keep], one[keep], two[keep], bound[keep]
                full = np.bincount(q, minlength=len(floor)) >= k
                lowest = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(lowest, q, bound)
                floor[full] = lowest[full]
            return q, one, two, bound

        def rows(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            q, one, two, bound = x
            return pa.RecordBatch.from_arrays([pa.array(block.q[q]), pa.array(one), pa.array(two), pa.array(bound * unit)], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                bound = block.bounds(part.column("coordinates"), part.column("levels"))
                enough = bound > floor[:, None] if least is None else (bound * unit >= least[:, None]) & (bound > 0)
                q, at = np.nonzero(enough)
                held.append((q, *(part.column(c).to_numpy()[at] for c in ("one", "two")), bound[q, at]))
                if sum(len(x[0]) for x in held) > 200_000:
                    if least is None:
                        held.append(gathered(True))
                    else:
                        yield rows(gathered(False))
        if held:
            yield rows(gathered(least is None))

    every = index.mapInArrow(found, "q long, one long, two long, bound long")
    return every.groupBy("q", "one", "two").agg(F.max("bound").alias("bound"))


def scored(docs: DataFrame, copies: DataFrame, pairs: DataFrame, block: Block) -> DataFrame:
    """pairs (q, one, two) -> (q, one, two, score): exact scores on the texts, a copy's for all."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    wanted = pairs.groupBy("one", "two").agg(F.collect_set("q").alias("asked")).join(copies.filter("place = 1"), ["one", "two"])
    wanted = cut(wanted.select(F.col("doc_id").alias("id"), F.col("one").alias("own"), F.col("two").alias("other"), "asked"))
    small = F.broadcast(wanted) if bounded_rows(wanted, MOST_IDS) else wanted
    rows = docs.join(small, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("one") == F.col("own")) & (F.col("two") == F.col("other")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        s = block.statistics
        for batch in batches:
            for part in kn.parts(batch, "text"):
                doc, h, tf, n = terms_of(part.column("text"))
                m = length_part(n, s.documents, s.terms).tolist()
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
                asked = part.column("asked").to_pylist()
                each = [block.score(a, h[lo:hi], tf[lo:hi], x) for a, lo, hi, x in zip(asked, edge[:-1], edge[1:], m, strict=True)]
                times = np.array([len(a) for a in asked])
                names = [pa.array(np.repeat(part.column(c).to_numpy(), times)) for c in ("one", "two")]
                yield pa.RecordBatch.from_arrays([pa.array([q for a in asked for q in a], pa.int64()), *names, pa.array(np.concatenate(each))], ["q", "one", "two", "score"])

    return rows.select("one", "two", "asked", "text").mapInArrow(found, "q long, one long, two long, score long").groupBy("q", "one", "two").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """(q, doc_id, score, rank): the k best of each query; equal scores by id, null ids last."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    every = scores.filter("score > 0").join(copies, ["one", "two"]).select("q", "doc_id", "score")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, copies: DataFrame, index: DataFrame, block: Block, k: int) -> DataFrame:
    """(q, doc_id, score, rank) of the block's queries."""

    def thresholds(scores: DataFrame) -> np.ndarray:
        """The k-th best score of each query so far, 1 where there are fewer."""
        last = ranked(scores, copies, k).filter(F.col("rank") == k).select("q", "score").toArrow()
        out = np.ones(len(block.q), np.int64)
        out[np.searchsorted(block.q, last.column("q").to_numpy())] = last.column("score").to_numpy()
        return out

    best = Window.partitionBy("q").orderBy(F.desc("bound"), "one", "two")
    first = bounded(index, block, k).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    scores = cut(scored(docs, copies, first.select("q", "one", "two"), block))
    least = thresholds(scores)
    rest = cut(bounded(index, block, k, least).join(scores.select("q", "one", "two"), ["q", "one", "two"], "left_anti"))
    largest = rest.groupBy("q").agg(F.max("bound").alias("largest"))
    spark = docs.sparkSession
    for slice_ in range(SLICES):
        # no more rows than queries in a block
        now = spark.createDataFrame(list(zip(block.q.tolist(), least.tolist(), strict=True)), "q long, least long")
        share = (SLICES - 1 - slice_) / SLICES
        reach = rest.join(F.broadcast(largest), "q").join(F.broadcast(now), "q").filter("bound >= least")
        upper = reach.filter(F.col("bound") >= F.col("least") + (F.col("largest") - F.col("least")) * share).select("q", "one", "two")
        upper = upper.join(scores.select("q", "one", "two"), ["q", "one", "two"], "left_anti") if slice_ else upper
        if upper.isEmpty():
            continue
        scores = cut(scores.unionByName(scored(docs, copies, upper, block)))
        least = thresholds(scores)
    return ranked(scores, copies, k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, bits: int = BITS) -> DataFrame:
    """The k documents of highest score for each item: item_id, rank from 1, doc_id, score.

    docs: doc_id, text; items: item_id, text, the queries. Scores are above 0;
    equal ones go by ascending doc_id, null ids last. A row of items is a
    query of its own, and a row of docs a document of its own, also where
    rows repeat or share an id: then each of them has a rank. Null and empty
    texts have no terms: such documents are found by nothing and don't count,
    such items find nothing. Very long texts are scored whole; sketches grow
    with them up to 2 ** bits coordinates. No rows on either side: no rows.
    Further columns are ignored. Terms are told apart by 64-bit hashes, texts
    by 128 bits.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *content_of(text), text.alias("text"))
    counted = cut(document_frequencies(docs))
    statistics = Statistics(counted, bits)
    by_id = Window.partitionBy("one", "two").orderBy(F.col("doc_id").asc_nulls_last())
    copies = cut(docs.select("doc_id", "one", "two").withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k))
    queries = cut(items.select(F.monotonically_increasing_id().alias("q"), "item_id", F.coalesce("text", F.lit("")).alias("text")))
    asked = cut(query_terms(queries).join(counted.select("term", "df"), "term"))
    blocks = math.ceil(asked.select("q").distinct().count() / BLOCK)
    index = stored(sketch_index(docs, statistics), "sketches")
    found = spark.createDataFrame([], "q long, doc_id long, score long, rank int")
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "term", "df").toArrow()
        if rows.num_rows:
            found = found.unionByName(cut(search_block(docs, copies, index, Block(rows, statistics), k)))
    remove(index)
    return found.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (q, text) -> (q, term), each once."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, h, _, _ = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("q").take(pa.array(doc)), kn.signed(h)], ["q", "term"])

    return queries.select("q", "text").mapInArrow(found, "q long, term long")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH t AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM (SELECT doc_id, {_TERMS} AS w FROM documents)),
c AS (SELECT doc_id, n, t, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT t, count(*) AS df FROM c GROUP BY t),
g AS (SELECT count(DISTINCT doc_id) AS nn, count(*) AS ll FROM t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
w AS (SELECT item_id, t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (t), g),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * nn) // ll))))) AS BIGINT) AS score FROM w JOIN c USING (t), g GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""
