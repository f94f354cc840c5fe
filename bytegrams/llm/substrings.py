"""Substring deduplication with difference-cover anchors.

Two equal windows of 50 words may begin anywhere in their documents. The cover
D modulo 31 has, for any two places i and j, a shift below 31 with both i + shift
and j + shift in D; so two equal windows share an anchor of 20 words that begins
at a cover position of both. Only 6 of 31 positions are anchors:

1. hash the anchors; keep those that more than one document has,
2. extend: hash, in two lanes, the windows of 50 words around kept anchors only,
3. a window goes where a smaller doc_id has the same one.

What a batch can settle by itself is settled there: of anchors and windows that
several of its documents share, one row goes on under their hash, so a hot
passage makes as many rows as there are batches. The rest of its documents'
rows travel under keys of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import texts

#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
IN_COVER = np.isin(np.arange(PERIOD), COVER)


#: A text's name: 96 bits of its hashes.
NAME = ["content", "content2"]
#: Anchors and windows of so many rows of a batch are settled together.
TOGETHER = 500_000


def groups(keys: list[np.ndarray], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of keys, then owner: that order, whether a row is its group's first, and the group's number."""
    order = np.lexsort((owner, *keys))
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, first, np.cumsum(first) - 1


def gathered(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[list[np.ndarray]]:
    """Arrays of several parts as one, about TOGETHER rows at a time."""
    held, rows = [], 0
    for arrays in found:
        held.append(arrays)
        rows += len(arrays[0])
        if rows >= TOGETHER:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (content, content2, text) -> (hash, content, content2, place): anchors of texts that have a window, copies of a batch once.

    place is the word that an anchor begins at, or -1 minus that where the
    batch has seen the anchor in another text: such rows have a hash of their
    own, but for one of each group.
    """

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                content = part.column("content").to_numpy()
                own = np.zeros(len(content), bool)
                own[np.unique(content, return_index=True)[1]] = True
                w = kn.words(part.column("text"))
                counts = np.where(own & (w.counts >= window), w.counts - anchor + 1, 0)
                at = kn.spread(counts)
                keep = IN_COVER[at % PERIOD]
                doc, at = np.repeat(np.arange(len(counts)), counts)[keep], at[keep]
                begin = w.first[doc] + at
                yield kn.window_hashes(w.hash, begin, begin + anchor), content[doc], part.column("content2").to_numpy()[doc], at.astype(np.int32)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, content, content2, at in gathered(of_parts(batches)):
            order, first, number = groups([h], content)
            h, content, content2, at = h[order], content[order], content2[order], at[order]
            begin = np.flatnonzero(first)
            end = np.r_[begin[1:], len(h)] - 1
            known = (content[begin] != content[end])[number]
            own = kn.mix(h + kn.mix(content.view(np.uint64) + at.astype(np.uint64)))
            yield pa.RecordBatch.from_arrays([kn.signed(np.where(known & ~first, own, h)), pa.array(content), pa.array(content2), pa.array(np.where(known, -1 - at, at))], ["hash", "content", "content2", "place"])

    return docs.select("content", "content2", "text").mapInArrow(found, "hash long, content long, content2 int, place int")


def windows(docs: DataFrame, window: int) -> DataFrame:
    """docs (content, content2, doc_id, text, anchors array<int>) -> (a, b, content, content2, doc_id, place): windows around anchors.

    place is the word that a window begins at. Windows that a smaller doc_id
    of the batch has too are runs: place also has their number above 2 ** 32, and the key is their own.
    """

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                w = kn.words(part.column("text"))
                lists = part.column("anchors")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                # a window around an anchor begins at most PERIOD - 1 words before it
                begin = w.first[doc] + np.maximum(flat - (PERIOD - 1), 0)
                stop = w.first[doc] + np.minimum(flat, w.counts[doc] - window) + 1
                marks = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, stop, -1)
                start = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                of = np.searchsorted(w.first, start, "right") - 1
                yield kn.window_hashes(w.hash, start, start + window), (kn.window_hashes(w.hash, start, start + window, 1) >> np.uint64(32)).astype(np.int32), part.column("content").to_numpy()[of], part.column("content2").to_numpy()[of], part.column("doc_id").to_numpy()[of], (start - w.first[of])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, content, content2, doc_id, at in gathered(of_parts(batches)):
            order, first, number = groups([a, b], doc_id)
            known = np.zeros(len(a), bool)
            known[order] = doc_id[order] > doc_id[order][first][number]
            k = np.flatnonzero(known)  # in the order of documents and places
            new = np.ones(len(k), bool)
            new[1:] = (content[k][1:] != content[k][:-1]) | (np.diff(at[k]) != 1)
            runs = k[new]
            size = np.diff(np.r_[np.flatnonzero(new), len(k)])
            own = kn.mix(content[runs].view(np.uint64) + kn.mix(at[runs].astype(np.uint64) + np.uint64(1 << 40)))
            rows = np.r_[np.flatnonzero(~known), runs]
            free = len(rows) - len(runs)
            yield pa.RecordBatch.from_arrays([
                kn.signed(np.r_[a[rows[:free]], own]), pa.array(b[rows]), pa.array(content[rows]), pa.array(content2[rows]), pa.array(doc_id[rows]), pa.array(at[rows] + (np.r_[np.zeros(free, np.int64), size] << 32)),
            ], ["a", "b", "content", "content2", "doc_id", "place"])

    return docs.select("content", "content2", "doc_id", "text", "anchors").mapInArrow(found, "a long, b int, content long, content2 int, doc_id long, place long")


def removals(docs: DataFrame, firsts: DataFrame, window: int, anchor: int) -> DataFrame:
    """docs (*NAME, doc_id, text), firsts (*NAME, first_id) -> (*NAME, doc_id, runs array<long>): windows that a smaller doc_id has too, in the first document of each content. A run is (number of windows) * 2 ** 32 + place."""
    by_hash = Window.partitionBy("hash")
    seen = anchors(docs, window, anchor).withColumn("least", F.min("content").over(by_hash)).withColumn("most", F.max("content").over(by_hash))
    flagged = seen.filter("place < 0 OR least <> most").groupBy(*NAME).agg(F.collect_list(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))).alias("anchors"))
    # no id is below first_id; "=" would become a key of the join, and the texts would be shuffled by other keys than at the end
    first = docs.join(flagged.join(firsts, NAME), NAME).filter("doc_id <= first_id")
    around = windows(first, window).withColumn("least", F.min("doc_id").over(Window.partitionBy("a", "b")))
    gone = around.filter(f"place >= {1 << 32} OR least < doc_id")
    return gone.groupBy(*NAME, "doc_id").agg(F.collect_list(F.when(F.col("place") >= 1 << 32, F.col("place")).otherwise(F.col("place") + (1 << 32))).alias("runs"))


def dedup_substrings(docs: DataFrame, window: int = 50) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the other words, joined by one blank).

    A word goes if a window of ``window`` words over it also begins in a
    document of smaller doc_id. Null and empty texts have no words. Rows of
    one id don't remove each other's words; a null id is larger than all
    others (a real id of 2 ** 63 - 1 is as large, and stays what it is). No rows: no rows. Further columns are ignored.

    Very long texts are read whole. Texts go by their NAME, so copies share all work up to the
    last step: a copy that isn't the first loses all words if it has a window.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window has {PERIOD} words at least")
    # the last bit of a name tells a null id; as a column of its own it would make the two shuffles of the texts differ
    content = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    rows = texts(docs).select(content.alias("content"), F.hash("text").alias("content2"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "text")
    firsts = rows.groupBy(*NAME).agg(F.min("doc_id").alias("first_id"))
    gone = removals(rows, firsts, window, anchor).select(*NAME, "runs")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kn.parts(batch, "text"):
                w = kn.words(part.column("text"))
                copy = part.column("copy").to_numpy(zero_copy_only=False) & (w.counts >= window)
                lists = part.column("runs")
                sizes = np.diff(lists.offsets.to_numpy())
                runs = lists.flatten().to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                begin = w.first[doc] + (runs & 0xFFFFFFFF)
                marks = np.zeros(len(w.hash) + 1, np.int32)
                np.add.at(marks, begin, 1)
                np.add.at(marks, begin + (runs >> 32) + window - 1, -1)
                np.add.at(marks, w.first[:-1][copy], 1)
                np.add.at(marks, w.first[1:][copy], -1)
                stays = np.cumsum(marks)[:-1] == 0
                total = np.r_[0, np.cumsum(stays)]
                n_kept = total[w.first[1:]] - total[w.first[:-1]]
                buffer = w.buffer.tobytes()
                out = []
                for d in range(len(sizes)):
                    lo, hi = w.first[d], w.first[d + 1]
                    if n_kept[d] == hi - lo and hi > lo:
                        out.append(b" ".join(buffer[w.start[lo] : w.end[hi - 1]].split()))
                    else:
                        k = np.flatnonzero(stays[lo:hi]) + lo
                        out.append(b" ".join([buffer[s:e] for s, e in zip(w.start[k].tolist(), w.end[k].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("none"), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - n_kept).astype(np.int64)), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "none", "n_words", "n_removed", "kept"])

    marked = rows.join(firsts.join(gone, NAME, "left"), NAME)
    marked = marked.select("doc_id", (F.col("content").bitwiseAND(F.lit(1)) == 1).alias("none"), "text", (F.col("doc_id") > F.col("first_id")).alias("copy"), F.coalesce("runs", F.array().cast("array<bigint>")).alias("runs"))
    done = marked.mapInArrow(kept, "doc_id long, none boolean, n_words long, n_removed long, kept string")
    return done.withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id"))).drop("none")


#: Windows as text under their place; the window's text decides, no hash.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM p),
r AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS j FROM m WHERE least < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n, coalesce(len(gone), 0) AS x, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END AS kept FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(x AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
