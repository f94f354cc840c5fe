"""Phrase collocations from suffix subtrees, vertically partitioned.

The suffixes of the word sequences are dealt out by their first words, their
prefix. A prefix of more suffixes than a task's memory budget is extended by
words until it fits; prefixes are packed into groups of about that budget. A
group's suffixes, cut at the longest phrase, are sorted: their distinct ones
are the leaves of the group's subtrees, and a phrase counts what the leaves
below it add up to. No group needs another one.

No phrase is more frequent than its words and pairs of words. So a suffix ends
before a word or pair that is too rare, by bit maps of a fixed size that are
found in two scans before. What a bit map lets through wrongly is counted and
dropped; nothing that is frequent can be lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.functions.bits import bit_map, probed
from bytegrams.llm import kernels as kn
from bytegrams.llm.common import cut
from bytegrams.llm.jaccard import whole_groups

#: Bytes between pieces, and those and the ones between words.
BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
APART = BREAKS.copy()
APART[[9, 32]] = True
#: Words of the longest phrase.
DEPTH = 5
#: Suffixes of a group.
BUDGET = 500_000
#: Pairs of words are counted in so many numbers, as a power of two.
PAIR_BITS = 26
#: Words, and suffixes, that a task counts together before they become rows.
TOGETHER, SUFFIXES = 2_000_000, 1_000_000
U64 = np.uint64


def lang_number(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((lang or "und").encode(), digest_size=8).digest(), "little")


def word_ids(part: pa.RecordBatch) -> tuple[kn.Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, a number for each word and lang, document of each word, whether the next word follows in the same piece)."""
    w = kn.words(part.column("text"), lower=True, between=APART)
    doc = np.repeat(np.arange(part.num_rows), w.counts)
    langs = np.array([lang_number(x) for x in part.column("lang").to_pylist()], U64)
    ids = np.maximum(kn.mix(w.hash ^ langs[doc]), U64(1))  # 0 is no word
    piece = np.cumsum(BREAKS[w.buffer])[w.start] if len(w.start) else doc
    follows = np.zeros(len(ids), bool)
    follows[:-1] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    return w, ids, doc, follows


def pair_numbers(ids: np.ndarray) -> np.ndarray:
    """A hash of each word and the next one; the last has no meaning."""
    return kn.mix(ids * U64(0x9E3779B97F4A7C15) + np.r_[ids[1:], ids[:1]])


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, text) -> rows (id, cnt) of words, summed within parts, and rows (lang, cnt) of how many words a lang has."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total: dict[str, int] = {}

        def summed() -> pa.RecordBatch:
            ids, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([kn.signed(ids), pa.nulls(len(ids), pa.string()), pa.array(count.astype(np.int64))], ["id", "lang", "cnt"])

        for batch in batches:
            for part in kn.parts(batch, "text"):
                w, ids, _, _ = word_ids(part)
                for lang, n in zip(part.column("lang").to_pylist(), w.counts.tolist(), strict=True):
                    total[lang] = total.get(lang, 0) + n
                held.append(ids)
                if sum(map(len, held)) > TOGETHER:
                    yield summed()
        if held:
            yield summed()
        yield pa.RecordBatch.from_arrays([pa.nulls(len(total), pa.int64()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["id", "lang", "cnt"])

    return docs.mapInArrow(found, "id long, lang string, cnt long").groupBy("id", "lang").agg(F.sum("cnt").alias("cnt"))


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(bucket, cnt): how many pairs of frequent words in a piece have a hash that begins with these bits; no pair has more."""
    words = docs.sparkSession.sparkContext.broadcast(frequent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            bucket, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int32))], ["bucket", "cnt"])

        for batch in batches:
            for part in kn.parts(batch, "text"):
                _, ids, _, follows = word_ids(part)
                ok = probed(words.value, ids)
                ok[:-1] &= ok[1:] & follows[:-1]
                held.append((pair_numbers(ids)[ok & follows] >> U64(64 - PAIR_BITS)).astype(np.int32))
                if sum(map(len, held)) > TOGETHER:
                    yield summed()
        if held:
            yield summed()

    return docs.mapInArrow(found, "bucket int, cnt int").groupBy("bucket").agg(F.sum("cnt").alias("cnt"))


def suffix_rows(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, heavy: tuple[np.ndarray, np.ndarray], groups: int) -> DataFrame:
    """(group, whole, words, sizes, counts): suffixes of two words or more, summed within parts. A row has all of a group that
    a task has summed together: their words one after another, eight bytes each, and their sizes and counts.

    heavy: words and pair buckets of more suffixes than a group may have. A
    heavy word's suffixes go by their first two words, those of a heavy pair
    by all of their words; then a group doesn't have the whole of a prefix,
    and whole is false.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, pairs, *heavy))

    def inside(x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, size = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        words, _, count = leaves(words, size, np.ones(len(size), np.int64))
        size = (words != 0).sum(1)
        _, _, heavy_words, heavy_pairs = shared.value
        pair = kn.mix(words[:, 0] * U64(0x9E3779B97F4A7C15) + words[:, 1])
        one, two = inside(words[:, 0], heavy_words), inside((pair >> U64(64 - PAIR_BITS)).astype(np.int64), heavy_pairs)
        every = pair
        for k in range(2, DEPTH):
            every = kn.mix(every ^ words[:, k])
        group = kn.mix(np.where(~one, words[:, 0], np.where(two, every, pair))) % U64(groups)
        order = np.lexsort((one & two, group))
        group, part, words, size, count = group[order], (one & two)[order], words[order], size[order], count[order].astype(np.int32)
        begin = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (part[1:] != part[:-1])])
        raw = [[x[a:b] for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(size)], strict=True)] for x in (words, size.astype(np.uint8), count)]
        packed = [pa.array([x[x != 0].tobytes() for x in each], pa.binary()) for each in raw]
        return pa.RecordBatch.from_arrays([pa.array(group[begin].astype(np.int32)), pa.array(~part[begin]), *packed], ["group", "whole", "words", "sizes", "counts"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        frequent, pairs, _, _ = shared.value
        for batch in batches:
            for part in kn.parts(batch, "text"):
                _, ids, _, follows = word_ids(part)
                if not len(ids):
                    continue
                ok = probed(frequent, ids)
                ok[:-1] &= ok[1:] & follows[:-1] & probed(pairs, pair_numbers(ids))[:-1]
                ok[-1] = False  # whether the suffix goes on after this word
                begin = np.flatnonzero(ok)
                words = np.zeros((len(begin), DEPTH), U64)
                on, size = np.ones(len(begin), bool), np.zeros(len(begin), np.int64)
                for k in range(DEPTH):
                    at = np.minimum(begin + k, len(ids) - 1)
                    words[on, k] = ids[at[on]]
                    size += on
                    on &= ok[at]
                held.append((words, size))
                if sum(len(x[1]) for x in held) > SUFFIXES:
                    yield summed(held)
        if sum(len(x[1]) for x in held):
            yield summed(held)

    return docs.mapInArrow(found, "group int, whole boolean, words binary, sizes binary, counts binary")


def leaves(words: np.ndarray, size: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct suffixes in order (0 stands after their last word), their sizes and total counts."""
    if not len(size):
        return words, size, count
    order = np.lexsort(words.T[::-1])
    words, size, count = words[order], size[order], count[order]
    begin = np.flatnonzero(np.r_[True, (words[1:] != words[:-1]).any(1)])
    return words[begin], size[begin], np.add.reduceat(count, begin)


def subtree_counts(rows: DataFrame, least: int) -> DataFrame:
    """suffix_rows, group by group -> (suffix, ids array, cnt) of the phrases of two words or more that are frequent, or that
    may be so together with other groups."""

    def nodes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, size, cnt = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("words", U64), ("sizes", np.uint8), ("counts", np.int32)))
        size, cnt = size.astype(np.int64), cnt.astype(np.int64)
        whole = np.repeat(batch.column("whole").to_numpy(zero_copy_only=False), [len(x) for x in batch.column("sizes").to_pylist()])
        words = np.zeros((len(size), DEPTH), U64)
        words[np.repeat(np.arange(len(size)), size), kn.spread(size)] = raw
        for kind in (True, False):
            tree, depth, total = leaves(words[whole == kind], size[whole == kind], cnt[whole == kind])
            for k in range(2, DEPTH + 1):
                tree, total, depth = tree[depth >= k], total[depth >= k], depth[depth >= k]
                if not len(total):
                    break
                begin = np.flatnonzero(np.r_[True, (tree[1:, :k] != tree[:-1, :k]).any(1)])
                below = np.add.reduceat(total, begin)
                keep = below >= least if kind else np.ones(len(below), bool)
                found = np.ascontiguousarray(tree[begin[keep], :k])
                suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * k), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * k), kn.signed(found.ravel()))
                yield pa.RecordBatch.from_arrays([suffix, ids, pa.array(below[keep])], ["suffix", "ids", "cnt"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in whole_groups(batches, ["group"]):
            for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), rows.num_rows], strict=True):
                yield from nodes(rows.slice(lo, hi - lo))

    dealt = rows.repartition("group").sortWithinPartitions("group")
    counted = dealt.mapInArrow(found, "suffix binary, ids array<long>, cnt long").groupBy("suffix").agg(F.first("ids").alias("ids"), F.sum("cnt").alias("cnt"))
    return counted.filter(F.col("cnt") >= least)


def spelled(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(id, lang, word) of the words in the bit map, once a task where it has them."""
    words = docs.sparkSession.sparkContext.broadcast(frequent)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, U64)
        for batch in batches:
            for part in kn.parts(batch, "text"):
                w, ids, doc, _ = word_ids(part)
                ids, at = np.unique(ids, return_index=True)
                new = probed(words.value, ids) & ~np.isin(ids, seen, assume_unique=True)
                ids, at = ids[new], at[new]
                seen = np.union1d(seen, ids)
                lang = [part.column("lang")[d].as_py() for d in doc[at].tolist()]
                text = [w.buffer[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([kn.signed(ids), pa.array(lang, pa.string()), pa.array(text, pa.string())], ["id", "lang", "word"])

    return docs.mapInArrow(found, "id long, lang string, word string")


def count_phrases(docs: DataFrame, least: int = 100, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """docs (lang, text) -> ((lang, words array, cnt) of all phrases of two to five words with that count at least and of
    the words in them, and (lang, n) with the number of all words)."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    counted = word_counts(docs).filter(F.col("id").isNull() | (F.col("cnt") >= least))
    counted = cut(counted)
    single = counted.filter("id IS NOT NULL").select("id", "cnt")
    frequent = bit_map(single, "id")
    buckets = cut(pair_counts(docs, frequent).filter(F.col("cnt") >= least))
    pairs = bit_map(buckets.select(F.shiftleft(F.col("bucket").cast("long"), 64 - PAIR_BITS).alias("hash")), "hash", PAIR_BITS)
    total = buckets.agg(F.sum("cnt")).first()[0] or 0
    # no more than total / budget of them
    heavy_words = np.sort(single.filter(F.col("cnt") > budget).select("id").toArrow().column(0).to_numpy().view(U64))
    heavy_pairs = np.sort(buckets.filter(F.col("cnt") > budget).select("bucket").toArrow().column(0).to_numpy().astype(np.int64))
    found = cut(subtree_counts(suffix_rows(docs, frequent, pairs, (heavy_words, heavy_pairs), -(-total // budget) + 1), least))
    needed = found.select(F.explode("ids").alias("id")).distinct()
    names = cut(spelled(docs, bit_map(needed, "id")).groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word")).join(needed, "id", "left_semi").join(single, "id"))
    each = found.select("suffix", F.col("cnt").alias("times"), F.posexplode("ids").alias("place", "id")).join(names.drop("cnt"), "id")
    several = each.groupBy("suffix").agg(F.first("lang").alias("lang"), F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("words"), F.first("times").alias("cnt"))
    every = names.select("lang", F.array("word").alias("words"), "cnt").unionByName(several.select("lang", "words", "cnt"))
    return cut(every), counted.filter("id IS NULL").select("lang", F.col("cnt").alias("n"))


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, budget: int = BUDGET) -> DataFrame:
    """Per lang the phrases of two to five words that are far more frequent than their parts suggest: lang, rank, phrase, a, l,
    r, n, score.

    docs: lang, text. A-Z count as a-z; sentence signs and line ends part
    pieces, spaces and tabs words. A candidate occurs ``least`` times or more.
    Its weakest cut decides: score = floor(1000 * a * n / (l * r)). A
    candidate inside a longer one that is as frequent goes. The first ``most``
    of each lang come back, by score, count and phrase.

    Null texts are empty, a null lang is "und". Very long texts and words
    count as others do, as do repeated rows. No rows, or none frequent: no
    rows. Further columns are ignored. Words are told apart by 64-bit hashes.
    """
    every, sizes = count_phrases(docs, least, budget)
    text = lambda words: F.array_join(words, " ")
    known = every.select("lang", text(F.col("words")).alias("part"), F.col("cnt").alias("times"))
    candidates = every.filter(F.size("words") > 1).withColumn("phrase", text(F.col("words")))
    size = F.size("words")
    inner = candidates.filter(size > 2).select("lang", "cnt", F.explode(F.array(text(F.slice("words", F.lit(1), size - 1)), text(F.slice("words", F.lit(2), size - 1)))).alias("phrase"))
    # a longer candidate is as frequent as all phrases between the two, so the next longer ones tell
    kept = candidates.join(inner, ["lang", "phrase", "cnt"], "left_anti")
    cuts = kept.select("lang", "phrase", F.col("cnt").alias("a"), "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", text(F.slice("words", F.lit(1), F.col("k"))).alias("first"), text(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"))
    part = lambda name, count: known.select("lang", F.col("part").alias(name), F.col("times").alias(count))
    both = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(F.broadcast(sizes), "lang")
    exact = "CAST((CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(16,0)) * 1000) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0))) AS BIGINT)"
    best = both.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
c AS (SELECT lang, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS size) WHERE len(w) >= size) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE size = 1 GROUP BY lang),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE f >= 100),
i AS (SELECT DISTINCT lang, f, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:size], ' ')]) AS phrase FROM f WHERE size > 2),
k AS (SELECT * FROM f WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM i WHERE i.lang = f.lang AND i.phrase = f.phrase AND i.f >= f.f)),
s AS (SELECT k.lang, k.phrase, k.f AS a, x.f AS l, y.f AS r, n, u AS cut, CAST(1000::HUGEINT * k.f * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, size)) AS u FROM k) k
 JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:u], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[u + 1:k.size], ' ') JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""
