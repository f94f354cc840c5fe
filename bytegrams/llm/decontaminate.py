"""Benchmark decontamination with DataFrame functions only.

The hashes of the benchmark's n-grams are a set that goes to every task as a bit
map of bounded size, a scalar subquery. Documents are read once, and only
windows whose bit is set become rows; these are verified on their words by a join
with the table gram -> items, which is broadcast up to ``max_grams`` distinct
grams and shuffled beyond. The plan and its rows are the same otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.llm.common import ascii_lower, cut, fresh, texts

#: Bits of the map for each gram, and the least and the most bits of a map, as powers of two: 8 MB at most.
BITS_A_GRAM, LEAST_BITS, MOST_BITS = 256, 16, 26
#: Longs of a row of the map, as a power of two.
ROW = 10
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased A-Z, then what stands between ASCII characters that are no letters or digits."""
    return F.filter(F.split(ascii_lower(text), GAP), lambda w: w != "")


def benchmark_grams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(gram array<string>, items array<string>): each window of each item; a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.coalesce("text", F.lit(""))).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    windows = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("gram"))
    return windows.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def set_hashes(hashes: Column) -> Column:
    """What the map has of a gram, given its words' hashes: its hash, its first word's, and the complement of its last word's."""
    return F.array(F.xxhash64(hashes), F.element_at(hashes, 1), F.bitwise_not(F.element_at(hashes, -1)))


def dense(rows: DataFrame, key: Column, place: str, value: str) -> DataFrame:
    """(at, values): of each key the values in the order of their places."""
    lists = rows.groupBy(key.alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).alias("value")))).alias("x"))
    return lists.select("at", F.transform("x", lambda x: x["value"]).alias("values"))


def bit_map(grams: DataFrame, bits: int) -> Column:
    """A scalar subquery, array<array<bigint>>: 2 ** bits bits, in which the leading bits of a hash name the one that it sets."""
    spark = grams.sparkSession
    place = F.shiftrightunsigned("hash", 64 - bits)
    hashes = grams.select(F.explode(set_hashes(word_hashes(F.col("gram")))).alias("hash")).select(place.alias("place"))
    longs = hashes.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bit"))
    every = spark.range(1 << (bits - 6)).join(longs, F.col("id") == F.col("word"), "left").select("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))
    rows = dense(every, F.shiftright("id", ROW), "id", "bit")
    return dense(rows, F.lit(0), "at", "values").select("values").scalar()


def has(held: Column, bits: int, hashed: Column) -> Column:
    """Whether the bit of a hash is set in the map."""
    place = F.shiftrightunsigned(hashed, 64 - bits)
    word = F.shiftright(place, 6)
    long = F.get(F.get(held, F.shiftright(word, ROW).cast("int")), word.bitwiseAND((1 << ROW) - 1).cast("int"))
    return F.getbit(long, place.bitwiseAND(63).cast("int")) == 1


def hit_positions(words: Column, sizes: list[int], held: Column, bits: int) -> Column:
    """Structs (at, size) of the windows whose hash is in the map; at counts from 1.

    A window is hashed only if its first and last word are first and last words of the benchmark's windows.
    """

    def of(size: int, hashes: Column, known: Column) -> Column:
        starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(1), F.size(hashes) - (size - 1))).otherwise(F.array().cast("array<int>"))
        fits = lambda i: has(known, bits, F.get(hashes, i - 1)) & has(known, bits, F.bitwise_not(F.get(hashes, i + (size - 2))))
        windows = F.transform(F.filter(starts, fits), lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.xxhash64(F.slice(hashes, i, size)).alias("hash")))
        return F.transform(F.filter(windows, lambda w: has(known, bits, w["hash"])), lambda w: F.struct(w["at"].alias("at"), w["size"].alias("size")))

    # a list of one struct names hashes and map once, so that neither is computed again and the map isn't written to rows
    once = F.array(F.struct(word_hashes(words).alias("hashes"), held.alias("held")))
    return F.flatten(F.transform(once, lambda x: F.concat(F.array().cast("array<struct<at:int,size:int>>"), *[of(size, x["hashes"], x["held"]) for size in sizes])))


def covered(spans: Column) -> Column:
    """How many positions the spans (sorted by at) cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        end = s["at"] + s["size"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(s["at"], acc["end"]))).cast("long").alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def judged(named: DataFrame, keys: list[str], benchmark: DataFrame, n: int, max_grams: int) -> DataFrame:
    """named (keys, text) -> per row: keys, n_words, items, spans."""
    grams = cut(benchmark_grams(benchmark, n))
    many = grams.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_GRAM * many).bit_length()))
    sizes = sorted(r[0] for r in grams.select(F.size("gram")).distinct().collect())  # n of them at most
    words = named.select(F.monotonically_increasing_id().alias("row"), *keys, words_of(F.col("text")).alias("words"))
    hits = hit_positions(F.col("words"), sizes, F.col("held"), bits)
    found = words.select("*", bit_map(grams, bits).alias("held")).select("row", *keys, "words", hits.alias("hits")).select(
        "row", *keys, F.size("words").cast("long").alias("n_words"),
        F.explode_outer(F.transform("hits", lambda h: F.struct(h["at"].alias("at"), h["size"].alias("size"), F.slice("words", h["at"], h["size"]).alias("gram")))).alias("hit"),
    )
    # rows without a hit have a key of their own that is no gram, so that they don't meet in one task
    asked = found.select("row", *keys, "n_words", F.struct("hit.at", "hit.size").alias("span"), F.coalesce("hit.gram", F.array(F.lit(None).cast("string"), F.col("row").cast("string"))).alias("asked"))
    verified = asked.join(F.broadcast(grams) if many <= max_grams else grams, F.col("asked") == F.col("gram"), "left")
    spans = verified.select("row", *keys, "n_words", "items", F.when(F.col("items").isNotNull(), F.col("span")).alias("span"))
    return spans.groupBy("row", *keys, "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_sort(F.collect_list("span")).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_grams: int = 200_000) -> DataFrame:
    """Per row of docs (doc_id, text): n_words, n_hit, n_items, items, spans array<struct<at,size>>, contaminated.

    at counts words from 1. Null or empty texts have no words and no hits;
    repeated rows are judged each on their own; an empty benchmark hits
    nothing; items without words are ignored; items with equal grams are all
    named. Very long texts are searched whole. Further columns are ignored.
    """
    whole = judged(texts(docs), ["doc_id"], benchmark, n, max_grams)
    n_hit = covered(F.col("spans"))
    return whole.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_grams: int = 200_000) -> DataFrame:
    """The rows of docs, all columns, whose own text isn't contaminated, whatever other rows have their id.

    Null and empty texts are clean, and so is all where the benchmark is
    empty; repeated rows go or stay together. No rows: no rows. Texts are
    told apart by two hashes of 64 bits.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    content, second = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    names = fresh(docs, "hit_content", "hit_second")
    named = docs.select(content.alias(names[0]), second.alias(names[1]), text.alias("text"))
    bad = judged(named, names, benchmark, n, max_grams).filter(F.size("spans") > 0).select(*names).distinct()
    return docs.join(bad, (content == F.col(names[0])) & (second == F.col(names[1])), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS gram
      FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT dw.doc_id, dw.i, g.size, g.item FROM (SELECT doc_id, i, s.size, list_slice(w, i, i + s.size - 1) AS gram FROM dw, (SELECT DISTINCT size FROM g) s WHERE i + s.size - 1 <= len(w)) dw JOIN g ON dw.size = g.size AND dw.gram = g.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
