"""Document fingerprints by Order MinHash, with DataFrame functions only.

A text is a sequence of pieces (up to eight signs without white space), its
k-mers are numbered by occurrence, and each numbered k-mer has one hash. The
hash deals it into one of 2 * ``sketches`` bins, and the minimal one of each
bin is selected. Two bins make a sketch: its selected k-mers are put back in
text order, and the tuple is hashed. Moving text changes tuples though the set
of k-mers stays, so the share of equal sketches follows edit distance.

All of it happens inside one row, on sorted arrays of 64-bit numbers: no
k-mer becomes a row, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.llm.common import cut, fresh, texts

PIECE = r"[^\x20\x09-\x0D]{1,8}"
#: Low bits of a packed number hold the position, the others the hash. Texts of LONG pieces or more need more for it.
PLACE, PLACE_OF_LONG = 24, 31
LONG = 1 << PLACE
NONE = "----"


def packed(hashes: Column, bits: int) -> Column:
    """Hash above, position below, as numbers that sort by hash, then position."""
    return F.transform(hashes, lambda h, i: F.shiftleft(h, bits).bitwiseAND(F.lit((1 << 63) - (1 << bits))).bitwiseOR(i.cast("long")))


def place_of(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1))


def hash_of(x: Column, bits: int) -> Column:
    return F.shiftright(x, bits)


def numbered(x: Column, occurrence: Column, bits: int) -> Column:
    """A packed k-mer with the hash of (k-mer, occurrence) in the place of its own."""
    return F.xxhash64(hash_of(x, bits), occurrence.cast("int")).bitwiseAND(F.lit((1 << 63) - (1 << bits))).bitwiseOR(place_of(x, bits))


def starts_where(values: Column, key) -> Column:
    """Indexes at which key(value) differs from the one before."""
    return F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (key(x) != key(F.get(values, i - 1))), i).otherwise(-1)), lambda i: i >= 0)


def fingerprints(df: DataFrame, text: str, out: str, k: int = 2, sketches: int = 64) -> DataFrame:
    """df with column ``out``, an array of ``sketches`` strings of 4 hexadecimal digits, ---- for one without k-mers.

    A text of fewer than k pieces is one k-mer; an empty one has none. Very
    long texts are fingerprinted whole: from LONG pieces on positions take 31
    bits, more than a text can have pieces, and 32 name a k-mer in place of 39.
    """
    bins = 2 * sketches
    bits = bins.bit_length() - 1
    if bins != 1 << bits:
        raise ValueError("sketches must be a power of two")
    keep = df.columns
    w, long_, s, r, b, i_, m, at = fresh(df, "pieces", "long", "kmers", "runs", "numbered", "starts", "least", "at")
    either = lambda f: F.when(F.col(long_), f(PLACE_OF_LONG)).otherwise(f(PLACE))
    # each step is a projection of its own: what a later one uses more than once is computed once
    df = df.withColumn(w, F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))
    n = F.size(w)
    kmers = F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, (n >= LONG).alias(long_), kmers.alias(s))
    df = df.select(*keep, long_, F.sort_array(either(lambda p: packed(F.col(s), p))).alias(s))
    df = df.withColumn(r, either(lambda p: starts_where(F.col(s), lambda x: hash_of(x, p))))  # the place in a run is the occurrence number
    stop = lambda i: F.coalesce(F.get(r, i + 1), F.size(s))
    runs = lambda p: F.flatten(F.transform(r, lambda x, i: F.transform(F.slice(s, x + 1, stop(i) - x), lambda y, j: numbered(y, j, p))))
    once = lambda p: F.transform(s, lambda x: numbered(x, F.lit(0), p))
    df = df.select(*keep, long_, F.sort_array(F.when(F.size(r) == F.size(s), either(once)).otherwise(either(runs))).alias(b))
    bin_of = lambda x: F.shiftright(x, 63 - bits).cast("int")
    df = df.withColumn(i_, starts_where(F.col(b), bin_of)).select(*keep, long_, F.transform(i_, lambda i: F.get(b, i)).alias(m))
    full = F.size(m) == bins
    df = df.withColumn(at, F.when(~full, F.map_from_arrays(F.transform(m, bin_of), F.col(m))))

    def sketch(j: Column, p: int) -> Column:
        x, y = (F.when(full, F.get(m, 2 * j + i)).otherwise(F.element_at(at, 2 * j + i)) for i in (0, 1))
        return _tuple(x, y, p)

    return df.select(*keep, either(lambda p: F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda j: sketch(j, p))).alias(out))


def _tuple(a: Column, b: Column, bits: int) -> Column:
    """The hash of two selected k-mers in text order."""
    one, two = hash_of(a, bits), hash_of(b, bits)
    pair = F.when(place_of(a, bits) <= place_of(b, bits), F.xxhash64(one, two)).when(place_of(a, bits) > place_of(b, bits), F.xxhash64(two, one)).otherwise(F.xxhash64(hash_of(F.coalesce(a, b), bits)))
    return F.when(a.isNull() & b.isNull(), NONE).otherwise(F.lower(F.right(F.lpad(F.hex(pair), 16, "0"), F.lit(4))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among those that either text has; two texts without any are alike."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == NONE) & (y == NONE), -1).when(x == y, 1).otherwise(0))
    some, same = F.size(F.filter(both, lambda z: z >= 0)), F.size(F.filter(both, lambda z: z == 1))
    return F.when(some == 0, F.lit(1.0)).otherwise(same / some)


def next_keys(keys: DataFrame) -> DataFrame:
    """Distinct keys (o, content) with next: the next key by descending (o, content), the first for the last.

    The keys are dealt into ranges; only the first key of each range meets
    those of the others, which are as many as there are ranges.
    """
    order = (F.desc("o"), F.desc("content"))
    ranged = cut(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = F.struct("o", "content")
    by_part = Window.orderBy("part")
    heads = ranged.groupBy("part").agg(F.max(own).alias("head"))
    follows = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part)).alias("head"))  # a row a range
    ahead = ranged.withColumn("next", F.lead(own).over(Window.partitionBy("part").orderBy(*order)))
    return ahead.join(F.broadcast(follows), "part").withColumn("next", F.coalesce("next", "head")).drop("part", "head")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id, text, ...) with next_id, next_text, the first half (rounded down) as many code points of the next text
    as this text has, and next_COLUMN for the carried columns.

    The next row is that of the next (doc_id, text) by descending doc_id, then
    descending hash of the text; null ids come last. So repeated rows have the
    same next row, and a single one is its own. Each row asks its next one by
    key, which answers with no more of its text than is asked for: texts are
    shuffled once, by key.
    """
    rows = rows.withColumns({"o": F.coalesce("doc_id", F.lit(-(2**63))), "content": F.xxhash64("text")})
    keys = rows.groupBy("o", "content").agg(F.first(F.floor(F.length("text") / 2).cast("int")).alias("half"))
    asks = next_keys(keys).select(F.col("next.o").alias("o"), F.col("next.content").alias("content"), F.col("o").alias("by_o"), F.col("content").alias("by_content"), "half")
    # both joins read the same columns of the rows, so their shuffle is one
    answers = rows.join(asks, ["o", "content"]).select("by_o", "by_content", F.col("doc_id").alias("next_id"), F.substring("text", F.lit(1), F.col("half")).alias("next_text"), *[F.col(c).alias(f"next_{c}") for c in carried])
    answers = answers.groupBy("by_o", "by_content").agg(*[F.first(c).alias(c) for c in answers.columns[2:]])
    return rows.join(answers.withColumnsRenamed({"by_o": "o", "by_content": "content"}), ["o", "content"]).drop("o", "content")


def as_text(fingerprint: Column) -> Column:
    return F.array_join(fingerprint, "")


def as_array(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text), F.lit(4)), lambda i: F.substring(text, i, F.lit(4)))


def fingerprint_documents(docs: DataFrame, k: int = 2, sketches: int = 64) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint array<string>. Null texts are empty ones; equal texts have
    equal fingerprints. No rows: no rows. Further columns are ignored."""
    return fingerprints(texts(docs), "text", "fingerprint", k, sketches).drop("text")


def edit_test(docs: DataFrame, k: int = 2, sketches: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited, and the fingerprints of its text, its edited text and the next text.

    edited: the last half (rounded down) of the code points gives way to the
    first as many, or all, of the next text (see ``with_next``). Null texts
    are empty ones. Very long texts are read whole, and repeated rows are
    rows each. No rows: no rows. Further columns are ignored.
    """
    # a fingerprint is one string where it is shuffled
    marked = fingerprints(texts(docs), "text", "fingerprint", k, sketches).withColumn("fingerprint", as_text(F.col("fingerprint")))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), "next_text")
    rows = with_next(marked, ["fingerprint"]).select("doc_id", F.length("text").cast("long").alias("n_chars"), "next_id", edited.alias("edited"), *[as_array(F.col(c)).alias(c) for c in ("fingerprint", "next_fingerprint")])
    return fingerprints(rows, "edited", "edited_fingerprint", k, sketches)
