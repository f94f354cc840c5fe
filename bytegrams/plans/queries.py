"""Queries over the given tables, each with DuckDB SQL for the same rows where SQL can say it.

Grams are compared as hexadecimal strings. The SQL splits a text into its bytes and joins neighbours again.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrams.functions import grams, hashing
from bytegrams.operators import counts, labels, occurrences, sketch, topk, vectors
from bytegrams.operators.scan import GramSpec
from bytegrams.plans import jobs
from bytegrams.sources import corpus, libsvm, profile, ranges
from bytegrams.sources.shared import place, remove, stored
from bytegrams.streaming import counts as fed

K, N = 20, 8
VEC_N, VEC_K = 6, 60


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return corpus.docs_from_table(corpus.dealt(read(spark, sf_dir, "documents")), "doc_id", "text", *keep)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation is a document."""
    rows = corpus.dealt(read(spark, sf_dir, "conversations")).withColumn("name", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return corpus.docs_from_table(rows, "name", "text", "role", "conv_id")


def hexed(df: DataFrame) -> DataFrame:
    return df.withColumn("gram_hex", grams.gram_to_hex(F.col("gram"))).drop("gram")


def gram_topk_docfreq(spark, sf_dir):
    return hexed(jobs.exact_top_grams(documents(spark, sf_dir), GramSpec(N), K))


def gram_topk_occurrences(spark, sf_dir):
    return hexed(jobs.exact_top_grams(turns(spark, sf_dir), GramSpec(N, count_mode="occurrences"), K))


def gram_topk_ties(spark, sf_dir):
    return hexed(jobs.exact_top_grams(turns(spark, sf_dir), GramSpec(12), K, "keep"))


def gram_min_count(spark, sf_dir):
    return hexed(counts.gram_counts(turns(spark, sf_dir), GramSpec(VEC_N), min_count=20))


def gram_large_n(spark, sf_dir):
    return hexed(jobs.exact_top_grams(turns(spark, sf_dir), GramSpec(64), K))


def gram_native(spark, sf_dir):
    """The same as the scan, with built-in functions only: the cross-check."""
    each = turns(spark, sf_dir).select(F.explode(F.array_distinct(grams.byte_grams(F.col("content"), N))).alias("gram"))
    return hexed(topk.top_grams(each.groupBy("gram").agg(F.count(F.lit(1)).alias("cnt")), K))


def gram_chunked(spark, sf_dir):
    """Documents cut into overlapping rows count the same."""
    spec = GramSpec(N)
    rows = corpus.split_large(documents(spark, sf_dir), 1 << 13, spec.size - 1)
    return hexed(jobs.exact_top_grams(rows, spec, K, chunked=True))


def bucket_topk(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(N)), K)


def bucket_topk_occurrences(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(N, count_mode="occurrences")), K)


def bucket_stride(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(N, stride=3), min_count=3), K)


def bucket_small_filter(spark, sf_dir):
    return counts.bucket_counts(turns(spark, sf_dir), GramSpec(N, filter_size=257))


def bucket_merge(spark, sf_dir):
    docs, spec = turns(spark, sf_dir), GramSpec(N)
    even = F.col("conv_id") % 2 == 0
    return topk.top_buckets(counts.merge_counts(counts.bucket_counts(docs.filter(even), spec), counts.bucket_counts(docs.filter(~even), spec)), K)


def exact_two_pass(spark, sf_dir):
    return hexed(jobs.select_grams(turns(spark, sf_dir), N, K, exact=True).rows.select("gram", "cnt"))


def profile_hashed(spark, sf_dir):
    return jobs.select_grams(turns(spark, sf_dir), N, K).rows.select("feature_idx", "bucket", "cnt")


def profile_exact(spark, sf_dir):
    return hexed(jobs.select_grams(turns(spark, sf_dir), N, K, exact=True).rows.select("feature_idx", "bucket", "gram", "cnt"))


def profile_stored(spark, sf_dir):
    """A profile that was saved and loaded again; its buckets are computed anew."""
    return hexed(_saved(spark, jobs.select_grams(turns(spark, sf_dir), N, K, exact=True)).rows.select("feature_idx", "bucket", "gram", "cnt"))


def _saved(spark, chosen):
    path = place(spark, "profile")
    profile.save_profile(chosen, path)
    return profile.load_profile(spark, path)


def profile_stored_hashed(spark, sf_dir):
    """Every second bucket, as the default stride of eight bytes says, saved and loaded."""
    return _saved(spark, jobs.select_grams(turns(spark, sf_dir), N, K, stride=None)).rows.select("feature_idx", "bucket", "cnt")


def profile_facts(spark, sf_dir):
    """What a saved profile tells of itself; more is asked for than there is, so some are missing."""
    stored_profile = _saved(spark, jobs.select_grams(turns(spark, sf_dir), 2, 100_000))
    facts = stored_profile.facts() | {"missing": stored_profile.missing}
    return turns(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_docs")).select("n_docs", *[F.lit(facts[k]).cast("long").alias(k) for k in ("n", "kept", "missing", "filter_size")])


def symbol_grams_w2(spark, sf_dir):
    return hexed(jobs.exact_top_grams(turns(spark, sf_dir), GramSpec(4, width=2), K, "keep"))


def symbol_grams_w4(spark, sf_dir):
    return hexed(jobs.exact_top_grams(turns(spark, sf_dir), GramSpec(2, width=4), K, "keep"))


def symbol_buckets_w4(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(2, width=4)), K)


def symbol_buckets_w2(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(4, width=2)), K)


def symbol_select(spark, sf_dir):
    """The generic selection over symbols of an alphabet of 100,000: exact, with ties."""
    return hexed(jobs.select_symbol_grams(turns(spark, sf_dir), 2, K, 100_000).rows.select("feature_idx", "bucket", "gram", "cnt"))


def symbol_values(spark, sf_dir):
    return turns(spark, sf_dir).select(F.explode(grams.decode_symbols(F.col("content"), 2)).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("cnt"))


def _given(spark, sf_dir):
    """Every 16 bytes of each benchmark item."""
    return read(spark, sf_dir, "benchmark").select(F.explode(grams.byte_grams(F.encode("text", "utf-8"), 16)).alias("gram"))


def occurrence_long(spark, sf_dir):
    return hexed(occurrences.occurrence_index(documents(spark, sf_dir), _given(spark, sf_dir), GramSpec(16)))


def occurrence_sets(spark, sf_dir):
    """The documents of each gram in one line, put together from segments."""
    found = occurrences.segment_members(*occurrences.posting_segments(documents(spark, sf_dir), _given(spark, sf_dir), GramSpec(16), 512), 512)
    sets = found.groupBy("gram").agg(F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))
    return hexed(sets).select("gram_hex", F.array_join(F.transform("doc_ids", lambda d: d.cast("string")), ",").alias("doc_ids"))


def occurrence_segments(spark, sf_dir):
    segments, _ = occurrences.posting_segments(documents(spark, sf_dir), _given(spark, sf_dir), GramSpec(16), 128)
    return hexed(segments).select("gram_hex", "segment", "n", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


def gram_n1024(spark, sf_dir):
    """Grams of 1024 bytes of all documents: no shuffle has their bytes."""
    return hexed(jobs.exact_top_grams(documents(spark, sf_dir), GramSpec(1024), K))


def _joined_profile(spark, sf_dir, exact, values):
    """As _vectors, but as if ten rows were too many to give to every task."""
    docs = turns(spark, sf_dir).drop("role", "conv_id")
    return vectors.long_form(vectors.vectorize(docs, jobs.select_grams(docs, VEC_N, VEC_K, exact=exact, most=10), values, most=10))


def vec_joined_exact(spark, sf_dir):
    return _joined_profile(spark, sf_dir, True, "counts")


def vec_joined_hashed(spark, sf_dir):
    return _joined_profile(spark, sf_dir, False, "binary")


def _vectors(spark, sf_dir, exact, values, part=None):
    docs = turns(spark, sf_dir).drop("role", "conv_id")
    return vectors.vectorize(docs, jobs.select_grams(docs, VEC_N, VEC_K, exact=exact), values, part)


def vec_exact_binary(spark, sf_dir):
    return vectors.long_form(_vectors(spark, sf_dir, True, "binary"))


def vec_exact_counts(spark, sf_dir):
    return vectors.long_form(_vectors(spark, sf_dir, True, "counts"))


def vec_hashed_binary(spark, sf_dir):
    return vectors.long_form(_vectors(spark, sf_dir, False, "binary"))


def vec_hashed_counts(spark, sf_dir):
    return vectors.long_form(_vectors(spark, sf_dir, False, "counts"))


def vec_slice(spark, sf_dir):
    return vectors.long_form(_vectors(spark, sf_dir, True, "counts", (5, 120)))


def libsvm_lines(spark, sf_dir):
    """Classes are the roles of turns."""
    docs, _ = labels.label_by_column(turns(spark, sf_dir), "role")
    return libsvm.libsvm_lines(jobs.build_dataset(docs, jobs.select_grams(docs, VEC_N, VEC_K, exact=True), "counts"))


def labels_two_class(spark, sf_dir):
    known = documents(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    both = labels.label_two_class(known.filter("toxic = 0"), known.filter("toxic = 1"))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("content")).alias("n_bytes"))


def labels_multi_class(spark, sf_dir):
    docs, classes = labels.label_by_column(documents(spark, sf_dir, "source"), "source")
    return docs.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs")).join(classes, "label")


def gzip_detect(spark, sf_dir):
    """Bytes 4 on of each turn as they are, and of every third one behind a header: how many count as gzipped."""
    rows = turns(spark, sf_dir).withColumn("content", F.when(F.length("content") % 3 == 0, F.concat(F.unhex(F.lit("1F8B08")), F.col("content"))).otherwise(F.col("content")))
    return rows.groupBy(corpus.is_gzip(F.col("content")).alias("is_gzip")).agg(F.count(F.lit(1)).alias("n_docs"))


def gzip_decode(spark, sf_dir):
    """Every third turn is packed, and unpacked again with the rest."""

    def pack(batches):
        for batch in batches:
            content = [gzip.compress(c) if len(c) % 3 == 0 else c for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(content, pa.binary())], ["doc_id", "content"])

    packed = turns(spark, sf_dir).select("doc_id", F.coalesce("content", F.lit(b"")).alias("content")).mapInArrow(pack, "doc_id string, content binary")
    docs, rejects = corpus.decode_gzip(packed)
    return docs.select("doc_id", F.sha2("content", 256).alias("content_sha256")).unionByName(rejects.select("doc_id", F.col("error").alias("content_sha256")))


def range_grams(spark, sf_dir):
    """Documents as gzipped text files, read in ranges of 64 KB that overlap: grams of three bytes inside lines."""
    path = place(spark, "files")
    read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("value")).write.option("compression", "gzip").text(path)
    rows = stored(ranges.read_ranges(spark, path, 2, 1 << 16), "ranges")
    remove(spark, path)
    files, _ = ranges.without_rejects(rows.filter(F.col("doc_id").endswith(".txt.gz")))
    found = hexed(counts.gram_counts(files, GramSpec(3, count_mode="occurrences"), min_count=50, chunked=True))
    return found.filter(~F.col("gram_hex").rlike("^(..)*0A"))


def bucket_murmur3(spark, sf_dir):
    return topk.top_buckets(counts.bucket_counts(turns(spark, sf_dir), GramSpec(N, hasher="murmur3")), K)


def lz_features(spark, sf_dir):
    docs = turns(spark, sf_dir).drop("role", "conv_id")
    return vectors.long_form(vectors.vectorize(docs, jobs.select_lz(docs, VEC_K, min_count=2)))


def heavy_bounds(spark, sf_dir):
    """Grams that must have a counter, by their exact counts, and whether the guaranteed bounds hold for them."""
    docs, spec, room = documents(spark, sf_dir), GramSpec(4, count_mode="occurrences"), 4000
    total = docs.agg(F.sum(F.greatest(F.length("content") - 3, F.lit(0)))).first()[0]
    exact = counts.gram_counts(docs, spec, min_count=total // (room + 1) + 1)
    bounds = sketch.heavy_grams(docs, spec, room)
    held = F.coalesce((F.col("lower") <= F.col("cnt")) & (F.col("cnt") <= F.col("upper")), F.lit(False))
    return hexed(exact.join(bounds, "gram", "left").select("gram", "cnt", held.alias("held")))


def counts_fed(spark, sf_dir):
    """Turns in ten feeds, some of them run again: a replayed batch counts once."""
    path = place(spark, "fed")
    docs = turns(spark, sf_dir)
    for k in (0, 1, 2, 2, 3, 4, 5, 6, 3, 7, 8, 9):
        fed.feed(docs.filter(F.col("conv_id") % 10 == k), GramSpec(N), path, str(k))
    return topk.top_buckets(fed.totals(spark, path), K)


def approx_topk(spark, sf_dir):
    return sketch.approx_top_grams(turns(spark, sf_dir), N, K, 100_000)


def approx_merged(spark, sf_dir):
    """Summaries of two halves, merged; with room for all grams of two bytes they are exact."""
    room = 100_000
    docs = turns(spark, sf_dir)
    even = F.col("conv_id") % 2 == 0
    parts = sketch.summarize(docs.filter(even), 2, room).unionByName(sketch.summarize(docs.filter(~even), 2, room))
    return sketch.estimate(sketch.merge_summaries(parts, room), 1 << 16)


NAMES = (
    gram_topk_docfreq, gram_topk_occurrences, gram_topk_ties, gram_min_count, gram_large_n, gram_native, gram_chunked, bucket_topk, bucket_topk_occurrences,
    bucket_stride, bucket_small_filter, bucket_merge, exact_two_pass, profile_hashed, profile_exact, profile_stored, profile_stored_hashed, profile_facts, symbol_grams_w2, symbol_grams_w4,
    symbol_buckets_w2, symbol_buckets_w4, symbol_select, symbol_values, occurrence_long, occurrence_sets, occurrence_segments,
    gram_n1024, vec_joined_exact, vec_joined_hashed, vec_exact_binary, vec_exact_counts, vec_hashed_binary, vec_hashed_counts, vec_slice,
    libsvm_lines, labels_two_class, labels_multi_class, gzip_detect, gzip_decode, range_grams, bucket_murmur3, lz_features, heavy_bounds, counts_fed, approx_topk, approx_merged,
)
QUERIES = {f.__name__: f for f in NAMES}

_DOCS = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)"
_TURNS = "h AS (SELECT conv_id || '-' || turn AS doc_id, role, hex(encode(coalesce(text, ''))) AS h FROM conversations)"
_TABLE = "[" + ",".join(f"{x}::UBIGINT" for x in hashing.symbol_table().tolist()) + "]"


def _grams(n: int, source: str = _TURNS, step: int = 1) -> str:
    """h, pieces of it, and g (doc_id, i from 0, gram_hex)."""
    return f"""{source},
o AS (SELECT doc_id, o, substr(h, 2 * o + 1, {2 * (1000 + n - 1)}) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT), 1000)) AS o FROM h)),
g AS (SELECT doc_id, o + i AS i, substr(h, 2 * i + 1, {2 * n}) AS gram_hex FROM (SELECT doc_id, o, h, unnest(range(0, CAST(least(1000, len(h) // 2 - {n - 1}) AS BIGINT), {step})) AS i FROM o))"""


def _number(first: int, size: int = 1) -> str:
    """Bytes of gram_hex as a number."""
    return f"CAST('0x' || substr(gram_hex, {2 * first + 1}, {2 * size}) AS UBIGINT)"


def _buckets(n: int, filter_size: int = hashing.FILTER_SIZE) -> str:
    """As _grams, and k (doc_id, i, gram_hex, bucket)."""
    terms = " + ".join(f"t[CAST({_number(j)} AS BIGINT) + 1] * {pow(31, n - 1 - j, 1 << 32)} % 4294967296" for j in range(n))
    return f"{_grams(n)},\nt AS (SELECT {_TABLE} AS t),\nk AS (SELECT doc_id, i, gram_hex, CAST(({terms}) % 4294967296 % {filter_size} AS BIGINT) AS bucket FROM g, t)"


def _count(key: str, rows: str, mode: str = "count(DISTINCT doc_id)") -> str:
    return f"SELECT {key}, {mode} AS cnt FROM {rows} GROUP BY {key}"


_TOP_B = f"SELECT bucket, cnt FROM c ORDER BY cnt DESC, bucket LIMIT {K}"


def _exact(n: int, k: int, windows: str = "") -> str:
    """The two passes: top (buckets), then p (feature_idx, bucket, gram_hex, cnt)."""
    return f"""{windows or _buckets(n)},
c AS ({_count('bucket', 'k')}), top AS (SELECT bucket, cnt, CAST(row_number() OVER (ORDER BY bucket) - 1 AS INTEGER) AS feature_idx FROM (SELECT * FROM c ORDER BY cnt DESC, bucket LIMIT {k})),
e AS (SELECT gram_hex, min(bucket) AS bucket, count(DISTINCT doc_id) AS cnt FROM k WHERE bucket IN (SELECT bucket FROM top) GROUP BY gram_hex),
p AS (SELECT CAST(row_number() OVER (ORDER BY cnt DESC, gram_hex) - 1 AS INTEGER) AS feature_idx, * FROM (SELECT * FROM e ORDER BY cnt DESC, gram_hex LIMIT {k}))"""


def _vec(exact: bool, value: str, where: str = "") -> str:
    on, rows = ("gram_hex", "p") if exact else ("bucket", "top")
    return f"WITH {_exact(VEC_N, VEC_K)}\nSELECT doc_id, feature_idx, CAST({value} AS DOUBLE) AS value FROM k JOIN {rows} USING ({on}) {where} GROUP BY doc_id, feature_idx"


def _keep(n: int, step: int = 1) -> str:
    return f"""WITH {_grams(n, step=step)}, u AS (SELECT DISTINCT doc_id, gram_hex FROM g), c AS MATERIALIZED ({_count('gram_hex', 'u', 'count(*)')})
SELECT gram_hex, cnt FROM c QUALIFY rank() OVER (ORDER BY cnt DESC) <= {K}"""


def _top(n: int, source: str = _TURNS, mode: str = "count(DISTINCT doc_id)") -> str:
    return f"WITH {_grams(n, source)} {_count('gram_hex', 'g', mode)} ORDER BY cnt DESC, gram_hex LIMIT {K}"


def _murmur(n: int) -> str:
    """Murmur3 of 8 bytes, a step a query."""
    m = "4294967295"
    word = lambda o: " + ".join(f"{_number(o + j)} * {1 << 8 * j}" for j in range(4))
    rot = lambda x, r: f"((({x}) * {1 << r} & {m}) | (({x}) >> {32 - r}))"
    mul = lambda x, c: f"(({x}) * {c}::UBIGINT & {m})"
    scr = lambda x: mul(rot(mul(x, hashing.C1), 15), hashing.C2)
    steps = f"m0 AS (SELECT doc_id, {scr('a')} AS a, {scr('c')} AS c FROM (SELECT doc_id, ({word(0)}) AS a, ({word(4)}) AS c FROM g)),\n"
    steps += f"m1 AS (SELECT doc_id, c, xor({hashing.WINDOW_SEED}::UBIGINT, a) AS x FROM m0),\n"
    steps += f"m2 AS (SELECT doc_id, xor(({rot('x', 13)} * 5 + {hashing.ADD}) & {m}, c) AS x FROM m1),\n"
    steps += f"m3 AS (SELECT doc_id, xor(({rot('x', 13)} * 5 + {hashing.ADD}) & {m}, {n}::UBIGINT) AS x FROM m2),\n"
    steps += f"m4 AS (SELECT doc_id, {mul('xor(x, x >> 16)', hashing.MIX1)} AS x FROM m3),\nm5 AS (SELECT doc_id, {mul('xor(x, x >> 13)', hashing.MIX2)} AS x FROM m4),\n"
    return f"{_grams(n)},\n{steps}k AS (SELECT doc_id, CAST(xor(x, x >> 16) % {hashing.FILTER_SIZE} AS BIGINT) AS bucket FROM m5)"


def _phrases() -> str:
    """d (doc_id, h), and k (doc_id, bucket) of the running hashes of phrases, byte by byte. ``seen`` are those that ended one."""
    m = "4294967295"
    mul = lambda x, c: f"(({x}) * {c}::UBIGINT & {m})"
    rot = lambda x, r: f"((({x}) * {1 << r} & {m}) | (({x}) >> {32 - r}))"
    return f"""RECURSIVE {_TURNS.replace('h AS (', 'd AS (')},
r AS (SELECT doc_id, 0 AS pos, 0::UBIGINT AS state, 0::UBIGINT AS word, 0::UBIGINT AS size, CAST([] AS UBIGINT[]) AS seen, NULL::UBIGINT AS x FROM d
UNION ALL SELECT doc_id, pos, CASE WHEN ends THEN 0 ELSE state END, CASE WHEN ends THEN 0 ELSE word END, CASE WHEN ends THEN 0 ELSE size END, CASE WHEN ends THEN list_append(seen, x) ELSE seen END, x
FROM (SELECT *, size > 2 AND NOT list_contains(seen, x) AS ends
FROM (SELECT doc_id, pos, state, word, size, seen, xor(z, z >> 16) AS x
FROM (SELECT doc_id, pos, state, word, size, seen, {mul('xor(z, z >> 13)', hashing.MIX2)} AS z
FROM (SELECT doc_id, pos, state, word, size, seen, {mul('xor(z, z >> 16)', hashing.MIX1)} AS z
FROM (SELECT doc_id, pos, CASE WHEN size % 4 = 0 THEN y ELSE state END AS state, CASE WHEN size % 4 = 0 THEN 0 ELSE word END AS word, size, seen, xor(CASE WHEN size % 4 = 0 THEN y ELSE a END, size) AS z
FROM (SELECT doc_id, pos, state, word, size, seen, a, ({rot('a', 13)} * 5 + {hashing.ADD}) & {m} AS y
FROM (SELECT doc_id, pos, state, word, size, seen, xor(state, {mul(rot(mul('word', hashing.C1), 15), hashing.C2)}) AS a
FROM (SELECT doc_id, pos + 1 AS pos, state, word + (CAST('0x' || substr(h, 2 * pos + 1, 2) AS UBIGINT) << CAST(8 * (size % 4) AS INTEGER)) AS word, size + 1 AS size, seen FROM r JOIN d USING (doc_id) WHERE pos < len(h) // 2))))))))),
k AS (SELECT doc_id, CAST(x % {hashing.FILTER_SIZE} AS BIGINT) AS bucket FROM r WHERE x IS NOT NULL)"""


_W4 = f"{_grams(8, step=4)}, k AS (SELECT doc_id, CAST(({_number(0, 4)} * 31 + {_number(4, 4)}) % 4294967296 % {hashing.FILTER_SIZE} AS BIGINT) AS bucket FROM g)"
_SYMBOLS = f"""f1 AS (SELECT s, (s + 1) * {0x9E3779B1}::UBIGINT % 4294967296 AS x FROM (SELECT CAST(range AS UBIGINT) AS s FROM range(65536))),
f2 AS (SELECT s, xor(x, x >> 16) * {hashing.MIX1}::UBIGINT % 4294967296 AS x FROM f1), f3 AS (SELECT s, xor(x, x >> 13) * {hashing.MIX2}::UBIGINT % 4294967296 AS x FROM f2),
t AS MATERIALIZED (SELECT list(xor(x, x >> 16) ORDER BY s) AS t FROM f3)"""
_W2 = f"{_grams(8, step=2)}, {_SYMBOLS}, k AS (SELECT doc_id, CAST(({' + '.join(f't[CAST({_number(2 * j, 2)} AS BIGINT) + 1] * {31 ** (3 - j)}' for j in range(4))}) % 4294967296 % {hashing.FILTER_SIZE} AS BIGINT) AS bucket FROM g, t)"
_W4_KEPT = f"{_grams(8, step=4)}, k AS (SELECT doc_id, gram_hex, CAST(({_number(0, 4)} * 31 + {_number(4, 4)}) % 4294967296 % {hashing.FILTER_SIZE} AS BIGINT) AS bucket FROM g)"
_ITEMS = "b AS (SELECT hex(encode(text)) AS b FROM benchmark WHERE strlen(text) >= 16)"
_GIVEN = f"{_ITEMS}, w AS (SELECT DISTINCT substr(b, 2 * i + 1, 32) AS gram_hex FROM (SELECT b, unnest(range(0, CAST(len(b) // 2 - 15 AS BIGINT))) AS i FROM b)), {_grams(16, _DOCS)}, r AS (SELECT DISTINCT gram_hex, doc_id FROM g JOIN w USING (gram_hex))"

ORACLES = {
    "gram_topk_docfreq": _top(N, _DOCS),
    "gram_topk_occurrences": _top(N, mode="count(*)"),
    "gram_topk_ties": _keep(12),
    "gram_min_count": f"WITH {_grams(VEC_N)} {_count('gram_hex', 'g')} HAVING count(DISTINCT doc_id) >= 20",
    "gram_large_n": _top(64),
    "gram_native": _top(N),
    "gram_chunked": _top(N, _DOCS),
    "bucket_topk": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
    "bucket_topk_occurrences": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k', 'count(*)')}) {_TOP_B}",
    "bucket_stride": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k')} HAVING bucket % 3 = 0 AND count(DISTINCT doc_id) >= 3) {_TOP_B}",
    "bucket_small_filter": f"WITH {_buckets(N, 257)} {_count('bucket', 'k')}",
    "bucket_merge": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
    "exact_two_pass": f"WITH {_exact(N, K)} SELECT gram_hex, cnt FROM p",
    "profile_hashed": f"WITH {_exact(N, K)} SELECT feature_idx, bucket, cnt FROM top",
    "profile_exact": f"WITH {_exact(N, K)} SELECT feature_idx, bucket, gram_hex, cnt FROM p",
    "profile_stored": f"WITH {_exact(N, K)} SELECT feature_idx, bucket, gram_hex, cnt FROM p",
    "profile_stored_hashed": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k')}), top AS (SELECT * FROM c WHERE bucket % 2 = 0 ORDER BY cnt DESC, bucket LIMIT {K}) SELECT CAST(row_number() OVER (ORDER BY bucket) - 1 AS INTEGER) AS feature_idx, bucket, cnt FROM top",
    "profile_facts": f"WITH {_buckets(2)} SELECT (SELECT count(*) FROM conversations) AS n_docs, 2::BIGINT AS n, count(DISTINCT bucket) AS kept, 100000 - count(DISTINCT bucket) AS missing, {hashing.FILTER_SIZE}::BIGINT AS filter_size FROM k",
    "heavy_bounds": f"WITH {_grams(4, _DOCS)}, t AS (SELECT CAST(count(*) // 4001 AS BIGINT) AS least FROM g) SELECT gram_hex, count(*) AS cnt, true AS held FROM g GROUP BY gram_hex HAVING count(*) > (SELECT least FROM t)",
    "lz_features": f"""WITH {_phrases()}, c AS ({_count('bucket', 'k')} HAVING count(DISTINCT doc_id) >= 2),
top AS (SELECT bucket, CAST(row_number() OVER (ORDER BY bucket) - 1 AS INTEGER) AS feature_idx FROM (SELECT * FROM c ORDER BY cnt DESC, bucket LIMIT {VEC_K})) SELECT DISTINCT doc_id, feature_idx, 1.0::DOUBLE AS value FROM k JOIN top USING (bucket)""",
    "counts_fed": f"WITH {_buckets(N)}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
    "symbol_grams_w2": _keep(8, 2),
    "symbol_grams_w4": _keep(8, 4),
    "symbol_buckets_w4": f"WITH {_W4}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
    "symbol_buckets_w2": f"WITH {_W2}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
    "symbol_select": f"WITH {_exact(8, K, _W4_KEPT).replace(f'(SELECT * FROM e ORDER BY cnt DESC, gram_hex LIMIT {K})', f'(SELECT * FROM e QUALIFY rank() OVER (ORDER BY cnt DESC) <= {K})')} SELECT feature_idx, bucket, gram_hex, cnt FROM p",
    "symbol_values": f"WITH {_grams(2, step=2)} SELECT CAST({_number(0, 2)} AS BIGINT) AS symbol, count(*) AS cnt FROM g GROUP BY 1",
    "occurrence_long": f"WITH {_GIVEN} SELECT gram_hex, doc_id FROM r",
    "occurrence_sets": f"WITH {_GIVEN} SELECT gram_hex, string_agg(doc_id, ',' ORDER BY doc_id) AS doc_ids FROM r GROUP BY 1",
    "occurrence_segments": f"""WITH {_GIVEN}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM (SELECT DISTINCT doc_id FROM documents))
SELECT gram_hex, number // 128 AS segment, count(*) AS n, string_agg(number % 128, ',' ORDER BY number) AS places FROM r JOIN n USING (doc_id) GROUP BY 1, 2""",
    "gram_n1024": f"""WITH {_DOCS},
o AS (SELECT doc_id, o, substr(h, 2 * o + 1, 4046) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 AS BIGINT), 1000)) AS o FROM h)),
g AS (SELECT doc_id, o + i AS i, md5_number(substr(h, 2 * i + 1, 2048)) AS m FROM (SELECT doc_id, o, h, unnest(range(0, CAST(least(1000, len(h) // 2 - 1023) AS BIGINT))) AS i FROM o)),
c AS MATERIALIZED (SELECT m, count(DISTINCT doc_id) AS cnt, min({{'d': doc_id, 'i': i}}) AS p FROM g GROUP BY m),
t AS (SELECT * FROM c QUALIFY rank() OVER (ORDER BY cnt DESC) <= {K})
SELECT substr(h, 2 * p.i + 1, 2048) AS gram_hex, cnt FROM t JOIN h ON doc_id = p.d ORDER BY cnt DESC, gram_hex LIMIT {K}""",
    "vec_joined_exact": _vec(True, "count(*)"),
    "vec_joined_hashed": _vec(False, "1"),
    "vec_exact_binary": _vec(True, "1"),
    "vec_exact_counts": _vec(True, "count(*)"),
    "vec_hashed_binary": _vec(False, "1"),
    "vec_hashed_counts": _vec(False, "count(*)"),
    "vec_slice": _vec(True, "count(*)", f"WHERE i BETWEEN 5 AND 125 - {VEC_N}"),
    "libsvm_lines": f"""WITH {_exact(VEC_N, VEC_K)}, x AS (SELECT doc_id, feature_idx, count(*) AS n FROM k JOIN p USING (gram_hex) GROUP BY 1, 2),
y AS (SELECT doc_id, string_agg((feature_idx + 1) || ':' || n, ' ' ORDER BY feature_idx) AS x FROM x GROUP BY 1), z AS (SELECT role, row_number() OVER (ORDER BY lower(role), role) - 1 AS label FROM (SELECT DISTINCT role FROM h))
SELECT doc_id, label || coalesce(' ' || x, '') AS value FROM h JOIN z USING (role) LEFT JOIN y USING (doc_id)""",
    "labels_two_class": "SELECT toxic AS label, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "labels_multi_class": "SELECT CAST(dense_rank() OVER (ORDER BY lower(source), source) - 1 AS INTEGER) AS label, count(*) AS n_docs, source AS name FROM documents GROUP BY source",
    "gzip_detect": "SELECT strlen(text) % 3 = 0 AS is_gzip, count(*) AS n_docs FROM conversations GROUP BY 1",
    "gzip_decode": "SELECT conv_id || '-' || turn AS doc_id, sha256(coalesce(text, '')) AS content_sha256 FROM conversations",
    "range_grams": f"WITH {_grams(3, _DOCS)} SELECT gram_hex, count(*) AS cnt FROM g WHERE NOT regexp_matches(gram_hex, '^(..)*0A') GROUP BY 1 HAVING count(*) >= 50",
    "approx_merged": f"WITH {_grams(2)} SELECT gram_hex, count(DISTINCT doc_id) AS estimate FROM g GROUP BY 1",
    "bucket_murmur3": f"WITH {_murmur(N)}, c AS ({_count('bucket', 'k')}) {_TOP_B}",
}
