import gzip
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytegrams.functions import grams, hashing
from bytegrams.functions.lz import lz_hashes
from bytegrams.operators import counts, labels, occurrences, scan, sketch, topk, vectors
from bytegrams.operators.scan import GramSpec
from bytegrams.plans import jobs
from bytegrams.sources import corpus, libsvm, profile
from bytegrams.streaming import counts as fed

TEXTS = {1: b"", 2: None, 3: b"abc", 4: b"abcd", 5: b"abcdabcd", 6: bytes(range(256)) * 2, 7: b"xyz" * 400, 8: b"abcdabce", 9: b"\x00" * 3000, 10: b"a"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in TEXTS.items()], "doc_id long, content binary").repartition(3)


def plain(n, width=1, mode="documents", texts=TEXTS):
    total = Counter()
    for t in texts.values():
        t = t or b""
        found = [t[i : i + n * width] for i in range(0, len(t) - n * width + 1, width)]
        total.update(found if mode == "occurrences" else set(found))
    return total


def collected(df):
    return {bytes(r[0]) if isinstance(r[0], (bytes, bytearray)) else r[0]: r[1] for r in df.collect()}


@pytest.mark.parametrize("n,width,mode", [(1, 1, "documents"), (4, 1, "occurrences"), (8, 1, "documents"), (1024, 1, "documents"), (2, 2, "occurrences"), (3, 4, "documents")])
def test_gram_counts(docs, n, width, mode):
    want = plain(n, width, mode)
    spec = GramSpec(n, width, count_mode=mode)
    assert collected(counts.gram_counts(docs, spec)) == want
    native = docs.select("doc_id", F.explode(grams.symbol_grams(F.col("content"), n, width)).alias("gram"))
    native = native.distinct() if mode == "documents" else native
    assert collected(native.groupBy("gram").count()) == want
    chunks = corpus.split_large(docs, 100, spec.size - width, width)
    assert collected(counts.gram_counts(chunks, spec, chunked=True)) == want
    buckets = collected(counts.bucket_counts(docs, spec))
    assert sum(buckets.values()) <= sum(want.values()) and (mode == "documents" or sum(buckets.values()) == sum(want.values()))
    assert collected(counts.bucket_counts(chunks, spec, chunked=True)) == buckets


def test_collisions_and_stride(docs):
    small = collected(counts.bucket_counts(docs, GramSpec(4, filter_size=17, count_mode="occurrences")))
    assert set(small) <= set(range(17)) and sum(small.values()) == sum(plain(4, mode="occurrences").values())
    for hasher in hashing.HASHERS:
        every = collected(counts.bucket_counts(docs, GramSpec(4, hasher=hasher)))
        assert collected(counts.bucket_counts(docs, GramSpec(4, hasher=hasher, stride=3))) == {b: c for b, c in every.items() if b % 3 == 0}
        assert collected(counts.bucket_counts(docs, GramSpec(4, hasher=hasher, stride=0))) == every
        for gram, cnt in plain(4).items():
            h = hashing.gram_hash(gram) if hasher == "rabin_karp" else hashing.murmur3(gram)
            assert every[h % hashing.FILTER_SIZE] >= cnt


def test_topk_and_ties(docs):
    want = plain(4)
    ranked = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    got = counts.gram_counts(docs, GramSpec(4))
    assert collected(topk.top_grams(got, 3)) == dict(ranked[:3])
    assert collected(topk.top_grams(got, 3, "keep")) == {g: c for g, c in want.items() if c >= ranked[2][1]}
    assert topk.top_grams(got, 10**6).count() == len(want)
    assert collected(counts.gram_counts(docs, GramSpec(4), min_count=2)) == {g: c for g, c in want.items() if c >= 2}


@pytest.mark.parametrize("size", [hashing.FILTER_SIZE, 61])
def test_exact_top_grams(docs, size):
    """Whatever collides: the k grams of all that count most."""
    for mode in ("documents", "occurrences"):
        want = plain(4, mode=mode)
        ranked = sorted(want.items(), key=lambda x: (-x[1], x[0]))
        for k in (1, 7, 40, 10**4):
            spec = GramSpec(4, filter_size=size, count_mode=mode)
            assert collected(jobs.exact_top_grams(docs, spec, k)) == dict(ranked[:k])
    least = ranked[6][1]
    assert collected(jobs.exact_top_grams(docs, spec, 7, "keep")) == {g: c for g, c in want.items() if c >= least}


def test_merge(docs):
    spec, half = GramSpec(3), F.col("doc_id") < 6
    parts = counts.merge_counts(counts.bucket_counts(docs.filter(half), spec), counts.bucket_counts(docs.filter(~half), spec))
    assert collected(parts) == collected(counts.bucket_counts(docs, spec))


def test_two_pass_is_native_topk(docs):
    every = plain(4)
    chosen = jobs.select_grams(docs, 4, 2000, exact=True)
    assert {bytes(r.gram): r.cnt for r in chosen.rows.collect()} == every
    assert chosen.missing == 2000 - len(every) and chosen.facts()["kept"] == len(every)


@pytest.mark.parametrize("exact", [True, False])
def test_vectors(spark, docs, exact, tmp_path):
    chosen = jobs.select_grams(docs, 4, 40, exact=exact, count_mode="occurrences")
    profile.save_profile(chosen, str(tmp_path / "p"))
    again = profile.load_profile(spark, str(tmp_path / "p"))
    assert again.facts() == chosen.facts() and sorted(map(str, again.rows.collect())) == sorted(map(str, chosen.rows.collect()))
    for values in ("binary", "counts"):
        rows = {r.doc_id: r.features for r in vectors.vectorize(docs, again, values).collect()}
        assert set(rows) == set(TEXTS) and all(v.size == 40 and list(v.indices) == sorted(set(v.indices)) for v in rows.values())
        names = {r.feature_idx: (bytes(r.gram) if exact else r.bucket) for r in again.rows.collect()}
        key = (lambda g: g) if exact else (lambda g: hashing.gram_hash(g) % hashing.FILTER_SIZE)
        for k, t in TEXTS.items():
            own = Counter(key((t or b"")[i : i + 4]) for i in range(len(t or b"") - 3))
            want = {i: float(own[g] if values == "counts" else 1) for i, g in names.items() if own[g]}
            assert dict(zip(rows[k].indices, rows[k].values, strict=True)) == want
    for r in vectors.to_ml_vectors(vectors.vectorize(docs, again)).join(vectors.vectorize(docs, again).withColumnRenamed("features", "own"), "doc_id").collect():
        assert r.features.size == 40 and list(r.features.indices) == list(r.own.indices) and list(r.features.values) == list(r.own["values"])


def test_slice(docs):
    chosen = jobs.select_grams(docs, 4, 10, exact=True)
    cut = vectors.vectorize(docs.withColumn("content", F.substring("content", 3, 6)), chosen)
    assert sorted(map(str, vectors.vectorize(docs, chosen, part=(2, 6)).collect())) == sorted(map(str, cut.collect()))


def test_symbols(docs):
    assert [grams.symbol_width(k) for k in (2, 256, 257, 65536, 65537)] == [1, 1, 2, 2, 4]
    got = {r.doc_id: r.s for r in docs.select("doc_id", grams.decode_symbols(F.col("content"), 2).alias("s")).collect()}
    assert list(got[5]) == [0x6162, 0x6364] * 2 and list(got[3]) == [0x6162] and list(got[10]) == []
    chosen = jobs.select_symbol_grams(docs, 2, 5, 60_000, stride=1)
    want = plain(2, 2)
    least = sorted(want.values(), reverse=True)[4]
    assert all(want[bytes(r.gram)] == r.cnt >= min(least, r.cnt) for r in chosen.rows.collect()) and chosen.kept >= 5
    assert jobs.select_symbol_grams(docs, 8, 3, 300).spec.stride == 2


def test_lz(docs):
    chosen = jobs.select_lz(docs, 30)
    assert chosen.spec.n == 0 and not chosen.exact
    own = {k: Counter((lz_hashes(t or b"") % np.uint32(hashing.FILTER_SIZE)).tolist()) for k, t in TEXTS.items()}
    total = Counter(b for seen in own.values() for b in seen)
    top = sorted(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:30])
    assert [(r.bucket, r.cnt) for r in chosen.rows.orderBy("feature_idx").collect()] == top
    for values in ("binary", "counts"):
        got = {(r.doc_id, r.feature_idx): r.value for r in vectors.long_form(vectors.vectorize(docs, chosen, values)).collect()}
        assert got == {(k, i): float(seen[b] if values == "counts" else 1) for k, seen in own.items() for i, (b, _) in enumerate(top) if seen[b]}
    with pytest.raises(ValueError):
        counts.gram_counts(docs, chosen.spec)


def test_occurrences(spark, docs):
    wanted = spark.createDataFrame([(bytearray(g),) for g in (b"abcd", b"\x00" * 4, b"none", b"abcd")], "gram binary")
    got = {(bytes(r.gram), r.doc_id) for r in occurrences.occurrence_index(docs, wanted, GramSpec(4)).collect()}
    assert got == {(b"abcd", 4), (b"abcd", 5), (b"abcd", 8), (b"abcd", 6), (b"\x00" * 4, 9)} - {(b"abcd", 6)} | ({(b"abcd", 6)} if b"abcd" in TEXTS[6] else set())
    for size in (1, 3, 1 << 16):
        segments, numbers = occurrences.posting_segments(docs, wanted, GramSpec(4), size)
        assert {(bytes(r.gram), r.doc_id) for r in occurrences.segment_members(segments, numbers, size).collect()} == got
        assert all(r.n == len(r.places) <= size and list(r.places) == sorted(set(r.places)) and max(r.places) < size for r in segments.collect())


def test_settings():
    for wrong in (dict(), dict(n=3, lz=True), dict(n=3, stride=-1), dict(n=3, width=3), dict(n=3, hasher="x"), dict(n=3, count_mode="x"), dict(n=2, width=2, hasher="murmur3")):
        with pytest.raises(ValueError):
            GramSpec(**wrong)
    with pytest.raises(ValueError):
        jobs.select_grams(None, 4, 17, filter_size=17)


def test_files(spark, tmp_path):
    plain_, packed = b"plain text", gzip.compress(b"packed ") + gzip.compress(b"twice")
    made = {"a.bin": plain_, "sub/b.gz": packed, "sub/deep/c.gz": packed[:-9], "d": b"\x1f\x8b", "e": b"\x1f\x8b\x09rest", "f": b"\x1f\x8b\x08broken", "_skipped": b"x"}
    for name, content in made.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    good, rejects = corpus.decode_gzip(corpus.read_corpus(spark, str(tmp_path))[0])
    got = {r.doc_id.rsplit("/", 1)[-1]: bytes(r.content) for r in good.collect()}
    assert got == {"a.bin": plain_, "b.gz": b"packed twice", "d": b"\x1f\x8b", "e": b"\x1f\x8b\x09rest"}
    assert {r.doc_id.rsplit("/", 1)[-1] for r in rejects.collect()} == {"c.gz", "f"}
    small, large = corpus.read_corpus(spark, str(tmp_path), most=9)
    assert {r.doc_id.rsplit("/", 1)[-1] for r in small.collect()} == {"d", "e", "f"} - ({"f"} if len(made["f"]) > 9 else set())
    assert {(r.doc_id.rsplit("/", 1)[-1], r.error) for r in large.collect()} == {(k.rsplit("/", 1)[-1], "too large") for k, v in made.items() if len(v) > 9}


def test_labels_and_libsvm(spark, docs, tmp_path):
    whole, names = labels.label_multi_class({"b": docs, "A": docs.limit(2), "a": docs.limit(1)})
    assert names == {"A": 0, "a": 1, "b": 2} and whole.count() == len(TEXTS) + 3
    both = labels.label_two_class(docs.limit(3), docs)
    assert {r.label: r["count"] for r in both.groupBy("label").count().collect()} == {0: 3, 1: len(TEXTS)}
    named, classes = labels.label_by_column(docs.withColumn("kind", F.when(F.col("doc_id") < 4, "z").when(F.col("doc_id") < 9, "B")), "kind")
    assert sorted(map(tuple, classes.collect())) == [(0, "B"), (1, "z")] and named.filter("label IS NULL").count() == 2
    data = jobs.build_dataset(both, jobs.select_grams(both, 2, 10, exact=True), "counts", str(tmp_path / "libsvm"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "libsvm")).collect())
    assert lines == sorted(r.value for r in libsvm.libsvm_lines(data).collect()) and any(x == "1" for x in lines)
    back = spark.read.format("libsvm").option("numFeatures", 10).load(str(tmp_path / "libsvm"))
    assert back.count() == len(lines)


def test_sketch(docs):
    exact = {k.hex().upper(): v for k, v in plain(2).items()}
    got = {r.gram_hex: r.estimate for r in sketch.approx_top_grams(docs, 2, 5, 5000).collect()}
    assert got and all(exact[g] == c for g, c in got.items())
    halves = [sketch.summarize(docs.filter(F.col("doc_id") % 2 == k), 2, 5000) for k in (0, 1)]
    merged = sketch.estimate(sketch.merge_summaries(halves[0].unionByName(halves[1]), 5000), 5)
    assert {r.estimate for r in merged.collect()} == set(got.values())


def test_feeding(spark, docs, tmp_path):
    spec, path = GramSpec(3), str(tmp_path / "counts")
    fed.feed(docs.filter("doc_id < 5"), spec, path, "one")
    fed.feed(docs.filter("doc_id >= 5"), spec, path, "two")
    fed.feed(docs.filter("doc_id >= 5"), spec, path, "two")
    assert collected(fed.totals(spark, path)) == collected(counts.bucket_counts(docs, spec))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fed.feed_stream(stream, spec, str(tmp_path / "streamed"), str(tmp_path / "state")).awaitTermination()
    assert collected(fed.totals(spark, str(tmp_path / "streamed"))) == collected(counts.bucket_counts(docs, spec))


def test_hash_grams_matches_windows(docs):
    spec = GramSpec(4)
    rows = scan.hash_grams(counts.gram_counts(docs, spec), spec).collect()
    assert all(r.bucket == hashing.gram_hash(bytes(r.gram)) % hashing.FILTER_SIZE for r in rows)
    assert np.all([r.bucket >= 0 for r in rows])
