"""What the large forms give is what the small ones give."""

import gzip
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bytegrams.functions import bits, hashing, lz
from bytegrams.operators import counts, scan, sketch, topk, vectors
from bytegrams.operators.scan import GramSpec
from bytegrams.plans import jobs
from bytegrams.sources import corpus, profile, ranges, shared
from bytegrams.streaming import counts as fed

TEXTS = {k: bytes(random.Random(k).choices(b"abc\x00", k=random.Random(-k).randrange(400))) for k in range(40)} | {50: None, 51: b"", 52: b"ab" * 700, 53: b"ab" * 700}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*TEXTS.items(), (7, TEXTS[8]), (7, TEXTS[7]), (None, TEXTS[9])]
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "doc_id long, content binary").repartition(4)


def test_fingerprints_against_plain_python():
    b = np.frombuffer(random.Random(1).randbytes(700), np.uint8)
    for n in (1, 8, 64, 600):
        starts = np.array([0, 5, 100])
        for base, got in zip(hashing.BASES, hashing.fingerprints(b, n, starts), strict=True):
            assert got.tolist() == [sum((int(b[s + j]) + 1) * pow(base, j, hashing.P61) for j in range(n)) % hashing.P61 for s in starts]
    assert [len(x) for x in hashing.fingerprints(b[:0], 3, np.zeros(0, np.int64))] == [0, 0]


def test_bit_map(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345 << 40]
    words = bits.bit_map(spark.createDataFrame([(v,) for v in [*values, None]], "h long"), "h", 12)
    probes = np.array([v & (1 << 64) - 1 for v in [*values, 77 << 45]], np.uint64)
    assert bits.probed(words, probes).tolist() == [True] * 6 + [bool(77 << 45 >> 52 in {v % (1 << 64) >> 52 for v in values})]


@pytest.mark.parametrize("mode", ["documents", "occurrences"])
@pytest.mark.parametrize("n", [5, 300])
def test_late_bytes(docs, n, mode):
    """Repeated ids, null ids and null contents; all counts and the top, with ties."""
    spec = GramSpec(n, count_mode=mode)
    want = {bytes(r.gram): r.cnt for r in counts.gram_counts(docs, spec).collect()}
    assert {bytes(r.gram): r.cnt for r in counts.with_bytes(docs, counts.fingerprint_counts(docs, spec), spec).collect()} == want
    assert {bytes(r.gram): r.cnt for r in counts.gram_counts(docs, spec, min_count=3).collect()} == {g: c for g, c in want.items() if c >= 3}
    for k in (9, 10**5):
        top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert {bytes(r.gram): r.cnt for r in jobs.exact_top_grams(docs, spec, k).collect()} == dict(top)
        least = top[-1][1]
        assert {bytes(r.gram): r.cnt for r in jobs.exact_top_grams(docs, spec, k, "keep").collect()} == {g: c for g, c in want.items() if c >= least}


def test_shuffle_has_no_bytes(docs):
    """The rows that are grouped have numbers only."""
    assert [t for _, t in counts.fingerprint_counts(docs, GramSpec(300)).dtypes] == ["bigint"] * 6


@pytest.mark.parametrize("n, width, stride, mode", [(6, 1, 1, "documents"), (4, 2, 1, "occurrences"), (5, 1, 3, "documents")])
def test_top_by_anchors(docs, monkeypatch, n, width, stride, mode):
    """As if these grams were long: what counts most, with ties cut and kept, whatever is looked at first."""
    monkeypatch.setattr(scan, "ANCHORED", 2)
    spec = GramSpec(n, width=width, stride=stride, count_mode=mode)
    want = {bytes(r.gram): r.cnt for r in counts.gram_counts(docs, spec).collect()}
    for k, wider in ((1, 64), (9, 2)):
        monkeypatch.setattr(jobs, "WIDER", wider)
        top = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [(bytes(r.gram), r.cnt) for r in jobs.exact_top_grams(docs, spec, k).collect()] == top
        assert {bytes(r.gram): r.cnt for r in jobs.exact_top_grams(docs, spec, k, "keep").collect()} == {g: c for g, c in want.items() if c >= top[-1][1]}


def test_anchors_of_equal_windows():
    """Equal windows have equal anchors at equal distances, also where a document repeats itself."""
    for alphabet in (b"a", b"ab", b"abcd"):
        values = hashing.symbol_table()[np.frombuffer(bytes(random.Random(1).choices(alphabet, k=900)), np.uint8)]
        for n in (2, 3, 17, 900, 901):
            places, starts = hashing.anchors(values, n), np.arange(max(0, 901 - n))
            names = hashing.anchor_names(values, n, places)
            assert len(places) == len(starts) and (np.diff(places) >= 0).all() and ((starts <= places) & (places + n // 2 <= starts + n)).all()
            known = {}
            for s, p, name in zip(starts.tolist(), places.tolist(), names.tolist(), strict=True):
                assert known.setdefault(values[s : s + n].tobytes(), (p - s, name)) == (p - s, name)


MEMORY = """
import resource, random
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F
from bytegrams.operators.scan import GramSpec
from bytegrams.plans import jobs

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").config("spark.sql.shuffle.partitions", "1").getOrCreate()
hexed = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(k)).cast("binary"), 512) for k in range(32)])
docs = spark.range(8000, numPartitions=1).select(F.col("id").alias("doc_id"), F.encode(F.when(F.col("id") < 7, F.lit("ab" * 520)).otherwise(hexed), "utf-8").alias("content"))
print("TOP", [(bytes(r.gram[:2]), len(r.gram), r.cnt) for r in jobs.exact_top_grams(docs, GramSpec(1024), 2).collect()])
def peak(batches):
    for _ in batches:
        yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})
print("MB", spark.range(1).repartition(1).mapInArrow(peak, "mb long").first()["mb"])
"""


def test_long_grams_take_little_memory():
    """Of one task over 33 MB of documents in one partition: Python's part of it (before: the counters, batches of all 33 MB,
    and parts of 4 MB with numbers for each window)."""
    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=600)
    said = dict(line.split(" ", 1) for line in done.stdout.splitlines() if line.startswith(("TOP ", "MB ")))
    assert said["TOP"] == str([(b"ab", 1024, 7), (b"ba", 1024, 7)]), done.stderr[-2000:]
    assert int(said["MB"]) < 400


def test_only_split_documents_are_made_distinct(docs):
    spec = GramSpec(4)
    rows = corpus.split_large(docs.filter("doc_id IS NOT NULL AND doc_id <> 7"), 200, 3)
    whole, split = counts.divided(rows, spec, True)
    assert split.count() == sum(-(-(len(t) - 3) // 200) for k, t in TEXTS.items() if t and len(t) > 203 and k != 7) and whole.filter("chunks > 1").isEmpty()
    one = docs.filter("doc_id IS NOT NULL AND doc_id <> 7")
    for count, key in ((counts.bucket_counts, "bucket"), (counts.gram_counts, "gram"), (lambda *a, **b: jobs.exact_top_grams(a[0], a[1], 50, **b), "gram")):
        as_map = lambda df, key=key: {str(r[key]): r.cnt for r in df.collect()}
        assert as_map(count(rows, spec, chunked=True)) == as_map(count(one, spec))
        assert as_map(count(rows.drop("chunks"), spec, chunked=True)) == as_map(count(one, spec))


def test_counters_that_fill_up(spark, docs):
    slabs = scan.counter_slabs(docs, GramSpec(2)).collect()
    total = sum(int(scan.slab_counts(r["places"], r["counts"])[1].sum()) for r in slabs)
    assert total == sum(max(0, len(t or b"") - 1) for t in [*TEXTS.values(), TEXTS[8], TEXTS[7], TEXTS[9]])
    for some, largest in ((0, 0), (100, 5), (60_000, 2**31), (65_536, 2**40), (9, 2**40)):
        counts_ = np.zeros(1 << scan.SLAB_BITS, np.int64)
        counts_[:some] = largest
        at, held = scan.slab_counts(*(scan._slab(3, counts_).column(c)[0].as_py() for c in ("places", "counts")))
        back = np.zeros_like(counts_)
        back[at] = held
        assert (back == counts_).all()


@pytest.mark.parametrize("exact", [True, False])
def test_profiles_of_any_size(spark, docs, exact, tmp_path):
    """As if ten rows were too many for a task."""
    for ties, k in (("cut", 60), ("keep", 25)):
        small = jobs.select_grams(docs, 3, k, exact=exact, ties=ties)
        large = jobs.select_grams(docs, 3, k, exact=exact, ties=ties, most=10)
        assert sorted(map(str, small.rows.collect())) == sorted(map(str, large.rows.collect())) and small.facts() == large.facts()
    profile.save_profile(large, str(tmp_path / "p"))
    again = profile.load_profile(spark, str(tmp_path / "p"))
    for values in ("binary", "counts"):
        plain = vectors.vectorize(docs.withColumn("kind", F.lit("x")), small, values)
        joined = vectors.vectorize(docs.withColumn("kind", F.lit("x")), again, values, most=10)
        assert plain.columns == joined.columns and sorted(map(str, plain.collect())) == sorted(map(str, joined.collect()))
    assert sorted(map(str, vectors.vectorize(docs, small, part=(3, 50)).collect())) == sorted(map(str, vectors.vectorize(docs, large, part=(3, 50), most=10).collect()))


def test_lz_profile_of_any_size(docs):
    small, large = jobs.select_lz(docs, 30), jobs.select_lz(docs, 30, most=10)
    assert sorted(map(str, small.rows.collect())) == sorted(map(str, large.rows.collect()))
    assert sorted(map(str, vectors.vectorize(docs, small).collect())) == sorted(map(str, vectors.vectorize(docs, large, most=10).collect()))


def test_numbers_and_first_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("bucket"), (F.col("id") % 13).alias("cnt")).repartition(6)
    got = [(r.bucket, r.number) for r in topk.numbered(rows, "number", F.col("bucket")).collect()]
    assert sorted(got) == [(k, k) for k in range(1000)]
    for k in (1, 77, 78, 5000):
        want = sorted(((r.cnt, r.bucket) for r in rows.collect()), key=lambda x: (-x[0], x[1]))[:k]
        assert sorted((r.cnt, r.bucket) for r in topk.first_rows(rows, k, "bucket").collect()) == sorted(want)
    assert topk.first_rows(rows.limit(0), 5, "bucket").collect() == []


FILES = {
    "a.bin": b"plain text", "sub/b.gz": gzip.compress(b"packed " * 300) + b"\0" * 20 + gzip.compress(b"twice"), "sub/deep/c.gz": gzip.compress(random.Random(1).randbytes(900))[:-9], "d": b"\x1f\x8b", "e": b"\x1f\x8b\x09rest",
    "f": b"\x1f\x8b\x08broken", "_under/_score": b"x" * 1000, ".dot": b"0123456789" * 50, "empty": b"", "g.gz": gzip.compress(b"abc" * 400) + b"rubbish", "exact": b"y" * 130,
}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for name, content in FILES.items():
        os.makedirs((root / name).parent, exist_ok=True)
        (root / name).write_bytes(content)
    return root


@pytest.mark.parametrize("limit", [64, 1 << 20])
def test_files_in_ranges(spark, files, limit):
    """Several ranges count as one; all names are there; what can't be read or unpacked is a reject."""
    rows = ranges.read_ranges(spark, str(files), 2, limit, 500).cache()
    good, rejects = ranges.without_rejects(rows)
    name = lambda path: os.path.relpath(path, files)
    assert {name(r.doc_id) for r in rejects.collect()} == {"sub/deep/c.gz", "f", "g.gz"}
    want = {k: v for k, v in FILES.items() if k not in ("sub/deep/c.gz", "f", "g.gz")} | {"sub/b.gz": b"packed " * 300 + b"twice"}
    found: dict = {}
    for r in good.orderBy("doc_id", "chunk_no").collect():
        own = found.setdefault(name(r.doc_id), bytearray())
        assert len(own) in (0, r.chunk_no * limit + 2) and len(r.content) <= limit + 2
        own += r.content[2 if r.chunk_no else 0 :]
        assert r.chunks == max(1, -(-(len(want[name(r.doc_id)]) - 2) // limit))
    assert {k: bytes(v) for k, v in found.items()} == want
    for mode in ("documents", "occurrences"):
        total = Counter()
        for t in want.values():
            each = [t[k : k + 3] for k in range(len(t) - 2)]
            total.update(set(each) if mode == "documents" else each)
        assert {bytes(r.gram): r.cnt for r in counts.gram_counts(good, GramSpec(3, count_mode=mode), chunked=True).collect()} == total
    rows.unpersist()


@pytest.mark.parametrize("limit", [50, 700])
def test_unpacked_in_rows(spark, limit):
    """A content larger than a row may be, when unpacked, is several rows, and counts the same."""
    rng = random.Random(3)
    texts = [b"", b"a" * 51, b"a" * 52, bytes(rng.choices(b"ab", k=5000)), b"abc" * 20]
    packed = [(k, bytearray(gzip.compress(t))) for k, t in enumerate(texts)] + [(9, bytearray(texts[3])), (10, bytearray(gzip.compress(texts[3])[:-3]))]
    good, rejects = corpus.decode_gzip(spark.createDataFrame(packed, "doc_id long, content binary"), limit, 2)
    assert [r.doc_id for r in rejects.collect()] == [10] and good.filter(F.length("content") > limit + 2).isEmpty()
    total = Counter()
    for t in [*texts, texts[3]]:
        total.update({t[k : k + 3] for k in range(len(t) - 2)})
    assert {bytes(r.gram): r.cnt for r in counts.gram_counts(good, GramSpec(3), chunked=True).collect()} == total
    assert {r.doc_id: r.chunks for r in good.collect()} == {k: max(1, -(-(len(t) - 2) // limit)) for k, t in enumerate(texts)} | {9: -(-4998 // limit)}


def test_unreadable_range_spoils_its_file(spark, files):
    """A file that is gone or has become shorter gives a row with an error; the rest of it goes, too."""
    reader = ranges.RangeReader({"path": str(files), "limit": "64"})
    store, _ = ranges.opened(str(files))
    assert [(r[2], bool(r[3])) for name, size in (("gone", 5), ("exact", 140)) for r in reader.rows(store, str(files / name), size, 2 if size > 5 else 0, 3)] == [(None, True)] * 2
    rows = spark.createDataFrame([("x", 0, 2, b"a", None), ("x", 1, 2, None, "gone"), ("y", 0, 1, b"b", None), ("z", 0, 1, None, "gone")], ranges.SCHEMA)
    good, rejects = ranges.without_rejects(rows)
    assert [r.doc_id for r in good.collect()] == ["y"] and {r.doc_id for r in rejects.collect()} == {"x", "z"}


def test_inflate_in_small_pieces():
    text = b"z" * 100_000 + random.Random(2).randbytes(5000)
    raw = gzip.compress(text) + gzip.compress(b"") + gzip.compress(text)
    for step in (1, 7, 1 << 20):
        pieces = list(ranges.inflate((raw[k : k + step] for k in range(0, len(raw), step)), 1000))
        assert b"".join(pieces) == text * 2 and max(map(len, pieces)) <= 1000


def test_phrases_in_step():
    """The same as a document alone, whatever the lengths; a set that is asked for many keys at once."""
    rng = random.Random(9)
    for lengths in ([], [0], [5000], [3, 0, 200, 200, 7], [rng.randrange(300) for _ in range(200)] + [20_000]):
        texts = [bytes(rng.choices(b"ab\x00c", k=k)) for k in lengths]
        offsets = np.cumsum([0, *map(len, texts)])
        for only in (False, True):
            got, doc = lz.lz_hashes_of(np.frombuffer(b"".join(texts), np.uint8), offsets, only)
            want = [lz.lz_hashes(t, only) for t in texts]
            assert got.tolist() == [x for w in want for x in w.tolist()] and doc.tolist() == [k for k, w in enumerate(want) for _ in w]
    seen, known = lz.Seen(300), set()
    for _ in range(30):
        keys = np.array(rng.sample(range(1, 400), 50), np.uint64)
        assert seen.add(keys).tolist() == [k not in known for k in keys.tolist()]
        known |= set(keys.tolist())


@pytest.mark.parametrize("mode", ["documents", "occurrences"])
def test_bounds_are_guaranteed(docs, mode):
    spec = GramSpec(3, count_mode=mode)
    want = {bytes(r.gram): r.cnt for r in counts.gram_counts(docs, spec).collect()}
    for room in (1, 6, 10**4):
        found = {bytes(r.gram): (r.lower, r.upper) for r in sketch.heavy_grams(docs, spec, room).collect()}
        error = sum(want.values()) // (room + 1)
        assert len(found) <= room and all(a <= want[g] <= b <= a + error for g, (a, b) in found.items())
        assert {g for g, c in want.items() if c > error} <= set(found)
    assert {g: a for g, (a, _) in found.items()} == want
    assert sketch.heavy_grams(docs.limit(0), spec, 5).collect() == []


def test_summaries_in_a_tree(docs):
    """Many tasks, two at a time: no summary is larger than the room, and the error is what was taken away."""
    spec, room = GramSpec(3), 5
    rows = sketch.gram_summaries(docs.repartition(11), spec, room)
    assert rows.count() == 11
    row = sketch.merged_summary(rows, room, 2).collect()
    want = counts.gram_counts(docs, spec).agg(F.sum("cnt")).first()[0]
    assert len(row) == 1 and row[0].total == want and len(row[0].one) <= room and row[0].error <= want // (room + 1)


def test_compacting_store(spark, docs, tmp_path):
    spec, path = GramSpec(3), str(tmp_path / "store")
    assert fed.totals(spark, path).collect() == []
    named = docs.filter("doc_id IS NOT NULL")
    for k in [*range(12), 5, 11, 0]:
        fed.feed(named.filter(F.col("doc_id") % 12 == k), spec, path, f"b{k}" if k % 3 else str(k))
    last = fed.manifest(spark, path)
    rows = [s["rows"] for s in last["segments"]]
    assert last["number"] == 12 and rows == sorted(rows, reverse=True) and len(rows) < 7
    assert last["ranges"] == [[0, 0], [3, 3], [6, 6], [9, 9]] and len(last["names"]) == 8
    whole = {r.bucket: r.cnt for r in counts.bucket_counts(named, spec).collect()}
    assert {r.bucket: r.cnt for r in fed.totals(spark, path).collect()} == whole
    kept = set(os.listdir(tmp_path / "store" / "segments"))
    assert {s["name"] for s in last["segments"]} <= kept and len(kept) <= len(rows) + len(last["gone"])


def test_feed_that_fails_counts_nothing(spark, docs, tmp_path, monkeypatch):
    spec, path = GramSpec(3), str(tmp_path / "store")
    fed.feed(docs.limit(5), spec, path, "one")
    before = sorted(map(tuple, fed.totals(spark, path).collect()))
    with monkeypatch.context() as m:
        m.setattr(fed, "_swap", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            fed.feed(docs, spec, path, "two")
    assert sorted(map(tuple, fed.totals(spark, path).collect())) == before
    with pytest.raises(RuntimeError):  # another feed was faster
        fed._swap(spark, path, fed.manifest(spark, path))
    fed.feed(docs, spec, path, "two")
    assert fed.totals(spark, path).agg(F.sum("cnt")).first()[0] > sum(c for _, c in before)


def test_ml_vectors_without_a_row_function(docs):
    chosen = jobs.select_grams(docs, 3, 20)
    typed = vectors.to_ml_vectors(vectors.vectorize(docs.withColumn("kind", F.lit("x")), chosen, "counts"))
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "MapInArrow" in plan
    from pyspark.ml.feature import Normalizer

    assert Normalizer(inputCol="features", outputCol="unit").transform(typed).count() == docs.count()


def test_what_is_stored_can_go(spark):
    kept = shared.stored(spark.range(3), "three")
    path = kept.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert kept.count() == 3 and os.path.exists(path)
    other = shared.place(spark, "other")
    shared.remove_stored(spark)
    assert not os.path.exists(path) and other != shared.place(spark, "other")
