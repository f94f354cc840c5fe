import hashlib
import random

from bytegrams.llm import substrings as sub
from bytegrams.llm.queries import op5_substring_dedup


def brute(rows, window=50):
    first = {}
    split = [(2**63 - 1 if i is None else i, [w.decode() for w in (t or "").encode().split()]) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i if i < 2**63 - 1 else None, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, content int, runs string").repartition(3)
    return sorted(map(tuple, sub.dedup_substrings(docs).collect()), key=str)


def test_difference_cover():
    for shift in range(sub.PERIOD):
        assert any((c + shift) % sub.PERIOD in sub.COVER for c in sub.COVER)


def test_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(n)]
    hot = word(70)
    rows = []
    for k in range(60):
        text = word(rng.randrange(0, 120)) + hot[rng.randrange(25) : rng.randrange(45, 70)] + word(rng.randrange(90))
        if k % 7 == 0:
            text = word(3) + hot + hot + word(2)
        rows.append((rng.randrange(80), "\t \n".join(text) if k % 5 else " ".join(text) + "  "))
    rows += [rows[3], rows[3], (500, rows[3][1]), (501, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (7, None), (8, ""), (9, " \n"), (10, "same " * 300), (11, "same " * 200), (12, "é" * 5000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, "a b")]) == brute([(1, "a b")])
    assert sub.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_largest_and_smallest_ids(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(2**63 - 1, text), (-(2**63), text), (5, "one two")]
    got = {r.doc_id: r.n_removed for r in sub.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2**63 - 1: 80, -(2**63): 0, 5: 0}
    lone = [(2**63 - 1, text), (None, "x y")]
    assert {r.doc_id for r in sub.dedup_substrings(spark.createDataFrame(lone, "doc_id long, text string")).collect()} == {2**63 - 1, None}


def test_texts_are_shuffled_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = op5_substring_dedup(spark, sf_dir)
    assert rows.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, x, hashlib.sha256(t.encode()).hexdigest()) for i, n, x, t in brute(rows))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op5_substring_dedup(spark, sf_dir).collect()) == want
