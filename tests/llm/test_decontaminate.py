import random
import re

import pytest

from bytegrams.llm import decontaminate as dec


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) if w]


def brute(docs, items, n=10):
    grams = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1) if w else []:
            grams.setdefault(tuple(w[a : a + k]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = words(t)
        hit, named = set(), set()
        for k in {len(g) for g in grams}:
            for a in range(len(w) - k + 1):
                if (g := tuple(w[a : a + k])) in grams:
                    hit.update(range(a, a + k))
                    named |= grams[g]
        out.append((i, len(w), len(hit), len(named), tuple(sorted(named)), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [200_000, 5])
def test_brute_force(spark, most):
    rng = random.Random(3)
    word = lambda k: [rng.choice("abcdefgh") + str(rng.randrange(3)) for _ in range(k)]
    items = [(k, ", ".join(word(rng.randrange(1, 30)))) for k in range(30)] + [(100, None), (101, "..."), (102, "Short ONE"), (102, "short one"), (103, "x"), (None, "q r s t u v w x1 y z a b"), (104, "é ü")]
    docs = []
    for k in range(60):
        w = word(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(w) + 1)
            w[i:i] = words(rng.choice(items)[1])
        docs.append((k, " ".join(w).upper() if k % 2 else "-".join(w)))
    docs += [docs[0], docs[0], (None, docs[1][1]), (0, "other"), (70, None), (71, ""), (72, "É short. one! É ü x"), (73, "\x7f" * 10)]
    d = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, row int, items string").repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, size int")
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    got = dec.decontaminate(d, b.filter("item_id IS NOT NULL"), max_grams=most).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"]), r.contaminated) for r in got), key=str) == want
    clean = dec.keep_clean(d, b.filter("item_id IS NOT NULL"), max_grams=most)
    bad = {i for i, *_, c in want if c}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - bad and clean.columns == d.columns
    nothing = dec.decontaminate(d, b.limit(0)).collect()
    assert len(nothing) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in nothing)
    assert dec.decontaminate(d.limit(0), b).count() == 0


@pytest.mark.parametrize("most", [200_000, 0])
def test_clean_rows_stay(spark, most):
    """One contaminated row takes no other row of null id or of its own id with it."""
    bad, clean = "a b c d e f g h i j k l", "nothing of it"
    rows = [(None, bad), (None, clean), (None, clean), (None, None), (3, bad + " m"), (3, clean), (3, "else"), (4, bad)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_hit int").repartition(3)
    kept = dec.keep_clean(docs, spark.createDataFrame([(1, bad)], "item_id long, text string"), max_grams=most)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in rows if not (t or "").startswith(bad)), key=str)


def test_large_benchmark(spark):
    """300,000 windows in one plan: only windows of the benchmark, and few others, are rows before the join."""
    some = random.Random(5)
    text = " ".join(f"w{some.randrange(40_000)}" for _ in range(300_100))
    part = text.split()[1000:1030]
    docs = spark.createDataFrame([(k, " ".join(f"w{some.randrange(40_000)}" for _ in range(500))) for k in range(40)] + [(100, "w1 " + " ".join(part) + " w2")], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([("big", text)], "item_id string, text string")
    got = {r.doc_id: r for r in dec.decontaminate(docs, b).collect()}
    assert [i for i, r in got.items() if r.contaminated] == [100]
    assert got[100].n_hit >= 30 and got[100].n_words == 32 and got[100]["items"] == ["big"]
    grams = dec.cut(dec.benchmark_grams(b))
    asked = docs.select(dec.words_of(dec.F.col("text")).alias("words"), dec.bit_map(grams, 26).alias("held"))
    rows = asked.select(dec.F.explode(dec.hit_positions(dec.F.col("words"), [10], dec.F.col("held"), 26))).count()
    assert 21 <= rows < 21 + 40 * 491 // 10


def test_long_text(spark):
    """A text of a million words is searched whole."""
    items = spark.createDataFrame([("a", "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "y " * 1_000_000 + "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10")], "doc_id long, text string")
    (r,) = dec.decontaminate(docs, items).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (1_000_010, 10, 1)
