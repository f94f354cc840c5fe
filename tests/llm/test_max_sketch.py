import math
import random
import re
from collections import Counter

import pytest

from bytegrams.llm import max_sketch as ms

DOCS, ITEMS = "doc_id long, text string, q string, one int, score int", "item_id string, text string, q int, term string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_all, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * n_all // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, math.inf if d is None else d, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


def made(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["Éa", "日本", "A1", "x_y"]
    text = lambda m: " ".join(rng.choice(words) + rng.choice(["", ",", "-"]) for _ in range(m))
    docs = [(k, text(rng.randrange(60))) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(40)] + [(3, docs[3][1]), (3, "other w1 w2"), (None, docs[9][1]), (None, None), (900, ""), (901, "?!"), (902, text(20_000))]
    items = [(str(k), text(rng.randrange(30))) for k in range(20)] + [("hot", docs[7][1]), ("same", "w1 w2"), ("same", "w3"), (None, "w1"), ("null", None), ("none", "unheard"), ("long", text(3000))]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, "c", 1, 1) for d, t in docs], DOCS).repartition(6), spark.createDataFrame([(i, t, 1, "c") for i, t in items], ITEMS)


@pytest.mark.parametrize("block", [512, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    """Copies, repeated rows, null ids, texts without terms; queries in one block and in several."""
    monkeypatch.setattr(ms, "BLOCK", block)
    docs, items = made(1)
    got = sorted((tuple(r) for r in ms.search(*frames(spark, docs, items)).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain(docs, items, 10)


def test_few_known_weights_and_narrow_sketches(spark, monkeypatch):
    """Bounds stay bounds where most terms' weights aren't known to the index, and where terms share coordinates."""
    monkeypatch.setattr(ms, "MOST_TERMS", 5)
    docs, items = made(2, 150)
    got = sorted((tuple(r) for r in ms.search(*frames(spark, docs, items), k=3, bits=4).collect()), key=str)
    assert got == plain(docs, items, 3)


def test_no_rows(spark):
    docs, items = frames(spark, *made(3, 20))
    assert ms.search(docs.limit(0), items).collect() == []
    assert ms.search(docs, items.limit(0)).collect() == []
