import random

import numpy as np

from bytegrams.llm import fast_similarity as fs
from tests.llm.test_jaccard import shingles

COLUMNS = "doc_id long, text string, node string, kept int"


def plain(rows):
    """doc_id -> (n_shingles, component_id, kept)."""
    sets = {d: shingles(t, 4) for d, t in rows}
    least = {d: d for d in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def families(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randrange(30))
    rows, k = [], 0
    for length in (0, 1, 2, 3, 4, 5, 8, 12, 20, 40, 90, 300, 2000):
        for _ in range(4):
            base = [word() for _ in range(length)]
            for edits in (0, 0, 1, 2, 5):
                own = list(base)
                for _ in range(min(edits, length)):
                    own[rng.randrange(length)] = word()
                rows.append((k, " ".join(own).title() if edits == 1 else "\t".join(own)))
                k += 1
    return rows


def test_equals_all_pairs(spark):
    rows = families(3)
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], COLUMNS).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in fs.near_duplicates(docs).collect()}
    assert got == plain(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """More rows than are compared at once, cut into pieces, exact copies among them."""
    monkeypatch.setattr(fs, "PIECE", 50)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(300):
        own = list(base)
        for _ in range(d % 4):
            own[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((d, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in fs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows)


def test_sketch_is_likeness():
    """Coordinates of every set fill; agreements are as many as the likeness says, for small and large sets."""
    rng = np.random.default_rng(7)
    for size in (1, 2, 5, 10, 100, 3000):
        shared = round(size * 0.8 * 2 / 1.8)
        found = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - shared :])
            doc = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
            s = fs.sketches(doc, np.r_[a, b], 2)
            assert (s != fs.EMPTY).all()
            found.append((s[0] == s[1]).mean())
        like = shared / (2 * size - shared)
        assert abs(np.mean(found) - like) < 0.03
        assert np.std(found) < 0.05


def test_round_by_round_definition():
    """The same as filling coordinate by coordinate in plain Python."""
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 9, dtype=np.uint64))
    mask, low = (1 << 64) - 1, (1 << 56) - 1
    mix = lambda x: int(fs.kn.mix(np.array([x & mask], np.uint64))[0])
    t, plain_sketch = fs.COORDINATES, [None] * fs.COORDINATES
    for k in range(2 * t):
        placed = {}
        for x in h.tolist():
            y = mix(x ^ int(fs.ROUNDS[k]))
            c = y >> 57 if k < t else k - t
            placed[c] = min(placed.get(c, mask), k << 56 | y & low)
        for c, v in placed.items():
            plain_sketch[c] = v if plain_sketch[c] is None else plain_sketch[c]
        if None not in plain_sketch:
            break
    assert fs.sketches(np.zeros(9, int), h, 1)[0].tolist() == plain_sketch


def test_nulls_ties_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, None), (7, ""), (None, "z z"), (2**63 - 1, "Z z"), (-(2**63), "q")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in fs.near_duplicates(docs).collect())
    big, small = 2**63 - 1, -(2**63)
    assert got == sorted([(0, 2, 5, False), (5, 2, 5, True), (5, 0, 5, True), (7, 0, 7, True), (0, 1, big, False), (big, 1, big, True), (small, 1, small, True)])
    assert fs.near_duplicates(docs.limit(0)).collect() == []
