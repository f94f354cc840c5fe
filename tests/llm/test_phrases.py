import random
import re
from collections import Counter

import pytest

from bytegrams.llm import phrases

COLUMNS = "doc_id long, text string, lang string, phrase string, rank int"


def plain(rows, least, most):
    """(lang, rank, phrase, a, l, r, n, score) in plain Python, from (text, lang)."""
    count, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for k in range(len(words) - size + 1):
                    count[lang, tuple(words[k : k + size])] += 1
    frequent = {x: a for x, a in count.items() if a >= least and len(x[1]) > 1}
    longer = {}
    for (lang, words), a in frequent.items():
        for size in range(2, len(words)):
            for k in range(len(words) - size + 1):
                longer[lang, words[k : k + size]] = max(a, longer.get((lang, words[k : k + size]), 0))
    out = []
    for (lang, words), a in frequent.items():
        if 100 * longer.get((lang, words), 0) >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (count[lang, words[:k]] * count[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), count[lang, words[:k]], count[lang, words[k:]], n[lang]))
    ranked = []
    for lang in {x[0] for x in out}:
        for rank, (_, score, a, phrase, l, r, n_) in enumerate(sorted(x for x in out if x[0] == lang)[:most], 1):
            ranked.append((lang, rank, phrase.decode(), -a, l, r, n_, -score))
    return sorted(ranked)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "né", "a", "b", "c", "x" * 50, "日本"]
    signs = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ? "]
    rows = [("".join(rng.choice(words) + rng.choice(signs) for _ in range(rng.randrange(40))), rng.choice(["en", "fr", None])) for _ in range(n)]
    rows += [("in the a long run of b", "en")] * 30 + [(None, "en"), ("", None), ("one two three " * 9000, "de"), ("und x y", "und")]
    return rows


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(k, t, lang, "clash", 1) for k, (t, lang) in enumerate(rows)], COLUMNS).repartition(parts)


@pytest.mark.parametrize("budget", [500_000, 40])
def test_equals_brute_force(spark, budget):
    """A budget of 40 suffixes makes prefixes of one word, two words and whole suffixes."""
    rows = texts(1)
    got = sorted(map(tuple, phrases.collocations(frame(spark, rows), least=20, most=30, budget=budget).collect()))
    assert got == plain(rows, 20, 30) and len(got) > 60


def test_counts_beyond_64_bits(spark, monkeypatch):
    """The product of counts passes 64 bits; the quotient is exact."""
    big = 3_000_000_019
    every = spark.createDataFrame([("en", ["a"], big), ("en", ["b"], big - 2), ("en", ["a", "b"], big - 5)], "lang string, words array<string>, cnt long")
    sizes = spark.createDataFrame([("en", 10**13 + 7)], "lang string, n long")
    monkeypatch.setattr(phrases, "count_phrases", lambda *_: (every, sizes))
    row = phrases.collocations(spark.createDataFrame([], COLUMNS)).first()
    assert row["score"] == 1000 * (big - 5) * (10**13 + 7) // (big * (big - 2)) and row["phrase"] == "a b"


def test_nothing_frequent_and_no_rows(spark):
    assert phrases.collocations(frame(spark, [("a b c", "en"), (None, None)])).collect() == []
    assert phrases.collocations(spark.createDataFrame([], COLUMNS)).collect() == []
