import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from bytegrams.llm import toxicity as tox
from bytegrams.llm.queries import op4_toxicity


def corpus(n=900, seed=5):
    """Invented texts; a quarter are toxic: some by seeds, some by words of a family that only labels show."""
    rng = random.Random(seed)
    plain = ["w%s" % "".join(rng.choice("aeiourtnsl") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "scum", "moron"]) if k % 2 else "zork" + rng.choice("abcdefgh") + rng.choice("xyz"))
        docs.append((k, " ".join(w)))
        if rng.random() < 0.7:
            labels.append((k, int(toxic)))
    return docs, labels, [int(any(w.startswith(("zork", "idiot", "scum", "moron")) for w in t.split())) for _, t in docs]


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    extra = [(None, None), (5000, None), (5001, ""), (5002, "idiot " * 5000), (0, docs[0][1])]
    d = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs + extra], "doc_id long, text string, toxic int, lang string, score double").repartition(4)
    la = spark.createDataFrame([(i, y, "z") for i, y in labels] + [(None, 1, "z"), (3, None, "z"), (9999, 1, "z")], "doc_id long, toxic int, text string")
    rows = tox.score_toxicity(d, la).collect()
    assert len(rows) == len(docs) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in docs)
    held = [(by[i].predicted, truth[i]) for i, _ in docs if by[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert by[5002].predicted == 1 and by[5000].predicted == by[5001].predicted == 0
    kept = tox.keep_clean(d, la)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    one = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = one.withColumn("toxic", F.when(tox.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in tox.score_toxicity(d, x).collect()} for x in (one, turned))
    assert a == b


def test_nothing_to_learn(spark):
    d = spark.createDataFrame([(1, "you idiot, idiot"), (2, "fine words"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.doc_id: r.predicted for r in tox.score_toxicity(d, none).collect()} == {1: 1, 2: 0, 3: 0}
    assert tox.score_toxicity(d.limit(0), none).count() == 0


def test_words_are_counted_whole():
    vote = lambda t: dict(zip(tox.VOTERS, tox.evidence(t, tox.Lexicon()), strict=False))
    assert vote("kill skill skills")["seed_twice"] == 0 and vote("kill, Kill")["seed_twice"] == 1
    x = tox.Lexicon({}, {}, {"zork": 2.0})
    one = lambda t: tox.evidence(t, x)[tox.VOTERS.index("family")]
    assert one("zorka zorkb zorka zork") == 0 and one("zorka zorkb Zorkc") == 1
    few = tox.Voters(x)
    texts = [" ".join(f"zork{k + j}" for j in range(k % 5)) for k in range(300)]
    assert all((few(t) == tox.evidence(t, x)).all() for t in texts + texts)


def test_labels_of_no_worth_change_nothing():
    rng = np.random.default_rng(1)
    post, toxic = rng.random(5000), (rng.random(5000) < 0.2).astype(float)
    assert np.abs(tox.with_labels(post, toxic) - post).max() < 0.05
    right = (post > 0.5).astype(float)
    assert (tox.with_labels(post, right)[right > 0] >= post[right > 0]).all()


def test_sample_is_bounded(spark):
    """One labelled id with very many texts: no more than ``sample`` rows are taken, and repeats once."""
    k = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.range(3000).selectExpr(f"{k}L AS doc_id", "concat('text ', id % 1000) AS text")
    labels = spark.createDataFrame([(k, 1), (k, 0), (k + 1, 0)], "doc_id long, toxic int")
    rows = tox.labelled_texts(docs, labels, tox.Settings()).collect()
    assert len(rows) == 1000 and {r.toxic for r in rows} == {1}
    assert tox.labelled_texts(docs, labels, tox.Settings(sample=50)).count() == 50


def test_held_out_recall(spark):
    """A tenth of the larger table's labels is noise in junk texts, which bounds the recall."""
    d, la = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = tox.score_toxicity(d, la).filter("held_out").join(la, "doc_id").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("found")).collect()
    by = {r.toxic: (r.found, r.n) for r in rows}
    assert by[1][1] > 100 and by[1][0] >= 0.9 * by[1][1] and by[0][0] <= 0.01 * by[0][1]


def test_label_model_finds_accuracies():
    """Votes drawn from a known model: posteriors agree with the truth, and a copied voter counts once."""
    rng = np.random.default_rng(0)
    m = len(tox.VOTERS)
    y = rng.random(20_000) < 0.2
    hit, false = np.r_[[0.8] * 5, [0.6] * (m - 5)], np.r_[[0.02] * 5, [0.1] * (m - 5)]
    bits = rng.random((len(y), m)) < np.where(y[:, None], hit, false)
    bits[:, 1] = bits[:, 0]
    votes = (bits << np.arange(m)).sum(1)
    patterns, counts = np.unique(votes, return_counts=True)
    model = tox.LabelModel(patterns, counts.astype(float), {}, tox.Settings())
    assert np.mean((model.of(votes) > 0.5) == y) > 0.97
    assert any({q, k} == {0, 1} for q, k in zip(model.parents[1], range(m), strict=True))


def test_shouting_reads_the_whole_text():
    calm, loud = "some calm words that go on and on. ", "SOME LOUD WORDS THAT GO ON AND ON! "
    vote = lambda t, name="shouting": tox.evidence(t, tox.Lexicon())[tox.VOTERS.index(name)]
    assert vote(calm * 60 + loud * 100) == 1 and vote(loud * 60 + calm * 100) == 0
    assert vote(calm * 3000 + "noooo", "stretched") == 1 and vote(calm + "nooo 1111", "stretched") == 0
    assert vote(calm * 3000 + "b**d", "masked") == 1 and vote(calm + "* b* *d # $", "masked") == 0
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("aaaB*$1 éÉßǅⅠⒶ文😀ʰ") for _ in range(rng.randrange(30)))
        assert tox.writing(text)[1] == any(a.isalpha() and text[k : k + 4] == 4 * a for k, a in enumerate(text)), text
        assert tox.writing(text)[2] == any(a.isalpha() and b.isalpha() for a, b in re.findall(r"(?=(.)[*#$]+([^*#$]))", text)), text
        assert tox.is_shouting(text) == (sum(c.isupper() for c in text) > 0.5 * sum(c.isalpha() for c in text)), text


def test_long_words_vote(spark):
    """Words beyond 40 letters are learned whole: one of the same beginning and other ending has no vote."""
    bad, good = "文" * 60 + "甲", "文" * 60 + "乙"
    rows = [(k, f"{bad} b{'xyz'[k % 3] * (k % 7)} {k}" if k % 2 else f"{good} {k}", k % 2) for k in range(300)]
    lexicon = tox.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), tox.Settings())
    word = tox.VOTERS.index("word")
    assert tox.evidence(f"a {bad}.", lexicon)[word] == 1 and tox.evidence(f"a {good}.", lexicon)[word] == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = op4_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.predicted for r in clean) <= 0.05 * len(clean)
