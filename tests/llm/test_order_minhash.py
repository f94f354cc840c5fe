import hashlib
import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from bytegrams.llm import order_minhash as omh
from bytegrams.llm.queries import op8_order_minhash


def xx(*values):
    """Spark's xxhash64 of strings, longs and ints (as 1-tuples), one after the other."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", *v) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_fingerprint(text, k=2, sketches=64, bits=24):
    """Order MinHash as stated: minimal numbered k-mers of each bin, two bins a sketch, in text order."""
    pieces = [xx(p) for p in re.findall(r"[^\x20\x09-\x0d]{1,8}", text or "")]
    kmers = [xx(*pieces[i : i + k]) for i in range(max(1, len(pieces) - k + 1))] if pieces else []
    seen, least = {}, {}
    for place, h in enumerate(kmers):
        h &= (1 << 63 - bits) - 1
        n = seen[h] = seen.get(h, -1) + 1
        value = (xx(h, (n,)) & (1 << 63) - 1) >> bits
        b = value >> 56 - bits
        least[b] = min(least.get(b, (1 << 63, 0)), (value, place))
    out = []
    for j in range(sketches):
        two = sorted((least[b] for b in (2 * j, 2 * j + 1) if b in least), key=lambda x: x[1])
        out.append(f"{xx(*(v for v, _ in two)) & 0xFFFF:04x}" if two else "----")
    return out


def brute(rows):
    """rows (doc_id, text) -> sorted (doc_id, text, edited, next text)."""
    key = lambda i, t: (-(2**63) if i is None else i, xx(t or ""))
    order = sorted({(*key(i, t), t or "") for i, t in rows}, reverse=True)
    out = []
    for i, t in rows:
        k, t = order.index((*key(i, t), t or "")), t or ""
        nxt = order[(k + 1) % len(order)][2]
        h = len(t) // 2
        out.append((str(i), t, t[: len(t) - h] + nxt[:h], nxt))
    return sorted(out)


def run(spark, rows, parts):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, next_text string, half int").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = omh.with_next(omh.texts(docs).withColumn("whole", F.col("text")), ["whole"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(r.next_text == r.next_whole[: len(r.text) // 2] for r in got)
    return sorted((str(r.doc_id), r.text, r.text[: len(r.text) - len(r.text) // 2] + r.next_text, r.next_whole) for r in got)


def test_next_document(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), "é" * rng.randrange(5) + str(k)) for k in range(100)] + [(None, "n"), (None, None), (7, None), (-5, "neg"), (9, "same"), (9, "same"), (9, "same")]
    for parts in (1, 3, 20):
        assert run(spark, rows, parts) == brute(rows)
    assert run(spark, [(1, "alone")], 4) == brute([(1, "alone")])
    assert run(spark, [(1, "a"), (1, "a")], 4) == brute([(1, "a"), (1, "a")])
    assert omh.edit_test(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_are_shuffled_once(spark, sf_dir):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = op8_order_minhash(spark, sf_dir)
    assert rows.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") >= 1


def test_as_stated(spark):
    rng = random.Random(5)
    cases = ["", " \n", "one", "the the the the", "é😀" * 30, "x" * 5000, *(" ".join(rng.choice(["a", "bb", "ccc", "é", "longer than eight", f"w{rng.randrange(300)}"]) for _ in range(rng.randrange(600))) for _ in range(40))]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for k in (1, 2, 3):
        got = {r.doc_id: r.fingerprint for r in omh.fingerprint_documents(docs, k=k).collect()}
        assert got == {i: plain_fingerprint(t, k) for i, t in enumerate(cases)}


def test_texts_of_many_pieces(spark, monkeypatch):
    """As if 50 pieces were too many for 24 bits; columns of the names that are used inside stay."""
    monkeypatch.setattr(omh, "LONG", 50)
    rng = random.Random(6)
    cases = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 49, 50, 51, 3000)]
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(cases)], "doc_id long, text string, kmers int, at string")
    rows = omh.fingerprints(docs, "text", "fingerprint").collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: plain_fingerprint(t, bits=31 if len(t.split()) >= 50 else 24) for k, t in enumerate(cases)}
    assert all((r.kmers, r.at) == (7, "x") for r in rows)


def test_selects_minimal_and_keeps_order(spark):
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(1)
    shuffled = words[:]
    rng.shuffle(shuffled)
    few = words[:]
    for k in range(0, 400, 40):
        few[k] = "other"
    cases = [" ".join(words), "  ".join(words) + "\n", " ".join(few), " ".join(shuffled), " ".join(words[200:] + words[:200]), "", None, "one", "the the the the", "the the the", "x" * 100_000]
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    fp = {r.doc_id: r.fingerprint for r in omh.fingerprint_documents(docs, k=1).collect()}
    like = lambda a, b: sum(x == y != "----" for x, y in zip(fp[a], fp[b], strict=True)) / max(1, sum((x, y) != ("----", "----") for x, y in zip(fp[a], fp[b], strict=True)))
    assert fp[0] == fp[1] and like(0, 2) > 0.8
    # same set of words, other order: about half of the tuples turn round; a swap of halves turns half of them too
    assert 0.3 < like(0, 3) < 0.7 and 0.3 < like(0, 4) < 0.7
    assert fp[5] == fp[6] == ["----"] * 64 and fp[7].count("----") == 63
    assert fp[8] != fp[9]  # occurrences are numbered


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len(t), hashlib.sha256(e.encode()).hexdigest(), n) for i, t, e, n in brute(rows)}
    edited, following = {i: e for i, _, e, _ in brute(rows)}, {i: n for i, *_, n in brute(rows)}
    got = op8_order_minhash(spark, sf_dir).collect()
    texts = dict(rows)
    by_text = {}
    for r in got:
        n, digest, _ = want[str(r.doc_id)]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert r.fingerprint == "".join(plain_fingerprint(texts[r.doc_id])) and r.edited_fingerprint == "".join(plain_fingerprint(edited[str(r.doc_id)]))
        share = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True) if (x, y) != ("----", "----")) / max(1, sum((x, y) != ("----", "----") for x, y in zip(a, b, strict=True)))
        own = plain_fingerprint(texts[r.doc_id])
        assert r.near_edited == share(own, plain_fingerprint(edited[str(r.doc_id)])) and r.near_next == share(own, plain_fingerprint(following[str(r.doc_id)]))
    assert len(got) == len(rows)
    longer = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in longer) > 0.95 * len(longer)
