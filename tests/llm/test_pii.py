import hashlib
import math
import random
import re
import time

from bytegrams.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    """The patterns as stated, one by one."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_as_stated():
    rng = random.Random(5)
    for alphabet in ("a1.@ -", "+1() .-2", "0123456789. -", "é@b.c1+ 4"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
            assert pii.base_spans(text) == plain_spans(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"é {card}.") == [("card", 2, 2 + len(card))]
    assert pii.base_spans("1.2.3.4.5.6.7.8 a@b.c@d.e 0300.1.1.1 0255.1.1.01") == plain_spans("1.2.3.4.5.6.7.8 a@b.c@d.e 0300.1.1.1 0255.1.1.01")


def test_contexts_find_unseen(spark):
    seen = [(k, f"text ends. my mail is u{k}@a.com and more {k}") for k in range(30)]
    odd = [(100, "my mail is someone@localhost and more"), (101, "number 12345 of things"), (102, None), (None, "x@y.zz"), (103, "")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in seen + odd + odd], "doc_id long, text string, kind string, spans int")
    out = {}
    for r in pii.find_pii(docs).collect():
        out.setdefault(r.doc_id, []).append(([tuple(x) for x in r.spans], [tuple(x) for x in r.added]))
    assert out[100] == [([], [("email", 11, 28)])] * 2
    assert out[101] == [([], [])] * 2 and out[102] == out[103] == [([], [])] * 2
    assert out[None] == [([("email", 0, 6)], [])] * 2 and len(out[0]) == 1
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_much_evidence(spark):
    """An unseen instance in 30 patterns that 120 seeds confirm: its confidence is 1 in doubles, and it isn't a seed."""
    rows = [(kind, f"{kind}{k}", f"x{c} y{c}", "") for c in range(30) for kind, k in [("email", k) for k in range(120)]]
    rows += [(None, "someone@localhost", f"x{c} y{c}", "") for c in range(30)]
    # the surer of two kinds wins where both are 1 in doubles
    for kind, n in (("card", 12), ("phone", 10)):
        rows += [(kind, f"{kind}{k}", f"{kind} {c}", "") for c in range(n) for k in range(120)] + [(None, "55-12345", f"{kind} {c}", "") for c in range(n)]
    mentioned = spark.createDataFrame(rows, "kind string, instance string, before string, after string")
    got = {r["instance"]: (r.kind, r.confidence) for r in pii.discover(mentioned, pii.Bootstrap()).collect()}
    assert got == {"someone@localhost": ("email", 1.0), "55-12345": ("card", 1.0)}


def plain_discover(mentioned, settings):
    """The scoring rounds in plain Python: {instance: (kind, confidence)}."""
    edges = set()
    for kind, instance, before, after in mentioned:
        b, a = before.split(" "), after.split(" ")
        found = [before + " _"] * (len(b) == 2) + ["_ " + after] * (len(a) == 2) + [f"{b[-1]} _ {a[0]}"] * bool(b[-1] and a[0])
        edges |= {(p, instance, kind) for p in found}
    of, kinds = {}, {}
    for p, i, k in edges:
        of.setdefault(p, set()).add(i)
        if k:
            kinds.setdefault(i, set()).add(k)
    found = {}
    for _ in range(settings.rounds):
        worth = {}
        for p, instances in of.items():
            for kind in pii.KINDS:
                seeds = sum(kind in kinds.get(i, ()) for i in instances)
                total = seeds + sum(1 - math.exp(found[i, kind]) for i in instances if (i, kind) in found)
                if seeds >= settings.support and total / (len(instances) + 1) >= settings.confident:
                    worth[p, kind] = total / (len(instances) + 1)
        found = {}
        for (p, kind), x in worth.items():
            for i in of[p] - kinds.keys():
                found[i, kind] = found.get((i, kind), 0) + math.log(1 - min(x, 0.99))
    best = {}
    for (i, kind), doubt in found.items():
        if 1 - math.exp(doubt) >= settings.confident:
            best[i] = max(best.get(i, (float("-inf"), "")), (-doubt, kind))
    return {i: (kind, 1 - math.exp(-sure)) for i, (sure, kind) in best.items()}


def test_rounds_as_stated(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(6000):
        context = rng.randrange(40)
        kind = rng.choice(["email", "phone"]) if context % 10 == 0 else ["email", "ip", "card", "phone"][context % 4]
        seed = rng.random() < (0.97 if context < 20 else 0.5)
        instance = f"{kind}{rng.randrange(400)}" if seed else f"odd{rng.randrange(300)}"
        rows.append((kind if seed else None, instance, rng.choice([f"a{context} b{context}", f"b{context}", ""]), rng.choice([f"c{context} d{context}", f"c{context}", ""])))
    got = {r["instance"]: (r.kind, r.confidence) for r in pii.discover(spark.createDataFrame(rows, "kind string, instance string, before string, after string").repartition(5), pii.Bootstrap()).collect()}
    want = plain_discover(rows, pii.Bootstrap())
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)


def test_planted_identifiers(spark):
    """Identifiers that no base pattern fits, in contexts of known ones and elsewhere: what is found, and what of it is right."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    contexts = {"email": [("write to", "for details"), ("mail address", "is mine")], "phone": [("call us", "any time"), ("phone number", "after six")], "ip": [("server at", "is down")]}
    seen = {"email": lambda: f"{word()}@{word()}.com", "phone": lambda: f"+{rng.randrange(10**9, 10**10)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4))}
    unseen = {"email": lambda: f"{word()}@{word()}", "phone": lambda: f"0049-555-{rng.randrange(10**4, 10**5)}", "ip": lambda: f"fe80::{rng.randrange(10**4, 10**6)}"}
    docs, planted = [], {}
    for k in range(1500):
        kind = rng.choice(list(contexts))
        before, after = rng.choice(contexts[kind])
        hidden = rng.random() < 0.05
        token = (unseen if hidden else seen)[kind]()
        text = " ".join(word() for _ in range(rng.randrange(9))) + f" {before} "
        if hidden:
            planted[k] = (kind, len(text), len(text) + len(token))
        docs.append((k, text + f"{token} {after} " + " ".join(word() for _ in range(rng.randrange(9)))))
    docs += [(2000 + k, f"{word()} order {rng.randrange(10**6)} item {rng.randrange(10**5)} {word()}@{word()} {word()}") for k in range(500)]
    got = {(r.doc_id, *x) for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).collect() for x in r.added}
    want = {(k, *x) for k, x in planted.items()}
    assert len(want) > 50 and len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_very_long_tokens(spark):
    """Long tokens and words are read whole, in linear time, and two of one beginning are two."""
    rng = random.Random(1)
    words = lambda text: [w.lower() for w in text.split()]
    for _ in range(300):
        text = "".join(rng.choice("ab@1. \n\u2003é+-") for _ in range(rng.randrange(60)))
        base = pii.base_spans(text)
        found = pii.mentions(text, base)
        assert sorted(x for x in base) == sorted(x[:3] for x in found if x[0])
        for kind, s, e, instance, before, after in found:
            left = max([0, *(y for _, x, y, *_ in found if x < s)])
            right = min([len(text), *(x for _, x, *_ in found if x >= e)])
            # slots in own tokens cut words short
            own_left, own_right = max([0, *(m.end() for m in re.finditer(r"\s", text[:s]))]), min([len(text), *(e + m.start() for m in re.finditer(r"\s", text[e:]))])
            b = words(text[:own_left]) + words(text[max(own_left, min(left, s)) : s])
            a = words(text[e : min(own_right, right)]) + words(text[own_right:])
            assert instance == text[s:e] and before.split(" ") == (b[-2:] or [""]) and after.split(" ") == (a[:2] or [""])
    long = "x" * 1_000_000
    began = time.time()
    found = pii.mentions(f"{long}1234a {long}1234b {long} a@b {long}c", [])
    assert len({m[3] for m in found}) == len(found) == 3 and found[2][4] != found[2][5] and len(found[2][4]) < 200
    for text in (long, "1" * 1_000_000, "@a" * 500_000, "1." * 500_000, "+1(" * 300_000, "a@b." * 250_000, "1 -" * 300_000):
        pii.mentions(text, pii.base_spans(text))
    assert time.time() - began < 30
    docs = spark.createDataFrame([(k, f"mail u{k}@a.com now {long[:k]}") for k in range(20)] + [(90, f"mail someone@{long} now"), (91, f"{long} {long}1 x@y")], "doc_id long, text string")
    assert {r.doc_id: [tuple(x) for x in r.added] for r in pii.find_pii(docs).collect() if r.added} == {90: [("email", 5, 13 + len(long))]}


def test_query(spark, sf_dir):
    from bytegrams.llm.queries import op3_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_pii(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = plain_spans(texts[r.doc_id])
        said = [":".join(map(str, s)) for s in want]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in PLAIN)
        assert set(said) <= set(r.spans.split(","))
