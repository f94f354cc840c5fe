import hashlib
import random
import re

from bytegrams.llm import secrets
from bytegrams.llm.queries import op9_secret_scan

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base(text):
    """The base patterns as stated, by start, then kind."""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


CASES = ["password=token: abcdef", "é API_KEY = 'abc' token:'x/y+z=='", "apikey:abcdefpassword=secret12", "AKIA" * 9 + " AKIAKIA0123456789AB xAKIA", "0123456789abcdef01234567g" + "a" * 23 + "G" + "f" * 30, "", None, "PaSsWd\" : \"longenough", "token=" + "a1" * 20, "ghp_" + "A" * 36, "-----BEGIN RSA PRIVATE KEY-----", "secret==secret==ab"]


def test_base_as_stated(spark):
    rng = random.Random(2)
    bits = ["password", "TOKEN", "api_key", "=", ":", " ", "'", "abc", "AKIA", "A1B2", "0f", "deadbeef", "é", "\n", "."]
    cases = CASES + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(800)]
    docs = spark.createDataFrame([(k, t, "b", 1) for k, t in enumerate(cases)], "doc_id long, text string, blob string, spans int").repartition(4)
    rows = secrets.scan_secrets(docs)[0].collect()
    assert len(rows) == len(cases)
    for r in rows:
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in secrets.BASE]
        assert got == base(cases[r.doc_id] or ""), cases[r.doc_id]
    kinds = {s.kind for r in rows for s in r.spans}
    assert {"github", "pem"} <= kinds


def test_ledger(spark):
    old, new = "token=abcdefgh", "key " + "ab" * 20
    first = spark.createDataFrame([(1, old), (2, old), (None, None)], "doc_id long, text string")
    found, ledger = secrets.scan_secrets(first)
    assert ledger.count() == 2 * len(secrets.RULES) and [len(r.spans) for r in found.orderBy("doc_id").collect()] == [0, 1, 1]
    second = first.unionByName(spark.createDataFrame([(3, new), (4, old)], "doc_id long, text string"))
    found, more = secrets.scan_secrets(second, ledger)
    assert more.select("blob").distinct().count() == 1  # only the unseen text is scanned
    assert {r.doc_id: [s.kind for s in r.spans] for r in found.collect()} == {None: [], 1: ["assign"], 2: ["assign"], 3: ["hex"], 4: ["assign"]}
    changed = (secrets.Rule("hex", 2, "[0-9a-f]{30,}", "[0-9a-f]{30}"), *secrets.RULES[:2])
    _, again = secrets.scan_secrets(second, ledger.unionByName(more), changed)
    assert {r.rule for r in again.collect()} == {"hex@2"} and again.count() == 3
    assert secrets.scan_secrets(first.limit(0))[0].count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefgh and " + "0" * 30, 7), (2, "clean", 7), (3, None, 7), (1, "é token=abcdefgh and " + "0" * 30, 7)], "doc_id long, text string, __at int")
    out = secrets.redact(docs, secrets.scan_secrets(docs)[0])
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "é <ASSIGN> and <HEX>"), (2, "clean"), (3, None), (1, "é <ASSIGN> and <HEX>")], key=str)


def test_many_findings_in_one_text(spark):
    """Time grows in proportion: 60,000 checksums in one text, overlapping findings, and a text longer than any block."""
    text = "".join(f"{k:032x}{'é' * (k % 3 + 1)}" for k in range(60_000)) + "token=" + "ab" * 20 + "x" * 5000
    docs = spark.createDataFrame([(1, text), (2, "token=" + "ab" * 20 + " password=token: abcdef"), (3, "plain")], "doc_id long, text string")
    found, _ = secrets.scan_secrets(docs)
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in found.collect()}
    assert got == {d: base(t) for d, t in ((1, text), (2, "token=" + "ab" * 20 + " password=token: abcdef"), (3, "plain"))}
    out = {r.doc_id: r.text for r in secrets.redact(docs, found).collect()}
    assert out == {1: redacted(text, got[1]), 2: redacted("token=" + "ab" * 20 + " password=token: abcdef", got[2]), 3: "plain"}
    assert out[1].count("<HEX>") == 60_000


def redacted(text, spans):
    """Spans in their order; overlapping ones are one, of the first one's kind."""
    out, end = [], 0
    merged = []
    for x in spans:
        kind, a, b = x.split(":")
        if merged and int(a) < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], int(b))
        else:
            merged.append([kind, int(a), int(b)])
    for kind, a, b in merged:
        out += [text[end:a], f"<{kind.upper()}>"]
        end = b
    return "".join(out) + text[end:]


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_secret_scan(spark, sf_dir).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k) for x in want) for k in secrets.BASE)
