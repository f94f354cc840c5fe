"""Scores of the toxicity operator against the same method in plain Python, row by row and without numpy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

from bytegrams.llm import toxicity as tox

HEADS, STRONG = (4, 5, 6, 7, 8), 5.0


def heads(word):
    return [word[:k] for k in HEADS if k <= len(word)] if len(word) > 4 else []


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


def key(word):
    return word if len(word) <= 40 else "#" + hashlib.blake2b(word.encode(), digest_size=16).hexdigest()


def terms(text):
    unique = set(words_of(text))
    shared = Counter(h for w in unique for h in heads(w))
    return {("w", key(w)) for w in unique} | {("h", h) for h in shared} | {("f", h) for h, n in shared.items() if n >= 3}


def lexicon_of(labelled, s):
    unique = {(text, toxic) for text, toxic in labelled}
    total = [sum(t == y for _, t in unique) for y in (0, 1)]
    yes, no = (Counter(x for text, toxic in unique if toxic == y for x in terms(text)) for y in (1, 0))
    found = {}
    for x, n in yes.items():
        odds = math.log((n + 0.5) / (total[1] + 1)) - math.log((no[x] + 0.5 + math.sqrt(no[x])) / (total[0] + 1))
        if n >= s.least and n >= s.share * total[1] and odds >= (s.kinship if x[0] == "f" else s.sureness):
            found[x] = odds
    return found


def evidence(text, lexicon):
    count = Counter(words_of(text))
    get = lambda kind, x: lexicon.get((kind, x), 0.0)
    odds = [o for w in count if (o := get("w", key(w)))]
    best = [o for w in count if (o := max((get("h", h) for h in heads(w)), default=0.0))]
    shared = Counter(h for w in count for h in heads(w) if ("f", h) in lexicon)
    kin = [(n, lexicon["f", h]) for h, n in shared.items() if n >= 3]
    seeds, learned = sum(n for w, n in count.items() if w in tox.SEEDS), sum(n for w, n in count.items() if get("w", key(w)))
    shouting = sum(c.isupper() for c in text) > 0.5 * sum(c.isalpha() for c in text)
    stretched = any(a.isalpha() and a == b == c == d for a, b, c, d in zip(text, text[1:], text[2:], text[3:]))  # noqa: B905
    masked = bool(re.search(r"[^\W\d_][*#$]+[^\W\d_]", text))
    votes = [seeds >= 1, seeds >= 2, bool(odds), any(o >= STRONG for o in odds), learned >= 2, bool(best), any(o >= STRONG for o in best), len(best) >= 2, bool(kin), any(o >= STRONG for _, o in kin), shouting and sum(map(len, count)) > 20, "!!" in text, stretched, masked]
    amounts = [math.log1p(seeds), math.log1p(learned), math.log1p(len(best)), math.log1p(max((n for n, _ in kin), default=0)), math.log1p(sum(odds) + sum(best))]
    return tuple(int(v) for v in votes), amounts


def posterior(bits, prior, parents, tables):
    like = []
    for y in (0, 1):
        total = prior[y]
        for k, q in enumerate(parents[y]):
            total += tables[y][k][bits[q] if q >= 0 else 0][bits[k]]
        like.append(total)
    return 1 / (1 + math.exp(min(50, max(-50, like[0] - like[1]))))


def tree_of(patterns, weight):
    """Parents and tables of one class: the tree of most mutual information, from counts smoothed by a quarter for each cell."""
    m = len(patterns[0])
    joint = [[[[0.25] * 2 for _ in range(2)] for _ in range(m)] for _ in range(m)]
    for bits, w in zip(patterns, weight, strict=True):
        for i in range(m):
            for j in range(m):
                joint[i][j][bits[i]][bits[j]] += w
    p = [[[[x / sum(map(sum, joint[i][j])) for x in row] for row in joint[i][j]] for j in range(m)] for i in range(m)]
    info = lambda i, j: sum(p[i][j][a][b] * math.log(p[i][j][a][b] / (sum(p[i][j][a]) * (p[i][j][0][b] + p[i][j][1][b]))) for a in (0, 1) for b in (0, 1))
    known = {(i, j): info(i, j) for i in range(m) for j in range(m) if i != j}
    parent, inside, rest = [-1] * m, [0], list(range(1, m))
    while rest:
        a, b = max(((a, b) for a in inside for b in rest), key=lambda e: known[e])
        parent[b] = a
        inside.append(b)
        rest.remove(b)
    tables = []
    for k, q in enumerate(parent):
        if k == 0:
            one = [math.log(sum(p[0][0][a]) / sum(map(sum, p[0][0]))) for a in (0, 1)]
            tables.append([one, one])
        else:
            tables.append([[math.log(x / sum(row)) for x in row] for row in p[q][k]])
    return parent, tables


def label_model(count, known, s):
    """pattern -> P(toxic | votes), by expectation maximisation."""
    patterns = sorted(count, key=lambda b: sum(v << k for k, v in enumerate(b)))
    clean, toxic = ([known.get(b, (0, 0))[y] for b in patterns] for y in (0, 1))
    free = [max(0, count[b] - clean[k] - toxic[k]) for k, b in enumerate(patterns)]
    share = (sum(toxic) + 1) / (sum(toxic) + sum(clean) + 2)
    post = []
    for k, b in enumerate(patterns):
        guess = 1 / (1 + math.exp(-(sum(b[:10]) - 2.0)))
        post.append(min(1, (toxic[k] + 4 * share * 2 * guess) / (toxic[k] + clean[k] + 4)))
    for _ in range(s.rounds):
        weight = [[free[k] * (1 - post[k]) + clean[k] for k in range(len(post))], [free[k] * post[k] + toxic[k] for k in range(len(post))]]
        total = sum(map(sum, weight))
        prior = [math.log((sum(w) + 1) / (total + 2)) for w in weight]
        parents, tables = zip(*(tree_of(patterns, w) for w in weight), strict=True)
        new = [posterior(b, prior, parents, tables) for b in patterns]
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-6:
            break
        post = new
    return {b: posterior(b, prior, parents, tables) for b in patterns}


def solved(a, b):
    """Gaussian elimination with pivots."""
    n = len(b)
    a = [[*row, y] for row, y in zip(a, b, strict=True)]
    for k in range(n):
        best = max(range(k, n), key=lambda i: abs(a[i][k]))
        a[k], a[best] = a[best], a[k]
        for i in range(k + 1, n):
            f = a[i][k] / a[k][k]
            for j in range(k, n + 1):
                a[i][j] -= f * a[k][j]
    x = [0.0] * n
    for k in range(n - 1, -1, -1):
        x[k] = (a[k][n] - sum(a[k][j] * x[j] for j in range(k + 1, n))) / a[k][k]
    return x


def logistic(x, p):
    """Newton steps with a ridge of one row's weight."""
    m = len(x[0])
    w = [0.0] * m
    for _ in range(50):
        q = [1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(row, w, strict=True)))))) for row in x]
        grad = [sum(row[j] * (b - a) for row, a, b in zip(x, p, q, strict=True)) / len(x) + w[j] / len(x) for j in range(m)]
        hess = [[sum(row[i] * row[j] * b * (1 - b) for row, b in zip(x, q, strict=True)) / len(x) + (1 / len(x) + 1e-9) * (i == j) for j in range(m)] for i in range(m)]
        step = solved(hess, grad)
        w = [a - b for a, b in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
    return w


def plain_scores(docs, labels, s):
    """doc_id -> score; docs (doc_id, text), labels (doc_id, toxic)."""
    toxic = {}
    for d, t in labels:
        if zlib.crc32(str(d).encode()) % 3 != 1:
            toxic[d] = max(t, toxic.get(d, 0))
    rows = sorted({(d, text or "") for d, text in docs if d in toxic})
    lexicon = lexicon_of([(text, int(toxic[d] > 0)) for d, text in rows], s)
    seen = {d: evidence(text or "", lexicon) for d, text in docs}
    count = Counter(votes for votes, _ in seen.values())
    known = {}
    for d, _ in rows:
        a = known.setdefault(seen[d][0], [0, 0])
        a[int(toxic[d] > 0)] += 1
    model = label_model(count, known, s)
    post, label = [model[seen[d][0]] for d, _ in rows], [float(toxic[d] > 0) for d, _ in rows]
    hit = (sum(a * b for a, b in zip(post, label, strict=True)) + 0.5) / (sum(post) + 1)
    false = (sum((1 - a) * b for a, b in zip(post, label, strict=True)) + 0.5) / (sum(1 - a for a in post) + 1)
    ratio = {1.0: hit / false, 0.0: (1 - hit) / (1 - false)}
    soft = [a * ratio[b] / (a * ratio[b] + 1 - a) for a, b in zip(post, label, strict=True)]
    w = logistic([[*seen[d][0], *seen[d][1], 1.0] for d, _ in rows], soft)
    return {d: 1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip([*v, *x, 1.0], w, strict=True)))))) for d, (v, x) in seen.items()}


def test_scores_equal_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").collect()]
    assert len({d for d, _ in docs}) == len(docs) and len({xxhash.xxh64_intdigest((t or "").encode(), 42) for _, t in docs}) == len({t or "" for _, t in docs})
    want = plain_scores(docs, labels, tox.Settings())
    got = {r.doc_id: (r.score, r.predicted) for r in tox.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert set(got) == set(want)
    assert max(abs(got[d][0] - want[d]) for d in want) < 1e-4
    assert all(p == int(s >= 0.7) for s, p in got.values()) and any(p for _, p in got.values())
