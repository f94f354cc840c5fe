"""Toxicity by weak supervision.

Voters look at a text: seed lexicons, lexicons of words, of word beginnings and
of families of words (several that begin alike) that labelled texts suggest, and
patterns of writing. All documents' votes are
counted; a generative model (a tree of dependent voters for each class, fitted
by expectation maximisation on those counts) estimates how accurate the voters
are and which of them go together. Its posteriors label a bounded sample, on
which a linear classifier over the same evidence is trained, and that scores
every document.

Bounded on the driver: ``sample`` labelled rows (their ids and labels, then
their few features), terms of high odds in their texts, and the counts of vote
patterns, of which there are at most 2 ** (number of voters). Everything else
stays in Spark.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import cut, texts

WORD = re.compile(r"[^\W\d_]+")
#: Seed lexicon: common English insults and words of hate; more come from labelled texts.
SEEDS = frozenset("idiot idiots idiotic moron morons moronic stupid dumb loser losers pathetic worthless disgusting scum trash garbage clown clowns imbecile vermin filth jerk hate kill ugly freak retard bastard shit fuck fucking bitch crap damn".split())


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows used at most, those of smallest hash. least, share: labelled toxic texts that a learned term
    needs, and of all of them. sureness: log odds ratio that it needs; kinship: that a family of words needs. rounds: of
    the label model at most."""

    sample: int = 30_000
    least: int = 4
    share: float = 0.01
    sureness: float = 3.5
    kinship: float = 1.5
    rounds: int = 40


@dataclass(frozen=True)
class Lexicon:
    """Learned words, beginnings of words, and beginnings that several words of a text share, each with its log odds ratio."""

    words: dict = field(default_factory=dict)
    heads: dict = field(default_factory=dict)
    families: dict = field(default_factory=dict)


VOTERS = ("seed", "seed_twice", "word", "word_strong", "word_twice", "head", "head_strong", "head_twice", "family", "family_strong", "shouting", "marks", "stretched", "masked")
#: Voters of the lexicons come first.
LEXICAL = 10
#: Learned terms beyond this log odds ratio are strong.
STRONG = 5.0
FEATURES = len(VOTERS) + 5
#: Lengths of beginnings, and how many distinct words of a text make a family.
HEADS, KIN = (4, 5, 6, 7, 8), 3
#: Words that a task remembers.
REMEMBERED = 100_000


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about a megabyte of text, which is all that a task has as Python strings at a time."""
    for batch in batches:
        yield from kn.parts(batch, "text", 1_000_000)


def word_key(word: str) -> str:
    """What a lexicon has for a word: itself, or a digest of the whole word beyond 40 letters."""
    return word if len(word) <= 40 else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def heads_of(word: str) -> list[str]:
    return [word[:k] for k in HEADS if k <= len(word)] if len(word) > HEADS[0] else []


@functools.cache
def _signs() -> np.ndarray:
    """By code point: 1 for a letter, and 2 more for an upper-case sign."""
    return np.fromiter((c.isalpha() + 2 * c.isupper() for c in map(chr, range(0x110000))), np.uint8, 0x110000)


MASK = np.array([ord(c) for c in "*#$"], np.uint32)


def writing(text: str) -> tuple[bool, bool, bool]:
    """Patterns of the whole text: more than half as many upper-case signs as letters; a letter four times in a row; a
    letter, signs such as *, and a letter again."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _signs()[codes]
    found = np.bincount(kind, minlength=4)
    letter = (kind & 1).astype(bool)
    same = letter[1:] & (codes[1:] == codes[:-1])
    stretched = len(same) > 2 and bool((same[2:] & same[1:-1] & same[:-2]).any())
    masked = False
    if "*" in text or "#" in text or "$" in text:
        rest = letter[~np.isin(codes, MASK)]
        # letters stay neighbours where nothing but masks is between them
        place = np.flatnonzero(~np.isin(codes, MASK))
        masked = bool((rest[1:] & rest[:-1] & (np.diff(place) > 1)).any())
    return bool(found[2] + found[3] > 0.5 * (found[1] + found[3])), stretched, masked


def is_shouting(text: str) -> bool:
    return writing(text)[0]


def terms_of(text: str) -> set[str]:
    """Distinct lower-cased words as w:KEY, their beginnings as h:HEAD, and those of several words as f:HEAD."""
    words = set(WORD.findall(text.lower()))
    heads = Counter(h for w in words for h in heads_of(w))
    return {f"w:{word_key(w)}" for w in words} | {f"h:{h}" for h in heads} | {f"f:{h}" for h, n in heads.items() if n >= KIN}


class Voters:
    """The voters over a lexicon; remembers what it knows of words."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.known: dict[str, tuple | None] = {}

    def _look_up(self, word: str) -> tuple | None:
        """(whether a seed, odds as a word, best odds of its beginnings, its families' beginnings), None for a plain word."""
        x = self.lexicon
        heads = heads_of(word) if x.heads or x.families else []
        info = (word in SEEDS, x.words.get(word_key(word), 0.0), max((x.heads.get(h, 0.0) for h in heads), default=0.0), [h for h in heads if h in x.families])
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = info if any(info) else None
        return self.known[word]

    def __call__(self, text: str) -> np.ndarray:
        """The votes (0 or 1), then five amounts: seed words, learned words, learned beginnings, words of families, log odds."""
        words = WORD.findall(text.lower())
        unique = Counter(words)
        known = self.known
        told = [(w, x) for w in unique if (x := known[w] if w in known else self._look_up(w))]
        n_seed = sum(unique[w] for w, x in told if x[0])
        odds = [x[1] for _, x in told if x[1]]
        n_word = sum(unique[w] for w, x in told if x[1])
        heads = [x[2] for _, x in told if x[2]]
        kin = Counter(h for _, x in told for h in x[3])
        families = [(n, self.lexicon.families[h]) for h, n in kin.items() if n >= KIN]
        shouting, stretched, masked = writing(text)
        votes = [
            n_seed >= 1, n_seed >= 2,
            bool(odds), any(o >= STRONG for o in odds), n_word >= 2,
            bool(heads), any(o >= STRONG for o in heads), len(heads) >= 2,
            bool(families), any(o >= STRONG for _, o in families),
            shouting and sum(map(len, unique)) > 20, "!!" in text, stretched, masked,
        ]
        amounts = [math.log1p(n_seed), math.log1p(n_word), math.log1p(len(heads)), math.log1p(max((n for n, _ in families), default=0)), math.log1p(sum(odds) + sum(heads))]
        return np.array(votes + amounts, float)


def evidence(text: str, lexicon: Lexicon) -> np.ndarray:
    return Voters(lexicon)(text)


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sampled_labels(labels: DataFrame, settings: Settings) -> DataFrame:
    """(label_id, toxic) of at most ``sample`` labelled rows that may be learned from; a repeated id counts once, toxic if any says so."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("label_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("label_id")))
    return rows.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(settings.sample)


def labelled_rows(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """docs (doc_id, hash, ...) with toxic: one row of each labelled id and hash, ``sample`` rows at most.

    The sample is chosen by ids and hashes. It is bounded and broadcast, so
    only the rows that are taken are shuffled.
    """
    known = F.broadcast(sampled_labels(labels, settings))
    keys = docs.join(known, F.col("doc_id") == F.col("label_id")).select("label_id", F.col("hash").alias("label_hash"), "toxic").distinct()
    sample = F.broadcast(keys.orderBy("label_hash", "label_id").limit(settings.sample))
    rows = docs.join(sample, (F.col("doc_id") == F.col("label_id")) & (F.col("hash") == F.col("label_hash")))
    return rows.drop("label_id", "label_hash").dropDuplicates(["doc_id", "hash"])


def labelled_texts(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    return labelled_rows(texts(docs).withColumn("hash", F.xxhash64("text")), labels, settings)


def learn_lexicon(labelled: DataFrame, settings: Settings) -> Lexicon:
    """Terms whose odds among toxic texts are much higher than among others. Copies of a text count once.

    What reaches the driver are terms that ``share`` of the sample's toxic texts have, all of them: no more than
    1 / ``share`` times as many as a text has.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            n = [0, 0]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(terms_of(text))
                n[toxic > 0] += 1
            names = ["", *(counts[1].keys() | counts[0].keys())]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n[1], *(counts[1][x] for x in names[1:])], pa.int64()), pa.array([n[0], *(counts[0][x] for x in names[1:])], pa.int64())], ["term", "yes", "no"])

    unique = labelled.select("text", "toxic", F.xxhash64("text").alias("hash")).dropDuplicates(["hash", "toxic"])
    terms = cut(unique.select("text", "toxic").mapInArrow(counted, "term string, yes long, no long").groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(f"term = '' OR yes >= {settings.least}"))
    total = terms.filter("term = ''").first()
    if total is None or not total["yes"]:
        return Lexicon()
    # a term without strength in numbers is chance: its odds are those of a cautious count
    odds = F.log((F.col("yes") + 0.5) / (total["yes"] + 1)) - F.log((F.col("no") + 0.5 + F.sqrt("no")) / (total["no"] + 1))
    least = F.when(F.col("term").startswith("f:"), settings.kinship).otherwise(settings.sureness)
    kept = {r["term"]: r["odds"] for r in terms.filter(F.col("term") != "").filter(F.col("yes") >= settings.share * total["yes"]).withColumn("odds", odds).filter(F.col("odds") >= least).select("term", "odds").collect()}
    return Lexicon(*({t[2:]: o for t, o in kept.items() if t[0] == kind} for kind in "whf"))


def evidence_of(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, hash, votes int, x array<double>): every text is read here once."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, weights = Voters(lexicon), 1 << np.arange(len(VOTERS))
        for batch in in_parts(batches):
            x = np.array([voters(t) for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            votes = (x[:, : len(VOTERS)].astype(int) @ weights).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(votes), lists], ["doc_id", "hash", "votes", "x"])

    return texts(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(seen, "doc_id long, hash long, votes int, x array<double>")


class LabelModel:
    """P(class, votes) with a tree of dependent voters for each class, by expectation maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: dict[int, tuple[float, float]], settings: Settings):
        """patterns: vote patterns as ints with their counts in all documents; known: of labelled ones, pattern -> (n clean, n toxic)."""
        bits = (patterns[:, None] >> np.arange(len(VOTERS)) & 1).astype(int)
        labelled = np.array([known.get(int(p), (0.0, 0.0)) for p in patterns], float).reshape(len(patterns), 2)
        free = np.maximum(counts - labelled.sum(1), 0)
        share = (labelled[:, 1].sum() + 1) / (labelled.sum() + 2)
        # at first by the labelled rows, and where they say nothing by how many voters agree
        guess = 1 / (1 + np.exp(-(bits[:, :LEXICAL].sum(1) - 2.0)))
        post = (labelled[:, 1] + 4 * share * 2 * guess) / (labelled.sum(1) + 4)
        post = np.clip(post, 0, 1)
        for _ in range(settings.rounds):
            weight = np.stack([free * (1 - post) + labelled[:, 0], free * post + labelled[:, 1]], 1)
            self.fit(bits, weight)
            new = self.posterior(bits)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def fit(self, bits: np.ndarray, weight: np.ndarray) -> None:
        m = bits.shape[1]
        self.prior = np.log((weight.sum(0) + 1) / (weight.sum() + 2))
        self.parents, self.tables = [], []
        for y in (0, 1):
            w = weight[:, y]
            one = np.stack([1 - bits, bits], 2).astype(float)  # pattern, voter, value
            joint = np.einsum("p,pia,pjb->ijab", w, one, one) + 0.25  # smoothed by one vote
            p = joint / joint.sum((2, 3), keepdims=True)
            single = p.sum(3)
            info = (p * np.log(p / (single[:, :, :, None] * p.sum(2)[:, :, None, :]))).sum((2, 3))
            parent, inside, rest = [-1] * m, [0], set(range(1, m))
            while rest:  # the tree of most mutual information
                a, b = max(((a, b) for a in inside for b in rest), key=lambda e: info[e])
                parent[b] = a
                inside.append(b)
                rest.remove(b)
            tables = [np.log(single[0, 0] / single[0, 0].sum())[None, :].repeat(2, 0) if k == 0 else np.log(p[q, k] / p[q, k].sum(1, keepdims=True)) for k, q in enumerate(parent)]
            self.parents.append(parent)
            self.tables.append(np.array(tables))

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """P(toxic | votes)."""
        like = np.stack([self.prior[y] + sum(self.tables[y][k][bits[:, q] if q >= 0 else np.zeros(len(bits), int), bits[:, k]] for k, q in enumerate(self.parents[y])) for y in (0, 1)], 1)
        return 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))

    def of(self, patterns: np.ndarray) -> np.ndarray:
        return self.posterior((np.asarray(patterns)[:, None] >> np.arange(len(VOTERS)) & 1).astype(int))


def with_labels(post: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Posteriors of labelled rows once the label votes too; how often it is right is estimated by the posteriors."""
    hit = ((post * toxic).sum() + 0.5) / (post.sum() + 1)
    false = (((1 - post) * toxic).sum() + 0.5) / ((1 - post).sum() + 1)
    ratio = np.where(toxic > 0, hit / false, (1 - hit) / (1 - false))
    return post * ratio / (post * ratio + 1 - post)


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the last for the constant) of a logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - p) / len(x) + ridge * w / len(x) * 100
        hess = (x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge / len(x) * 100 * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, batch: list[str]) -> np.ndarray:
        voters = Voters(self.lexicon)
        return self.score(np.array([voters(t) for t in batch]).reshape(len(batch), FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> tuple[Model, DataFrame]:
    """(voters, label model and classifier; the evidence of all docs). Without toxic labelled rows only the seeds vote."""
    settings = settings or Settings()
    lexicon = learn_lexicon(labelled_texts(docs, labels, settings), settings)
    seen = cut(evidence_of(docs, lexicon))
    found = seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()  # 2 ** len(VOTERS) rows at most
    rows = labelled_rows(seen, labels, settings).select("toxic", "x").collect()  # settings.sample rows at most
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    votes = (x[:, : len(VOTERS)].astype(int) << np.arange(len(VOTERS))).sum(1)
    known: dict[int, tuple[float, float]] = {}
    for v, r in zip(votes.tolist(), rows, strict=True):
        clean, toxic = known.get(v, (0.0, 0.0))
        known[v] = (clean + (r["toxic"] == 0), toxic + (r["toxic"] > 0))
    if not found or not rows:
        return Model(lexicon, np.r_[np.array([4.0] + [0.0] * (FEATURES - 1)), -2.0]), seen
    model = LabelModel(np.array([r["votes"] for r in found]), np.array([r["n"] for r in found], float), known, settings)
    toxic = np.array([float(r["toxic"] > 0) for r in rows])
    order = np.lexsort((*x.T, votes, toxic))  # in the same order whatever Spark returned
    return Model(lexicon, fit_linear(x[order], with_labels(model.of(votes[order]), toxic[order]))), seen


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    labels (doc_id, toxic): rows with crc32(doc_id) mod 3 = 1 are never
    learned from; an id with two labels is toxic. Null texts are scored as
    empty ones, very long ones whole. Repeated rows stay and count; equal
    texts have equal scores. No documents: no rows; without labels the seed
    lexicon decides. Further columns are ignored.
    """
    model, seen = fit(docs, labels, settings)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    found = seen.select("doc_id", "x").mapInArrow(scored, "doc_id long, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns and their order, whose text isn't predicted to be toxic. Null texts are judged as empty
    ones; without labels the seed lexicon decides; no rows: no rows."""
    model, _ = fit(docs, labels, settings)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.lexicon)
        for batch in in_parts(batches):
            x = np.array([voters(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(kept, docs.schema)
