"""Personal data: exact base patterns, then bootstrapped contextual extraction.

One pass over the texts finds the base spans and every other token that looks
like an identifier, each with its neighbouring words. The base spans are the
seeds of a graph between lexical patterns (the words around a slot) and
instances (what stood in it). Spark scores the graph in rounds: a pattern is
worth the share of its instances that are known to be of a kind, an instance
combines the patterns that it occurs in. Candidates that confident patterns
point to become spans of that kind. The base spans stay as they are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrams.llm import kernels as kn
from bytegrams.llm.common import cut, texts

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits without dots after it can't start a match further on, hence the look-behind.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SOME = re.compile(r"[0-9@]")
TOKEN = re.compile(r"\S+")
DIGIT = re.compile(r"[0-9]")
#: Longer words and instances go by a digest of the whole.
LONGEST = 64
EDGE = "\"'.,;:!?()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Leftmost and not overlapping within a kind; failing matches are dropped."""
    if not SOME.search(text):
        return []
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, last := m.end()))
        at = text.find("@", max(at + 1, last))
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def looks(token: str) -> bool:
    """Whether a token looks like an identifier: four digits, or an at sign between other signs."""
    return token.find("@", 1, len(token) - 1) > 0 or len(DIGIT.findall(token)) >= 4


def name_of(word: str) -> str:
    return word if len(word) <= LONGEST else "#" + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def mentions(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int, str, str, str]]:
    """(kind or None, start, end, instance, words before, words after) of the base spans and of other tokens that look
    like identifiers, in order; two words on either side, lower-cased. What a slot leaves of its own tokens, up to the next slot there, are words too."""
    if not SOME.search(text):
        return []
    starts, ends = [], []
    taken, slots = sorted((s, e) for _, s, e in base), [(k, s, e) for k, s, e in base]
    k = 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        starts.append(start)
        ends.append(end)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if (k >= len(taken) or taken[k][0] >= end) and SOME.search(text, start, end) and looks(m[0]):
            token = m[0].strip(EDGE)
            if token:
                start += m[0].index(token)
                slots.append((None, start, start + len(token)))
    names: dict[int, str] = {}  # of tokens

    def token(k: int) -> str:
        if k not in names:
            names[k] = name_of(text[starts[k] : ends[k]].lower())
        return names[k]

    slots.sort(key=lambda x: x[1:])
    begins, reach = [s for _, s, _ in slots], list(itertools.accumulate((e for *_, e in slots), max))
    out = []
    for kind, s, e in slots:
        first, last = bisect.bisect_right(ends, s), bisect.bisect_left(starts, e) - 1
        # in its own tokens a slot has what lies between it and the slots next to it
        k = bisect.bisect_left(begins, s)
        left = max(starts[first], reach[k - 1] if k else 0)
        k = bisect.bisect_left(begins, e)
        right = min(ends[last], begins[k] if k < len(begins) else len(text))
        before = [token(k) for k in range(max(0, first - 2), first)] + [name_of(text[left:s].lower())] * (left < s)
        after = [name_of(text[e:right].lower())] * (right > e) + [token(k) for k in range(last + 1, min(last + 3, len(starts)))]
        out.append((kind, s, e, name_of(text[s:e]), " ".join(before[-2:]), " ".join(after[:2])))
    return out


_MENTION = "struct<kind:string,start:int,end:int,instance:string,before:string,after:string>"
_SCAN = f"row long, doc_id long, spans array<struct<kind:string,start:int,end:int>>, mentions array<{_MENTION}>"
_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()),
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ("mentions", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("before", pa.string()), ("after", pa.string())]))),
])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: row, doc_id, base spans, mentions. No text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in kn.parts(batch, "text", 4_000_000):
                spans, around = [], []
                for text in part.column(2).to_pylist():
                    base = base_spans(text)
                    spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base])
                    around.append([dict(zip(("kind", "start", "end", "instance", "before", "after"), x, strict=True)) for x in mentions(text, base)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(spans, _ARROW.field(2).type), pa.array(around, _ARROW.field(3).type)], schema=_ARROW)

    return texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(found, _SCAN)


@dataclass(frozen=True)
class Bootstrap:
    """rounds: of scoring. confident: what a pattern and an instance need. support: distinct seeds that a pattern needs."""

    rounds: int = 3
    confident: float = 0.8
    support: int = 3


def discover(mentioned: DataFrame, settings: Bootstrap) -> DataFrame:
    """mentioned (kind, instance, before, after) -> (instance, kind, confidence) of unseen instances.

    Patterns: two words before; two words after; one on either side. Empty contexts make none.
    """
    last, first = F.element_at(F.split("before", " "), -1), F.element_at(F.split("after", " "), 1)
    patterns = F.array(
        F.when(F.col("before").contains(" "), F.concat(F.col("before"), F.lit(" _"))),
        F.when(F.col("after").contains(" "), F.concat(F.lit("_ "), F.col("after"))),
        F.when((last != "") & (first != ""), F.concat_ws(" _ ", last, first)),
    )
    edges = cut(mentioned.select("instance", "kind", F.explode(F.filter(patterns, lambda p: p.isNotNull())).alias("pattern")).groupBy("pattern", "instance", "kind").agg(F.lit(1).alias("one")).drop("one"))
    links = edges.select("pattern", "instance").distinct()
    size = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    seeds = edges.filter(F.col("kind").isNotNull()).select("instance", "kind").distinct().withColumn("doubt", F.lit(float("-inf"))).withColumn("seed", F.lit(True))
    unseen = links.join(seeds.select("instance").distinct(), "instance", "left_anti")
    # doubt is the log of what is missing to 1, which doubles can't hold of an instance with much evidence
    confidence = 1 - F.exp("doubt")
    known = seeds
    for _ in range(settings.rounds):
        worth = links.join(known, "instance").groupBy("pattern", "kind").agg(F.sum(confidence).alias("sum"), F.sum(F.col("seed").cast("int")).alias("seeds")).join(size, "pattern")
        # one more instance of no kind: small patterns are worth less
        worth = worth.withColumn("worth", F.col("sum") / (F.col("size") + 1)).filter((F.col("seeds") >= settings.support) & (F.col("worth") >= settings.confident))
        found = unseen.join(worth, "pattern").groupBy("instance", "kind").agg(F.sum(F.log(1 - F.least("worth", F.lit(0.99)))).alias("doubt")).withColumn("seed", F.lit(False))
        known = cut(seeds.unionByName(found))
    sure = known.filter(~F.col("seed") & (confidence >= settings.confident))
    return sure.groupBy("instance").agg(F.max_by("kind", F.struct(-F.col("doubt"), "kind")).alias("kind"), F.max(confidence).alias("confidence"))


def find_pii(docs: DataFrame, settings: Bootstrap | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, spans (base), added (by context), each array<struct<kind,start,end>>.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans. Repeated rows each get theirs and count once in the graph. Without
    seeds nothing is added. Texts and tokens of any length are read whole, in
    time that grows with their length. An instance that patterns of two kinds
    point to is of the surer one, on a tie of the kind that is last in the
    alphabet. No rows: no rows. Further columns are ignored.
    """
    settings = settings or Bootstrap()
    rows = cut(scan(docs))
    each = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    new = discover(each.select("kind", "instance", "before", "after"), settings)
    hits = each.filter(F.col("kind").isNull()).drop("kind").join(new, "instance")
    added = hits.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return rows.join(added, "row", "left").select("doc_id", "spans", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))
