"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of a file is content-addressed by SHA-256. The ledger holds one
row per (blob, rule) that has been scanned, with what it found. A scan takes
only pairs that the ledger lacks, and findings are joined back to all paths
that hold the blob. Rules have versions: a changed rule is a new pair.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytegrams.llm.common import cut, fresh, texts

SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """pattern: what is matched, leftmost and not overlapping; hint: a cheaper pattern that every text with a match has.

    A match counts if group ``group`` has ``least`` characters; failing ones are dropped, not retried.
    """

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: Three base rules, then those for tokens of known public formats. Runs shorter than the least length can't be part
#: of a longer match, so the lengths of access and hex stand in the pattern.
RULES = (
    Rule("assign", 1, r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"(?i:passw|secret|token|api_?key)", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN "),
)
BASE = ("assign", "access", "hex")


def rule_matches(text: Column, rule: Rule) -> Column:
    """A rule's matches and what stands before each, as array<struct<gap, size, valid>>: code points of the text between this
    match and the one before, of the match, and of the part that must have ``least``."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    valid = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))  # but for what stands after the last match
    rows = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))), valid, lambda r, v: F.struct(r["gap"].alias("gap"), r["size"].alias("size"), (F.length(v) >= rule.least).alias("valid")))
    return F.when(text.rlike(rule.hint), rows).otherwise(F.array().cast("array<struct<gap:int,size:int,valid:boolean>>"))


def blobs_of(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", "text", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("blob"))


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rule, spans): the (blob, rule) pairs of docs that the ledger lacks.

    Copies of a text are one blob: they are combined before and after the shuffle, and scanned once.
    """
    unique = blobs_of(docs).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        todo = unique.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rules at most
        todo = unique.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    each = F.array(*[F.when(~F.array_contains("seen", r.name), F.struct(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), rule_matches(F.col("text"), r).alias("matches"))) for r in rules])
    pairs = todo.select("blob", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("blob", "x.rule", "x.kind", "x.matches")
    # a running sum gives the places, in the partitions of the blobs; a pair without matches is one row
    matches = pairs.select("blob", "rule", "kind", F.posexplode_outer("matches").alias("at", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    found = matches.withColumn("end", end).select("blob", "rule", F.when(F.col("m.valid"), F.struct("kind", (F.col("end") - F.col("m.size")).alias("start"), "end")).alias("span"))
    return found.groupBy("blob", "rule").agg(F.array_sort(F.collect_list("span")).cast(SPANS).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: doc_id, blob, spans (by start, then the rules' order). Only blobs with findings are joined back."""
    order = {r.kind: k for k, r in enumerate(rules)}
    place = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    found = ledger.filter((F.size("spans") > 0) & F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    sort = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = found.select("blob", F.transform(sort, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    paths = blobs_of(docs).select("doc_id", "blob")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings per row of docs, new ledger rows to append).

    Null texts are empty and share the blob of the empty text. A repeated row
    is another path of its blob. No rows: nothing found, nothing to append.
    Further columns are ignored. Where rules overlap, all their spans stay.
    Very long texts are scanned whole, and many findings take work in
    proportion.
    """
    new = cut(scan_unseen(docs, ledger, rules))
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "spans"))
    return findings(docs, known, rules), new


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points of the pieces that a text is cut into, so that a place in it is found without reading it from the start.
BLOCK = 4096


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with each finding replaced by <KIND>; of overlapping spans the first one's kind stands for all.

    Findings belong to a text, so they are joined by its blob. Null texts stay
    null, and texts without findings as they are; no rows: no rows. Very long
    texts and many findings take work in proportion.
    """
    blob, own, cuts = fresh(docs, "blob_of_text", "spans_of_text", "blocks_of_text")
    unique = found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    each = unique.select("blob", F.posexplode("spans").alias("place", "s")).select("blob", "place", "s.*")
    by_blob = Window.partitionBy("blob").orderBy("place")
    before = F.max("end").over(by_blob.rowsBetween(Window.unboundedPreceding, -1))
    grouped = each.withColumn("new", (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int")).withColumn("group", F.sum("new").over(by_blob))
    merged = grouped.groupBy("blob", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "place").alias("kind"))
    spans = merged.groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(own))
    text = F.col(f"`{text_col}`")
    joined = docs.join(spans, F.unhex(F.sha2(F.encode(text, "utf-8"), 256)) == F.col(blob), "left")
    joined = joined.withColumn(cuts, F.when(F.col(own).isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        pieces = F.slice(F.col(cuts), first + 1, F.floor(b / BLOCK).cast("int") - first + 1)
        return F.substring(F.array_join(pieces, ""), a % BLOCK + 1, b - a)

    ends = lambda i: F.coalesce(F.get(F.col(own), i - 1)["end"], F.lit(0))
    parts = F.transform(own, lambda s, i: F.concat(between(ends(i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    done = F.concat(F.array_join(parts, ""), between(F.element_at(own, -1)["end"], F.length(text)))
    return joined.withColumn(text_col, F.when(F.col(own).isNotNull() & text.isNotNull(), done).otherwise(text)).drop(blob, own, cuts)


def _oracle_rule(kind: str, pattern: str, group: int, least: int, k: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""SELECT doc_id, '{kind}' AS kind, {k} AS k, s, s + len(m[i]) AS e FROM (
      SELECT doc_id, m, v, i, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS BIGINT) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)))
    WHERE len(v[i]) >= {least}"""


#: The same from the rules; SQL has no ledger, so every text is scanned.
ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nf AS ("
    + "\nUNION ALL\n".join(_oracle_rule(r.kind, r.pattern, r.group, r.least, k) for k, r in enumerate(RULES))
    + """),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""
)
