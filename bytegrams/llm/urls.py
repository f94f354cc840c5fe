"""URL filter: rules first, then a character language-model ratio.

URLs that a rule allows or blocks train two smoothed variable-order Markov
models. Every other URL is judged by the difference of its log-likelihoods
under the two, divided by its length, against a threshold calibrated on
labelled URLs that were held out.

The models are tables (gram, counts) that grow with the corpus; nothing of
them goes to the driver. Orders mix by Witten-Bell weights: a context seen n
times with t different followers gives n/(n+t) of the weight to its own counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrams.llm.common import ascii_lower, cut

START, STOP = "\x02", "\x03"
#: One in so many labelled URLs calibrates, the others train.
HELD = 5
BINS = 400


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, lower-cased) and path; both empty for null or where there is no ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; rules are ("block" or "allow", "host/path")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits is asked first
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def grams(text: Column, order: int) -> Column:
    """For each character and the stop sign, itself after the order - 1 characters before it."""
    padded = F.concat(F.lit(START * (order - 1)), text, F.lit(STOP))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))."), F.lit(1))


def train(labelled: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """labelled (text, n, allow) -> (gram, context, c1, c0: counts of allowed and of blocked) for every gram up to that
    order, and (context, n1, n0: its counts, t1, t0: how many followers it has)."""
    longest = labelled.select(F.explode(grams(F.col("text"), order)).alias("gram"), "n", "allow").groupBy("gram").agg(F.sum(F.when(F.col("allow"), F.col("n")).otherwise(0)).alias("c1"), F.sum(F.when(F.col("allow"), 0).otherwise(F.col("n"))).alias("c0"))
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.right(F.col("gram"), k))
    counts = longest.select(F.explode(suffixes).alias("gram"), "c1", "c0").groupBy("gram").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    contexts = counts.groupBy("context").agg(
        F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.sum((F.col("c1") > 0).cast("long")).alias("t1"), F.sum((F.col("c0") > 0).cast("long")).alias("t0")
    )
    return counts, contexts


def ratios(distinct: DataFrame, counts: DataFrame, contexts: DataFrame, order: int, alphabet: int = 256) -> DataFrame:
    """distinct (gram) -> (gram, ratio): log P_allow - log P_block of the gram's last character after the others.

    Length by length: the suffixes of k characters take their context's counts
    and the probability of their own suffix of k - 1 characters. They are
    distinct, so no key of these joins has more rows than there are characters.
    """
    mix = lambda p, c, n, t: F.when(n > 0, (F.coalesce(c, F.lit(0)) + t * p) / (n + t)).otherwise(p)
    level = None
    for k in range(1, order + 1):
        grams_k = distinct.select(F.right("gram", F.lit(k)).alias("gram")).distinct().withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        seen = grams_k.join(contexts, "context", "left").join(counts.select("gram", "c1", "c0"), "gram", "left")
        if level is None:
            seen = seen.withColumns({"p1": F.lit(1.0 / alphabet), "p0": F.lit(1.0 / alphabet)})
        else:
            seen = seen.withColumn("suffix", F.right("gram", F.lit(k - 1))).join(level.withColumnRenamed("gram", "suffix"), "suffix")
        level = seen.select("gram", *[mix(F.col(f"p{x}"), F.col(f"c{x}"), F.col(f"n{x}"), F.col(f"t{x}")).alias(f"p{x}") for x in "10"])
    return level.select("gram", (F.log("p1") - F.log("p0")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], order: int = 5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: id_col, host, path, rule (null if none fits), verdict, score.

    score is the method's (natural log per character, higher: like allowed
    URLs), verdict the rule's, else "allow" where score reaches the threshold.
    It reads the whole host and path, as the rules do; query and fragment, which
    no rule looks at, are no evidence. Without labelled URLs of both kinds all
    scores are 0 and the method allows. A score at the threshold allows; very
    long URLs are scored whole. Null and malformed URLs have an empty host and path and are
    scored as the empty text. Equal URLs are scored once and count as often
    as they occur; repeated rows stay. Further columns are ignored.
    """
    host, path = host_path(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns(dict(zip(("rule", "ruled"), matched_rule(F.col("host"), F.col("path"), rules), strict=True)))
    judged = judged.withColumn("text", F.concat("host", "path"))
    # dealt anew, and named: a text becomes a row for each of its characters
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unique = cut(judged.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.max("ruled").alias("ruled")).repartition(parts, "text").withColumn("id", F.monotonically_increasing_id()))
    labelled = unique.filter(F.col("ruled").isNotNull()).select("id", "text", "n", (F.col("ruled") == "allow").alias("allow"))
    held = F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0
    counts, contexts = (cut(x) for x in train(labelled.filter(~held), order))
    positions = unique.select("id", F.explode(grams(F.col("text"), order)).alias("gram"))
    ratio = ratios(cut(positions.select("gram").distinct()), counts, contexts, order)
    scores = cut(positions.join(ratio, "gram").groupBy("id").agg(F.avg("ratio").alias("score")))
    threshold = calibrate(scores.join(labelled.filter(held), "id"))
    verdict = F.coalesce("ruled", F.when(F.coalesce("score", F.lit(0.0)) >= threshold, "allow").otherwise("block"))
    return judged.join(unique.join(scores, "id").select("text", "score"), "text", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def calibrate(scored: DataFrame, low: float = -2.0, high: float = 2.0) -> float:
    """The threshold with the best mean of both classes' accuracies; scored (score, n, allow). BINS rows reach the driver."""
    bins = F.least(F.greatest(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1))
    rows = {r["bin"]: (r["yes"], r["no"]) for r in scored.groupBy(bins.alias("bin")).agg(F.sum(F.when(F.col("allow"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("allow"), 0).otherwise(F.col("n"))).alias("no")).collect()}
    yes, no = sum(y for y, _ in rows.values()), sum(n for _, n in rows.values())
    if not yes or not no:
        return float("-inf")
    best, at, kept_yes, kept_no = -1.0, low, yes, no
    for b in range(BINS):
        if (right := kept_yes / yes + 1 - kept_no / no) > best:
            best, at = right, low + b * (high - low) / BINS
        y, n = rows.get(b, (0, 0))
        kept_yes, kept_no = kept_yes - y, kept_no - n
    return at
