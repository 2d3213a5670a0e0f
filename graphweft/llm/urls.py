"""URL filters: rules first, then two character models that tell accepted from rejected URLs.

Two smoothed variable-order Markov models (suffix trees over bytes) are learned from four fifths,
by hash, of the URLs that a rule allows or blocks. Other URLs are allowed if their log-likelihood difference per
byte is at least a threshold, calibrated on the fifth that the models haven't seen: the middle of the range that best
separates the two classes. The models learn from and judge the whole url, query and fragment included; rules and columns read host and path only.

Defined results: a null url or one without `://` has empty host and path, which no rule fits;
the models judge them like any other. Where the fifth lacks a class all ruled URLs calibrate. Without URLs of both
classes the threshold is 0, and without any both models give the same, so unruled URLs are allowed. Rows with repeated or null page_id get a row
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered
from .markov import DEPTH, END, SuffixTree, frequent_levels, gram_batches

#: (verdict, rule): host, then path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
P_MIN = 1e-4
#: One in HELD of the ruled URLs calibrates.
HELD = 5
#: Steps of the calibration's histogram, from -SPAN to SPAN.
SPAN, STEPS = 4.0, 4000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))
    return lowered(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: len(x[1])):
        at, _, below = r.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _bytes(address: str | None) -> bytes | None:
    return None if address is None else address.encode().replace(END, b" ") + END


def learn(ruled: DataFrame, verdict: str, p_min: float = P_MIN) -> SuffixTree:
    """ruled: address, said."""
    grams = ruled.where(F.col("said") == verdict).select("address").mapInArrow(gram_batches("address", _bytes), "gram long, n long")
    return SuffixTree(frequent_levels(grams, DEPTH, p_min))


def margin(good: SuffixTree, bad: SuffixTree, spark):
    """A pandas UDF: log10 likelihood difference per byte."""
    sent = spark.sparkContext.broadcast((good, bad))  # bounded: see markov.frequent_levels

    @F.pandas_udf("double")
    def difference(address: pd.Series) -> pd.Series:
        good, bad = sent.value
        texts = [_bytes(a or "") for a in address]
        return pd.Series((good.score(texts) - bad.score(texts)) / np.array([len(t) for t in texts], float) if texts else np.zeros(0))

    return difference


def threshold(counts: list[tuple[int, int, int]]) -> float:
    """From (step, allowed, blocked): the middle of the steps where the share of allowed at or above less that of blocked is largest."""
    a, b = np.zeros(STEPS + 2), np.zeros(STEPS + 2)
    for step, x, y in counts:
        a[step] += x
        b[step] += y
    if not a.sum() or not b.sum():
        return 0.0
    gap = np.cumsum(b)[:-1] / b.sum() - np.cumsum(a)[:-1] / a.sum()  # threshold above each step
    best = np.flatnonzero(gap >= gap.max() - 1e-12)
    return -SPAN + 2 * SPAN * (best[0] + best[-1] + 2) / 2 / STEPS


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, margin."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce("url", F.lit("")).alias("address"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    cut = cut.withColumn("rule", rule).withColumn("said", said)
    cut = cut.withColumn("held", F.pmod(F.xxhash64("address"), F.lit(HELD)) == 0)
    ruled = cut.where(F.col("said").isNotNull() & ~F.col("held")).select("address", "said")
    difference = margin(learn(ruled, "allow"), learn(ruled, "block"), spark)
    scored = cut.withColumn("margin", difference("address"))
    step = F.least(F.lit(STEPS), F.greatest(F.lit(0), F.floor((F.col("margin") + SPAN) / (2 * SPAN) * STEPS))).cast("int")
    seen = scored.where(F.col("said").isNotNull()).groupBy(step.alias("step"), "held").agg(F.sum((F.col("said") == "allow").cast("int")).alias("a"), F.sum((F.col("said") == "block").cast("int")).alias("b")).collect()  # two rows a step
    apart = [(r["step"], r["a"], r["b"]) for r in seen if r["held"]]
    both = any(a for _, a, _ in apart) and any(b for _, _, b in apart)
    edge = threshold(apart if both else [(r["step"], r["a"], r["b"]) for r in seen])
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("margin") >= edge, "allow").otherwise("block")).alias("verdict"), "margin")
