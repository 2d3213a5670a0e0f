"""Quality rules: countable facts of a text and a learned, ordered decision list, all in Spark expressions.

The facts are computed by built-in functions only. The decision list is learned on the driver
by sequential covering from the facts of a bounded sample of labelled documents and returned
as ordered `when` branches.

Defined results: null and empty texts have no words, so all counts are 0 and base_failed is
true. Rows with repeated or null doc_id are judged one by one. With no usable labels the list
is empty and every text that passes the base rule is kept; of repeated labels the higher counts. Columns
other than the id and the text survive `keep_good`; in `measure` and `judge` those named like a measure (or `_n`, `_lines`,
`_words`, `kept`) give way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, where_late, words_of

#: Labelled documents that the list is learned from, at most.
SAMPLE = 6000
#: Positions fit this many low bits when a window's hash and position share a long.
POSITION_BITS = 22
FACTS = ["mean_word", "symbol_share", "dup_line_share", "repeat_share", "shout_share", "bang_share", "words_per_line"]


def _with_repeats(df: DataFrame, limit: int) -> DataFrame:
    """n_repeat_words: words in the 3-word windows that occur at least twice.

    Hashes and positions sorted as longs find the candidate windows; the words themselves decide.
    Texts of more than `limit` words have all their windows compared by words.
    """
    words, n = F.col("_words"), F.col("_n")
    starts = F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0)))

    def window_hash(w, i):
        return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))

    high = F.lit(-1 << POSITION_BITS).cast("long")
    low = F.lit((1 << POSITION_BITS) - 1).cast("long")
    df = df.withColumn("_packed", F.when((n >= 3) & (n <= limit), F.sort_array(F.transform(starts, lambda w, i: window_hash(w, i).bitwiseAND(high).bitwiseOR(i.cast("long"))))))
    packed = F.col("_packed")

    def twin(x, i, step):
        return F.coalesce(F.get(packed, i + step).bitwiseXOR(x).bitwiseAND(high) == 0, F.lit(False))

    near = F.transform(F.filter(packed, lambda x, i: twin(x, i, 1) | (twin(x, i, -1) & (i > 0))), lambda x: x.bitwiseAND(low).cast("int"))
    df = df.withColumn("_near", F.when(n > limit, F.sequence(F.lit(0), n - 3)).otherwise(near))
    exact = F.sort_array(F.transform(F.col("_near"), lambda p: F.struct(F.concat_ws(" ", F.slice(words, p + 1, F.lit(3))).alias("g"), p.alias("p"))))
    df = df.withColumn("_exact", exact)
    e = F.col("_exact")
    same = F.filter(e, lambda x, i: F.coalesce(F.get(e, i + 1)["g"] == x["g"], F.lit(False)) | ((i > 0) & F.coalesce(F.get(e, i - 1)["g"] == x["g"], F.lit(False))))
    where = F.sort_array(F.transform(same, lambda x: x["p"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("covered"))
    total = F.aggregate(where, start, lambda a, p: F.struct(p.alias("last"), (a["covered"] + F.least(F.lit(3), p - a["last"])).alias("covered")), lambda a: a["covered"])
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("_packed", "_near", "_exact")


def measure(df: DataFrame, text: str = "text", window_limit: int = 1 << POSITION_BITS) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the facts of the decision list."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_n", F.size("_words"))
    df = _with_repeats(df, window_limit)
    df = df.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = (
        df.withColumn("n_words", F.col("_n").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.size(F.regexp_extract_all(t, F.lit("[#*$%&|<>]"), F.lit(0))).cast("long"))
        .withColumn("_n_lines", F.size("_lines"))
        .withColumn("n_dup_lines", (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_shouts", F.size(F.regexp_extract_all(t, F.lit("[A-Z]{2,}"), F.lit(0))))
        .withColumn("_bangs", F.size(F.regexp_extract_all(t, F.lit("[!?]{2,}"), F.lit(0))))
        .withColumn("_late", F.monotonically_increasing_id())
        .drop("_lines", "_words")
    )
    # A caller's filter would be pushed below and copy the expressions above into their own lambdas; it stops at a row number that each measure reads.
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "_n_lines", "_shouts", "_bangs"]
    df = df.withColumns({c: F.when(F.col("_late") >= 0, F.col(c)) for c in counts}).drop("_late")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")
    return (
        df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("mean_word", F.col("word_chars") / n)
        .withColumn("symbol_share", F.col("n_symbols") / n)
        .withColumn("dup_line_share", F.col("n_dup_lines") / lines)
        .withColumn("repeat_share", F.col("n_repeat_words") / n)
        .withColumn("shout_share", F.col("_shouts") / n)
        .withColumn("bang_share", F.col("_bangs") / n)
        .withColumn("words_per_line", n / lines)
        .drop("_n", "_n_lines", "_shouts", "_bangs")
    )


Condition = tuple[int, bool, float]  # index of the fact, "at most" rather than "more than", threshold


def _fires(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for j, at_most, t in rule:
        hit &= (x[:, j] <= t) if at_most else (x[:, j] > t)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> list[Condition]:
    """Add the threshold of highest information gain until the rule covers rejected rows alone or nothing is gained."""
    rule: list[Condition] = []
    hit = np.ones(len(x), bool)
    while len(rule) < longest:
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        if not n or not p:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[hit, j], np.linspace(0, 1, 33))):
                for at_most in (True, False):
                    now = hit & ((x[:, j] <= t) if at_most else (x[:, j] > t))
                    q = (now & bad).sum()
                    if q:
                        gain = q * (np.log2(q / now.sum()) - before)
                        if gain > best[0]:
                            best = (gain, (j, at_most, float(t)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _fires(rule, x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Drop the last conditions as long as the share of right minus wrong hits on rows not grown from doesn't fall."""
    def worth(r):
        hit = _fires(r, x)
        return ((hit & bad).sum() - (hit & ~bad).sum()) / max(1, hit.sum())

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn_list(x: np.ndarray, rejected: np.ndarray, precision: float = 0.85, most_rules: int = 12, longest: int = 4, least: int = 4) -> list[list[Condition]]:
    """Sequential covering: grow a rule on two thirds of the rows left, prune it on the other third, keep it if it is precise
    on all rows left, and go on with what it doesn't cover."""
    rules: list[list[Condition]] = []
    left = np.arange(len(x))
    while len(rules) < most_rules and rejected[left].sum() >= least:
        third = left % 3 == 2
        grown, pruned = left[~third], left[third]
        rule = _prune(_grow(x[grown], rejected[grown], longest), x[pruned], rejected[pruned])
        hit = _fires(rule, x[left]) if rule else np.zeros(len(left), bool)
        if hit.sum() < least or rejected[left][hit].mean() < precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Condition]]:
    """The decision list for labels.quality = 0, from at most `sample` labelled documents (those of smallest id hash)."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    some = bounded_sample(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample)
    rows = measure(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "base_failed", *FACTS)).alias("r"))  # however many rows an id has
    got = one.select("doc_id", "r.*").toPandas().sort_values("doc_id")
    got = got[~got["base_failed"]]
    return learn_list(got[FACTS].to_numpy(float), got["quality"].to_numpy() == 0)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as ordered branches: the first rule that fires rejects; else the text is kept."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for j, at_most, t in rule:
            fact = F.col(FACTS[j])
            cond = cond & ((fact <= t) if at_most else (fact > t))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """docs with its measures and `kept`."""
    return measure(docs).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the base rule and the learned list keep, with docs' own columns."""
    apart = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("text"))
    return where_late(judge(apart, learn(docs, labels)), F.col("kept")).select("row.*")
