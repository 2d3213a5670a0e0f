"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut in the middle. Of two words one edit apart, of equal length or one longer by one, the
shorter's first half stands at the longer's beginning, or its second half at the longer's end, moved by the difference of
lengths. So each word is indexed under its two halves, and asks for the halves that words of its length,
or of one less, would have at these two places. The rest, beside the half that agrees, is again one edit
apart: buckets with more than `BUCKET` rows are cut further by the same rule, half by half, until
they are small or the rest is a single character, so no bucket holds the square of a frequent beginning or
ending, and no pair is lost. Candidates are verified in the join by a bounded edit distance; pairs found at several
places are kept once.

Words are counted in tasks before anything is shuffled. Forms are followed by pointer jumping, whose rounds are
bounded by the counts: a form occurs `RATIO` times as often as its word.

Defined results: null texts have no words, a null doc_id counts as the empty text; repeated rows count as often as
they occur; other columns are ignored; an empty table gives no rows. Texts of any length are cut a piece at a time.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Code points and occurrences of a word, at least; how much more often a form occurs; one run in how many is worn down.
LENGTH, TIMES, RATIO, WORN = 6, 5, 5, 199
#: Rows of a bucket that aren't cut further.
BUCKET = 32
#: Characters that are cut at once; distinct words that a task counts before it passes them on.
PIECE, HELD = 1 << 20, 200_000

_KEEPS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str):
    """Counts of the maximal runs of letters (A-Z lowered), as Latin-1 bytes: one byte a code point, separators for all that lies beyond."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _is_letter(text[end]):
            end += 1
        yield from Counter(text[at:end].encode("latin-1", "replace").translate(_KEEPS).split()).items()
        at = end


def _is_letter(c: str) -> bool:
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def worn(prefix: int, run: bytes, one_in: int = WORN) -> bytes:
    """The run, less one code point if its hash (crc32 of `<doc_id>:` so far, in UTF-8) says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, n: those of at least `length` code points and `times` occurrences."""

    def batches(it):
        held: dict[bytes, int] = {}

        def told():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in it:
            for doc, text in zip(b.column("doc_id"), b.column("text")):
                prefix = zlib.crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for run, n in runs(text.as_py() or ""):
                    if len(run) >= length and len(run := worn(prefix, run)) >= length:
                        held[run] = held.get(run, 0) + n
                if len(held) > HELD:
                    yield told()
                    held.clear()
        if held:
            yield told()

    each = docs.select("doc_id", "text").mapInArrow(batches, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _cut(words: DataFrame, place: Column, start: Column, size: Column, more: Column) -> DataFrame:
    """Rows of words (asking or not) in two finer buckets each, by the halves of the `size` characters of their rest that begin at `start` (from 1).

    `more`: by how many characters an asking word's rest is longer than those of the words that it asks for.
    """
    half = F.floor(size / 2).cast("int")
    first = F.struct(F.concat(place, F.lit("<")).alias("place"), F.substring("word", start, half).alias("part"), (start + half).alias("start"), (size - half).alias("size"))
    second = F.struct(F.concat(place, F.lit(">")).alias("place"), F.substring("word", start + half + more, size - half).alias("part"), start.alias("start"), half.alias("size"))
    return words.withColumn("_", F.explode(F.array(first, second)))


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (word, size of those asked for, start, rest, more, bucket) with a finer bucket: the bucket's hash, the half's place and characters."""
    cut = _cut(rows, F.lit(""), F.col("start"), F.col("rest"), F.col("more"))
    bucket = F.xxhash64("bucket", F.col("_.place"), F.col("_.part"))
    return cut.select("word", "asks", "more", F.col("_.start").alias("start"), F.col("_.size").alias("rest"), bucket.alias("bucket"))


def near_pairs(words: DataFrame, most: int = BUCKET) -> DataFrame:
    """a, b with a < b: all pairs of words (distinct) one inserted, deleted or replaced code point apart.

    Buckets are numbered by 64-bit hashes; what two of them might share by chance is verified away.
    """
    size = F.length("word")
    whole = words.select("word", F.explode(F.array(F.struct(F.lit(False).alias("asks"), F.lit(0).alias("more")), F.struct(F.lit(True).alias("asks"), F.lit(0).alias("more")), F.struct(F.lit(True).alias("asks"), F.lit(1).alias("more")))).alias("_"))
    rows = whole.select("word", "_.asks", "_.more", F.lit(1).alias("start"), (size - F.col("_.more")).alias("rest"), F.xxhash64(size - F.col("_.more")).alias("bucket")).where(F.col("rest") > 0)
    rows, found = _buckets(rows), None
    longest = words.agg(F.max(size)).first()[0] or 0
    # (depth: each round halves the rest, rounded up)
    for depth in range(max(1, math.ceil(math.log2(max(2, longest))) + 1)):
        rows = stored(rows, f"buckets-{depth}")
        sizes = rows.groupBy("bucket").agg(F.count_if("asks").alias("asking"), F.count_if(~F.col("asks")).alias("told")).where((F.col("told") > 0) & (F.col("asking") > 0))
        sizes = stored(sizes, "bucket-sizes")
        large = F.col("asking") + F.col("told") > most
        kept = rows.join(sizes.select("bucket", large.alias("large")), "bucket")
        ripe = kept.where(~F.col("large") | (F.col("rest") <= 1))
        told = ripe.where(~F.col("asks")).select("bucket", F.col("word").alias("b"))
        asked = ripe.where("asks").select("bucket", "more", F.col("word").alias("a"))
        near = asked.join(told, "bucket").where((F.length("a") - F.length("b") == F.col("more")) & ((F.col("more") == 1) | (F.col("a") < F.col("b")))).where(F.levenshtein("a", "b", 1) == 1)
        near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = near if found is None else found.unionByName(near)
        rest = kept.where(F.col("large") & (F.col("rest") > 1)).drop("large")
        if not sizes.where(large).limit(1).count():
            break
        rows = _buckets(rest)
    return found.distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    pairs = stored(near_pairs(words.select("word")), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))
    others = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = others.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("k"), F.col("other").alias("other"))).alias("best"))
    got = words.join(best, "word", "left")
    fits = -F.col("best.k") >= ratio * F.col("n")
    table = stored(got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.k")).alias("form_n")), "forms")
    links = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = table.agg(F.max("n")).first()[0] or 0
    longest = int(math.log(max(most, 1), ratio)) + 1 if ratio > 1 else 64  # a path of forms
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return table.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_spellings(docs: DataFrame) -> DataFrame:
    """Each frequent word of the texts with its form, root, count, number of near words and the form's count."""
    return variants(stored(word_counts(docs), "words"))
