"""Benchmark decontamination: windows of benchmark words found in training texts, by Spark expressions only.

The hashes of all benchmark windows form a set that every task holds. Up to `MAX_LITERALS`
windows are part of the expression that scans each text's words in place. Larger benchmarks go
out as broadcast tables of `BLOCK` windows at most: each text's windows stream past them in the task that
read the text, and only hits leave it. Either way hits are verified on the words.

Defined results: null or empty texts have no words and are clean; an item without words or
with a null item_id never occurs; items repeated under one id count once; rows with repeated
or null doc_id are judged one by one; other columns of docs survive `clean` and are ignored
by `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha256, lowered, stored, where_late, without

WINDOW = 8
#: Benchmark windows that go to every task as literals, at most.
MAX_LITERALS = 50_000
#: Benchmark windows of one broadcast table, at most: some 100 MB.
BLOCK = 500_000
#: Hit rows whose keys go to every task, so that no other row is shuffled, at most; more meet their hits by a shuffled join.
TOLD = 1_000_000
#: What stands between words: ASCII that isn't a digit or lower-case letter.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bench_words(text: Column) -> Column:
    return F.filter(F.split(lowered(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def windows_at(w: Column, size: int) -> Column:
    """Places (from 1) and words, space-joined, of the windows of `size` words."""
    start = F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(start, lambda i: F.struct(i.alias("pos"), F.lit(size).alias("len"), F.array_join(F.slice(w, i, F.lit(size)), " ").alias("gram")))


def item_windows(bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, len, gram, h): each item's distinct windows."""
    w = F.col("w")
    whole = F.array(w)
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.slice(w, i, F.lit(size)))
    return (
        bench.where(F.col("item_id").isNotNull()).select("item_id", bench_words(F.col("text")).alias("w")).where(F.size("w") > 0)
        .select("item_id", F.explode(F.when(F.size("w") < size, whole).otherwise(many)).alias("g"))
        .select("item_id", F.size("g").alias("len"), F.array_join("g", " ").alias("gram"), F.xxhash64("g").alias("h")).distinct()
    )


def _owners(grams: DataFrame) -> DataFrame:
    """gram and its items, sorted."""
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def _covered(hits: Column) -> Column:
    """Words inside any of the hits, an array of (pos, len)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.sort_array(hits), start,
        lambda a, x: F.struct(F.greatest(a["end"], x["pos"] + x["len"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]))).alias("n")),
        lambda a: a["n"],
    )


def _literal(grams: DataFrame, max_literals: int) -> dict[int, list[int]] | None:
    """The window hashes by window length, or None if they are too many for literals."""
    by_len = {r["len"]: r["n"] for r in grams.groupBy("len").agg(F.countDistinct("h").alias("n")).collect()}  # a row for each length
    if sum(by_len.values()) > max_literals:
        return None
    hashes: dict[int, list[int]] = {m: [] for m in sorted(by_len)}
    for r in grams.select("len", "h").distinct().collect():  # max_literals longs at most
        hashes[r["len"]].append(r["h"])
    return hashes


def _marked(rows: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """rows with _w (words), n_words and _hits (array of pos from 1, len, gram)."""
    base = rows.withColumn("_w", bench_words(F.col("text"))).withColumn("n_words", F.size("_w").cast("long"))
    hits = [F.array().cast("array<struct<pos:int,len:int,gram:string>>")]
    for m in hashes:
        literals = ",".join(f"{h}L" if h != -(2**63) else "bigint(-9223372036854775808)" for h in sorted(hashes[m]))
        starts = F.expr(f"if(size(_w) >= {m}, filter(sequence(1, size(_w) - {m - 1}), i -> xxhash64(slice(_w, i, {m})) IN ({literals})), cast(array() as array<int>))")
        size = F.lit(m)
        hits.append(F.transform(starts, lambda i: F.struct(i.alias("pos"), size.alias("len"), F.array_join(F.slice(F.col("_w"), i, size), " ").alias("gram"))))  # noqa: B023
    return base.withColumn("_hits", F.concat(*hits))


def _owned(marked: DataFrame, keep: list[str], owners: DataFrame) -> DataFrame:
    """Verify hits on the words and gather them by row: keep, n_words, hits, items."""
    flat = marked.withColumn("_rid", F.monotonically_increasing_id()).select(*keep, "_rid", "n_words", F.explode_outer("_hits").alias("_hit"))
    flat = flat.select(*keep, "_rid", "n_words", F.col("_hit.pos").alias("_pos"), F.col("_hit.len").alias("_len"), F.col("_hit.gram").alias("gram"))
    owned = flat.join(F.broadcast(owners), "gram", "left")  # owners of MAX_LITERALS windows at most
    hit = F.when(F.col("items").isNotNull(), F.struct(F.col("_pos").alias("pos"), F.col("_len").alias("len")))
    return owned.groupBy("_rid").agg(*[F.first(F.col(c)).alias(c) for c in [*keep, "n_words"]], F.collect_set(hit).alias("hits"), _all_items())


def _all_items() -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")


def _row_key() -> list[Column]:
    return [F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id").alias("r2")]


def _streamed(docs: DataFrame, grams: DataFrame, block: int) -> DataFrame:
    """r1 and r2 (of a row's id and text), hits and items of the rows with hits: windows stream past broadcast blocks of the set.

    Each row of r1 and r2 stands for all rows of that id and text.
    """
    lens = [r["len"] for r in grams.groupBy("len").count().collect()]  # a row for each length up to the window's
    owners = stored(_owners(grams), "benchmark")
    blocks = -(-max(1, owners.count()) // block)
    words = docs.where(F.col("text").isNotNull()).select(*_row_key(), bench_words(F.col("text")).alias("_w"))
    each = words.select("r1", "r2", F.explode(F.concat(*[windows_at(F.col("_w"), m) for m in sorted(lens)])).alias("x")).select("r1", "r2", "x.pos", "x.len", "x.gram")
    found = None
    for k in range(blocks):
        part = owners if blocks == 1 else owners.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == k)
        met = each.join(F.broadcast(part), "gram").select("r1", "r2", "pos", "len", "items")  # blocks have `block` windows on average, by hash
        found = met if found is None else found.unionByName(met)
    return found.groupBy("r1", "r2").agg(F.collect_set(F.struct("pos", "len")).alias("hits"), _all_items())


def _found(docs: DataFrame, grams: DataFrame, block: int) -> DataFrame:
    return stored(_streamed(docs, grams, block), "hits")


def scan(docs: DataFrame, bench: DataFrame, size: int = WINDOW, max_literals: int = MAX_LITERALS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (two items or more)."""
    grams = item_windows(bench, size)
    hashes = _literal(grams, max_literals)
    if hashes is not None:
        got = _owned(_marked(docs.select("doc_id", "text"), hashes), ["doc_id"], _owners(grams))
    else:
        rows = docs.select("doc_id", *_row_key(), F.size(bench_words(F.col("text"))).cast("long").alias("n_words"))
        none = F.array()
        met = rows.join(_found(docs, grams, block), ["r1", "r2"], "left")  # no text is shuffled
        got = met.select("doc_id", "n_words", F.coalesce("hits", none.cast("array<struct<pos:int,len:int>>")).alias("hits"), F.coalesce("items", none.cast("array<string>")).alias("items"))
    n = F.size("items").cast("long")
    return got.select("doc_id", "n_words", _covered(F.col("hits")).alias("n_hit"), n.alias("n_items"), hex_sha256(F.array_join("items", ",")).alias("items_sha256"), (n >= 2).alias("contaminated"))


def clean(docs: DataFrame, bench: DataFrame, drop_from: int = 2, size: int = WINDOW, max_literals: int = MAX_LITERALS, block: int = BLOCK, told: int = TOLD) -> DataFrame:
    """docs without the documents that hold `drop_from` items or more, and without the hit words of the others.

    A text with hits is cut into words, each with the stretch after it; hit words go with theirs.
    Texts without hits pass straight through: only texts with hits are shuffled (unless more than `told` rows have hits).
    """
    names = docs.columns
    grams = item_windows(bench, size)
    hashes = _literal(grams, max_literals)
    apart = docs.select(F.struct("*").alias("_row"), F.col("text"), F.col("doc_id"))
    if hashes is not None:
        marked = _marked(apart, hashes)
        found = _owned(where_late(marked, F.size("_hits") > 0), ["_row"], _owners(grams))
        rest = where_late(marked, F.size("_hits") == 0).select("_row.*")
    else:
        hits = _found(docs, grams, block)
        apart = apart.select("_row", *_row_key())
        if hits.count() <= told:
            keys = F.broadcast(hits.select("r1", "r2"))
            rest = apart.join(keys, ["r1", "r2"], "left_anti").select("_row.*")
            found = apart.join(keys, ["r1", "r2"], "left_semi").join(hits, ["r1", "r2"])
        else:
            met = apart.join(hits, ["r1", "r2"], "left")
            rest, found = met.where(F.col("hits").isNull()).select("_row.*"), met.where(F.col("hits").isNotNull())
    found = found.where(F.size("items") < drop_from)
    raw = F.coalesce(F.col("_row.text"), F.lit(""))
    between = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
    pieces = F.regexp_extract_all(raw, F.lit(rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+{between}"), F.lit(0))
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["pos"] - 1, x["pos"] + x["len"] - 2))))
    found = without(found.select("_row", F.size("hits").alias("_n"), gone.alias("_gone"), pieces.alias("_pieces")), "_pieces", "_gone")
    text = F.when(F.col("_n") > 0, F.concat(F.regexp_extract(raw, f"^{between}", 0), F.array_join("_pieces", ""))).otherwise(F.col("_row.text"))
    return rest.unionByName(found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in names]))
