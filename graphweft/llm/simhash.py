"""SimHash near-dedup: 64-bit fingerprints linked within three bits, found by covering hashing.

Every fingerprint enters 15 tables. Table v keeps the bits whose 4-bit code has odd overlap
with v; for any three differing bits some v is even with all three of their codes, so every
pair within the radius meets in a table: no link is missed. Buckets are compared in sorted
Arrow batches; a large one yields a spanning forest of its links instead of its pairs, and
one beyond `LARGEST` is spread over the cluster by its members' one- and two-bit variants.
Components come from alternating large-star and small-star rounds.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal
ids or repeated rows get a row each; a null doc_id is never a component's id unless all are
null; columns other than doc_id and text are ignored by `near_duplicates` and survive
`keep_one`; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHINGLE, RADIUS, BITS = 3, 3, 64
#: Members up to which a bucket's pairs are compared directly; more are linked by a search that yields a forest.
SMALL = 64
#: Members up to which one task holds a bucket.
LARGEST = 4096
#: A fingerprint with over 1/HOT of all rows is looked up in a table of at most HOT entries, not by shuffle.
HOT = 1000


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """2^(radius+1) - 1 bit masks: bit i has the non-zero code 1 + i mod (2^(radius+1) - 1), and mask v keeps it if code & v has odd parity."""
    n = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit i is set if over half of the shingles' hashes have it."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs' columns without text, and fp (the fingerprint as a signed long)."""
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def batches(it):
        for b in it:
            cols = {f.name: b.column(f.name) for f in keep}
            fp = [_signed(fingerprint(t.as_py(), size)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(fp, pa.int64())], [*cols, "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "fp long"])
    return docs.select(*[f.name for f in keep], "text").mapInArrow(batches, schema)


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each member with the root of its connected component, roots left out."""
    left, a, b = fps, [], []
    while len(left):
        root, left, todo = left[0], left[1:], [left[0]]
        while todo and len(left):
            near = np.bitwise_count(left ^ todo.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                a.append(found)
                b.append(np.full(len(found), root))
                todo.extend(found)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(group: np.ndarray, fps: np.ndarray, radius: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups (runs of equal numbers): pairs of small groups, forests of others."""
    size = np.bincount(group)
    plain = size[group] <= small
    g, f, a, b = group[plain], fps[plain], [], []
    for d in range(1, int(min(small, size.max(initial=0)))):
        hit = (g[:-d] == g[d:]) & (np.bitwise_count(f[:-d] ^ f[d:]) <= radius)
        a.append(f[:-d][hit])
        b.append(f[d:][hit])
    for k in np.flatnonzero(size > small):
        x, y = _forest(fps[group == k], radius)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _bucket_links(radius: int, small: int):
    """Over batches sorted by (t, key): the links within each bucket; the last bucket of a batch waits for the next."""

    def batches(it):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]

        def out(t, key, fp):
            if len(fp) < 2:
                return None
            group = np.concatenate([[0], np.cumsum((t[1:] != t[:-1]) | (key[1:] != key[:-1]))])
            a, b = _links(group, fp, radius, small)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in it:
            new = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
            t, key, fp = (np.concatenate(x) for x in zip(held, new))
            if not len(fp):
                continue
            last = (t == t[-1]) & (key == key[-1])
            cut = len(t) - int(last.sum())
            if got := out(t[:cut], key[:cut], fp[:cut]):
                yield got
            held = [t[cut:], key[cut:], fp[cut:]]
        if got := out(*held):
            yield got

    return batches


def _variant_links(hot: DataFrame, radius: int) -> DataFrame:
    """Links within buckets of any size, linear in their members.

    A member's variants have up to ceil(r/2) of the table's free bits flipped. Members that meet in a variant, one
    of them with floor(r/2) flips at most, are within the radius; so all that meet there link to the
    least of those, and every pair within the radius meets somewhere.
    """
    masks = covering_masks(radius)
    near, far = radius // 2, radius - radius // 2

    def flips(mask: int) -> tuple[np.ndarray, np.ndarray]:
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        seen, n = [0], [0]
        last = [(0, -1)]
        for k in range(1, far + 1):
            last = [(x | bit, j) for x, i in last for j, bit in enumerate(free) if j > i]
            seen += [x for x, _ in last]
            n += [k] * len(last)
        return np.array(seen, np.uint64), np.array(n)

    def batches(it):
        for b in it:
            for t, fp in zip(b.column("t").to_pylist(), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)):
                x, n = flips(masks[t])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((x ^ fp).view(np.int64)), pa.array(np.full(len(x), fp).view(np.int64)), pa.array(n <= near)], ["t", "v", "fp", "centre"])

    rows = hot.select("t", "fp").mapInArrow(batches, "t int, v long, fp long, centre boolean")
    centres = rows.where("centre").groupBy("t", "v").agg(F.min("fp").alias("b"))
    return rows.join(centres, ["t", "v"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b").distinct()


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL, largest: int = LARGEST) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of fps that connect all pairs within the radius."""
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    sizes = rows.groupBy("t", "key").count().where(F.col("count") > largest)
    hot = stored(sizes.select("t", "key"), "hot-buckets")
    plain = rows
    if not hot.isEmpty():
        plain = rows.join(hot, ["t", "key"], "left_anti")
    sorted_rows = plain.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = sorted_rows.mapInArrow(_bucket_links(radius, small), "a long, b long")
    if not hot.isEmpty():
        found = found.unionByName(_variant_links(rows.join(hot, ["t", "key"], "left_semi"), radius))
    return found


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't its component's least: large-star and small-star until nothing changes."""

    def large_star(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where(F.col("b") > F.col("a")).join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e):
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = stored(small_star(large_star(now)), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def assign(prints: DataFrame, order: list[str], **how) -> DataFrame:
    """prints (with fp) and `least`: the least struct of the `order` columns in each row's component."""
    who = F.struct(*order)
    first = F.min(F.when(F.col(order[0]).isNotNull(), who))
    fps = stored(prints.groupBy("fp").agg(F.coalesce(first, F.min(who)).alias("own"), F.count("*").alias("n")), "distinct-fps")
    roots = components(links(fps.select("fp"), **how))
    tagged = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "n", "own", F.coalesce("root", "fp").alias("root"))
    best = tagged.where(F.col(f"own.{order[0]}").isNotNull()).groupBy("root").agg(F.min("own").alias("least"))
    known = stored(tagged.join(best, "root", "left").select("fp", "n", F.coalesce("least", "own").alias("least")), "components")
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = known.where(F.col("n") * HOT > total).select("fp", F.col("least").alias("hot"))  # HOT rows at most
    rows = prints.join(F.broadcast(hot), "fp", "left")
    cold = rows.where(F.col("hot").isNull()).drop("hot").join(known.select("fp", "least"), "fp")
    return rows.where(F.col("hot").isNotNull()).withColumnRenamed("hot", "least").unionByName(cold)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    prints = stored(fingerprints(docs.select("doc_id", "text")), "fps")
    return assign(prints, ["doc_id"], **how).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"))


def row_key():
    return F.md5(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("text")).cast("binary"))


def chosen(docs: DataFrame, **how) -> DataFrame:
    """_dkey: the row key of the smallest doc_id of each component."""
    prints = stored(fingerprints(docs.select("doc_id", row_key().alias("dkey"), "text")), "fps")
    return assign(prints, ["doc_id", "dkey"], **how).select(F.col("least.dkey").alias("_dkey")).distinct()


def pick(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row of each key (_dkey)."""
    apart = docs.select(F.struct("*").alias("_row"), row_key().alias("_dkey"))
    met = apart.join(keys, "_dkey", "left_semi").withColumn("_copy", F.row_number().over(Window.partitionBy("_dkey").orderBy("_dkey")))
    return met.where(F.col("_copy") == 1).select("_row.*")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (repeated rows: one of them)."""
    return pick(docs, chosen(docs, **how))
