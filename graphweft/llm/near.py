"""Near-dedup by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from MinHash: documents that agree in all `ROWS` values of one of `BANDS` bands. A band's
documents link to the least of them, so links grow with the documents and not with their pairs, and every candidate
component meets in one task, which compares whole shingle sets. A pair of similarity s is a candidate
with probability 1 - (1 - s^ROWS)^BANDS at least: 0.9998 at 0.8.

Defined results: words are lower-cased and split at ASCII white space; a text of fewer words than a shingle is one
shingle; null and wordless texts have no near copies here; a null doc_id comes last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import let_go, stored

SHINGLE, ALIKE = 5, 0.8
BANDS, ROWS = 28, 6
_P = 0x9E3779B97F4A7C15


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    size, digest = min(size, len(words)), xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array([digest(x) for x in words], np.uint64)
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = _mixed(h * np.uint64(_P) + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def band_keys(sets: np.ndarray, factors) -> np.ndarray:
    """One number for each band of a set's MinHash values."""
    a, b = factors
    least = np.full(len(a), (1 << 64) - 1, np.uint64)
    for k in range(0, len(sets), 2048):
        np.minimum(least, (sets[k : k + 2048, None] * a + b).min(axis=0), out=least)
    rows, key = least.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mixed(key * np.uint64(_P) + rows[:, j])
    return key


def _dkey_bands(docs: DataFrame) -> DataFrame:
    """dkey and bands of the documents that have words."""

    def batches(it):
        factors = _factors(BANDS * ROWS)
        for b in it:
            dkeys, bands = [], []
            for d, t in zip(b.column("dkey").to_pylist(), b.column("text")):
                sets = shingles(t.as_py())
                if len(sets):
                    dkeys.append(d)
                    bands.append(band_keys(sets, factors).view(np.int64))
            flat = np.concatenate([np.zeros(0, np.int64), *bands])
            cut = pa.ListArray.from_arrays(pa.array(np.arange(len(dkeys) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(dkeys, pa.string()), cut], ["dkey", "bands"])
        let_go()

    return docs.select(simhash.row_key().alias("dkey"), "text").mapInArrow(batches, "dkey string, bands array<long>")


def copies(sets: list[np.ndarray], alike: float = ALIKE) -> list[int]:
    """Of sets in order, the numbers of those that aren't the first of their component."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            fits = (sizes[left] >= alike * len(sets[x])) & (sizes[left] * alike <= len(sets[x]))
            near = np.zeros(len(left), bool)
            for i in np.flatnonzero(fits):
                y = sets[left[i]]
                at = np.searchsorted(sets[x], y)
                both = int((sets[x][np.minimum(at, len(sets[x]) - 1)] == y).sum())
                near[i] = both >= alike * (len(sets[x]) + len(y) - both) - 1e-9
            found, left = left[near], left[~near]
            out.extend(found.tolist())
            todo.extend(found.tolist())
    return out


def _copies_of_groups(it):
    """Over batches sorted by root, then rank: the dkeys of each group's copies."""
    root, dkeys, sets = None, [], []

    def done():
        gone = [dkeys[i] for i in copies(sets)]
        return pa.RecordBatch.from_arrays([pa.array(gone, pa.string())], ["_dkey"])

    for b in it:
        for r, d, t in zip(b.column("root").to_pylist(), b.column("dkey").to_pylist(), b.column("text")):
            if r != root:
                if len(dkeys) > 1:
                    yield done()
                root, dkeys, sets = r, [], []
            dkeys.append(d)
            sets.append(shingles(t.as_py()))
    if len(dkeys) > 1:
        yield done()
    let_go()


def near_copies(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """_dkey: of the `chosen` rows of docs those that have a near copy of smaller doc_id in their component."""
    own = chosen.select(F.col("_dkey").alias("dkey"))
    node = F.xxhash64("dkey")  # equal nodes of two rows only make one candidate more
    rows = stored(_dkey_bands(docs).join(own, "dkey", "left_semi").select(node.alias("node"), "bands"), "bands").select("node", F.explode("bands").alias("key"))
    least = rows.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_most")).where(F.col("b") < F.col("_most")).drop("_most")
    links = rows.join(least, "key").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
    roots = simhash.components(links)
    members = stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct(), "candidates")
    keyed = docs.select("doc_id", "text", simhash.row_key().alias("dkey")).join(own, "dkey", "left_semi")
    met = keyed.withColumn("node", node).join(members, "node")
    ranked = met.repartition("root").sortWithinPartitions(F.col("root"), F.asc_nulls_last("doc_id"), F.col("dkey"))
    return ranked.select("root", "dkey", "text").mapInArrow(_copies_of_groups, "_dkey string").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without copies: one row of each component of close fingerprints, then one of each component of alike shingle sets."""
    chosen = stored(simhash.chosen(docs), "chosen")
    gone = near_copies(docs, chosen)
    return simhash.pick(docs, chosen.join(gone, "_dkey", "left_anti"))
