"""Probabilistic suffix trees over bytes: counting, growing with divergence tests, and scoring in numpy.

A text is a byte string that ends in END, after DEPTH times END in front, so every byte has DEPTH
bytes of context. Counts of DEPTH+1 bytes (a context and the byte after it) come from all training
texts; those of shorter contexts are their sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 5
END = b"\n"
#: Bytes that are handled at a time: longer texts are cut, with DEPTH bytes of context at each cut.
CHUNK = 1 << 20


def cuts(texts: list[bytes], depth: int = DEPTH, chunk: int = CHUNK):
    """Lists of (text number, bytes with depth bytes of context in front), each of about `chunk` bytes. Texts carry their END already."""
    held, size = [], 0
    for k, t in enumerate(texts):
        t = END * depth + t
        for at in range(0, len(t) - depth, chunk):
            held.append((k, t[at : at + chunk + depth]))
            size += len(held[-1][1])
            if size >= chunk:
                yield held
                held, size = [], 0
    if held:
        yield held


def _joined(pieces, depth):
    """The bytes of all pieces and which positions have their context within their own piece."""
    raw = np.frombuffer(b"".join(p for _, p in pieces), np.uint8)
    lens = np.array([len(p) for _, p in pieces])
    first = np.cumsum(lens) - lens
    own = np.ones(len(raw), bool)
    for d in range(depth):
        own[first + d] = False
    return raw, lens, own


class GramCounts:
    """Counts of windows of depth+1 bytes, as sorted numbers."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.parts, self.size = depth, [], 0

    def add(self, texts: list[bytes]) -> None:
        for pieces in cuts(texts, self.depth, 4 * CHUNK):
            raw, _, own = _joined(pieces, self.depth)
            key = np.zeros(len(raw), np.uint64)
            for d in range(self.depth, -1, -1):
                key[self.depth :] = (key[self.depth :] << np.uint64(8)) | raw[self.depth - d : len(raw) - d]
            keys, n = np.unique(key[own], return_counts=True)
            self.parts.append((keys, n.astype(np.int64)))
            self.size += len(keys)
            if self.size > 1_500_000:
                self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.parts = [(keys[start], np.add.reduceat(n, start))]
        self.size = 0  # what is merged already doesn't count towards the next merge

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge()
        keys, n = self.parts[0]
        return keys.view(np.int64), n


def frequent_levels(grams: DataFrame, depth: int, p_min: float):
    """What a tree can be grown from: for k = 0..depth, all grams of k+1 bytes whose context has at least p_min of all positions.

    grams: (gram, n), n summed over any repeats. Contexts of one length share the positions out, so at most 1/p_min of each length
    pass, with at most 256 next bytes each: the bound on what reaches the driver, whatever the corpus.
    Returns a list by k of (context numbers, byte values, counts).
    """
    from .common import stored

    whole = stored(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = whole.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((1 << 8 * (k + 1)) - 1).cast("long").alias("m")) for k in range(depth + 1)])
    each = whole.select("n", "gram", F.explode(masks).alias("x")).groupBy(F.col("x.k").alias("k"), F.col("gram").bitwiseAND(F.col("x.m")).alias("g")).agg(F.sum("n").alias("n"))
    each = stored(each.select("k", F.shiftrightunsigned("g", 8).alias("ctx"), F.col("g").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n"), "levels")
    often = each.groupBy("k", "ctx").agg(F.sum("n").alias("all")).where(F.col("all") >= p_min * total).select("k", "ctx")
    got = each.join(often, ["k", "ctx"], "left_semi").toPandas().sort_values(["k", "ctx", "sym"])
    return [tuple(part[c].to_numpy(t) for c, t in (("ctx", np.int64), ("sym", np.int64), ("n", np.float64))) for k in range(depth + 1) for part in [got[got["k"] == k]]]


class SuffixTree:
    """Contexts kept by the divergence test, with smoothed next-byte distributions.

    child[node, byte] extends the node's context by one more byte into the past (0: no such node);
    log[node, byte] is the log10 probability of the byte after the node's context. Node 1 is the root.
    """

    def __init__(self, levels, depth: int = DEPTH, weight: float = 2.0, bits: float = 3.0):
        self.depth = depth
        counts0 = np.zeros(256)
        if levels:
            counts0[levels[0][1]] = levels[0][2]
        seen = np.flatnonzero(counts0)
        self.symbol = np.zeros(256, np.int64)  # 0: bytes not seen
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        a = len(seen) + 1
        root = (counts0 + 0.5) / (counts0.sum() + 128)
        base = np.concatenate([[0.5 / (counts0.sum() + 128)], root[seen]])
        rows = {0: (np.zeros(1, np.int64), base[None, :])}
        kept: list[set[int]] = [{0}]
        for k in range(1, depth + 1):
            ctx, sym, n = levels[k] if levels else (np.zeros(0, np.int64),) * 3
            names, where = np.unique(ctx, return_inverse=True)
            table = np.zeros((len(names), a))
            np.add.at(table, (where, self.symbol[sym]), n)
            up_names, up = rows[k - 1]
            parent = np.searchsorted(up_names, names & ((1 << 8 * (k - 1)) - 1))
            ok = (parent < len(up_names)) & (up_names[np.minimum(parent, len(up_names) - 1)] == names & ((1 << 8 * (k - 1)) - 1)) if len(names) else np.zeros(0, bool)
            names, table, parent = names[ok], table[ok], parent[ok]
            total = table.sum(axis=1, keepdims=True)
            p = (table + weight * up[parent]) / (total + weight)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(table > 0, table * np.log2(table / total / up[parent]), 0).sum(axis=1)
            passed = gain > bits * (table > 0).sum(axis=1) + 8  # what the distribution saves against what it costs to state it
            rows[k] = (names, p)
            kept.append(set(names[passed].tolist()))
        for k in range(depth, 1, -1):  # a kept context's suffixes are on the way to it
            kept[k - 1] |= {c & ((1 << 8 * (k - 1)) - 1) for c in kept[k]}
        number, logs = {(0, 0): 1}, [np.zeros((1, a)), np.log10(base)[None, :]]
        for k in range(1, depth + 1):
            own = np.array(sorted(kept[k]), np.int64)
            if len(own):
                names, p = rows[k]
                logs.append(np.log10(p[np.searchsorted(names, own)]))
                for c in own.tolist():
                    number[k, c] = len(number) + 1
        self.log = np.concatenate(logs).astype(np.float32)
        child = np.zeros(self.log.shape, np.int32)
        for (k, c), i in number.items():
            if k:
                child[number[k - 1, c & ((1 << 8 * (k - 1)) - 1)], self.symbol[c >> 8 * (k - 1)]] = i
        self.child, self.width = child.ravel(), a
        self.log = self.log.ravel()

    @property
    def nodes(self) -> int:
        return len(self.log) // self.width - 1

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, each byte given the longest kept suffix of what precedes it."""
        out = np.zeros(len(texts))
        d, a = self.depth, self.width
        symbol = self.symbol.astype(np.int32)
        for pieces in cuts(texts, d, CHUNK // 2):
            raw, lens, _ = _joined(pieces, d)
            s = symbol[raw]
            node = np.ones(len(s), np.int32)
            here = node.copy()
            for k in range(1, d + 1):
                here = here[1:] if k == 1 else here[1:]
                here = self.child[here * a + s[: len(s) - k]]
                np.copyto(node[k:], here, where=here > 0)
            got = self.log[node * a + s].astype(np.float64)
            first = np.cumsum(lens) - lens
            for j in range(d):
                got[first + j] = 0.0
            np.add.at(out, [k for k, _ in pieces], np.add.reduceat(got, first))
        return out


def gram_batches(column: str, to_bytes):
    """For mapInArrow: the counts of a partition's texts as (gram, n)."""

    def batches(it):
        counts = GramCounts()
        for b in it:
            counts.add([x for x in (to_bytes(t.as_py()) for t in b.column(column)) if x is not None])
        keys, n = counts.result()
        for at in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["gram", "n"])

    return batches
