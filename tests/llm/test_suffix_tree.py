"""The word tree against a plain version in dictionaries, and the sums of its distributions."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweft.llm import suffix_tree as st

SMALL = "/root/testdata/sf0.001"


class Plain:
    def __init__(self, rows, single, least, head_share):
        self.train = [(t or "").encode().lower().split() + [b"\n"] for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
        self.c = Counter(w for t in self.train for w in t)
        total = sum(self.c.values())
        self.single = {w for w, k in self.c.items() if k >= single and k >= max(1, total * head_share)} | {b"\n"}
        n = Counter({s: 0 for s in ["s%d" % i for i in range(st.SHARED)] + list(self.single)})
        once = Counter()
        for w, k in self.c.items():
            n[self.sym(w)] += k
            once[self.sym(w)] += k == 1
        self.n, self.unseen = n, {s: 0 if s in self.single else max(once[s], 0.5) for s in n}
        self.p0 = {s: (k + 0.5) / (total + 0.5 * len(n)) for s, k in n.items()}
        seqs = [[b"\n"] + [self.sym(w) for w in t] for t in self.train]
        self.kept = {(): None}
        seen = {(s,): k for s, k in n.items()}
        depth = 0
        while True:
            depth += 1
            can = {x for x, k in seen.items() if k >= least and x[1:] in self.kept and len(x) == depth}
            grams = {}
            for s in seqs:
                for i in range(depth, len(s)):
                    if (x := tuple(s[i - depth : i])) in can:
                        grams.setdefault(x, Counter())[s[i]] += 1
            fresh = {}
            for x, g in grams.items():
                t = sum(g.values())
                if sum(k * math.log2(k / t / self.prob(x[1:], s)) for s, k in g.items()) > 3 * len(g) + 8:
                    fresh[x] = (g, t)
            if not fresh:
                break
            self.kept |= fresh
            seen = {(*x, s): k for x, g in grams.items() for s, k in g.items()}
        self.depth = depth

    def sym(self, w):
        return w if w in self.single else "s%d" % (zlib.crc32(w[:2]) % st.SHARED)

    def prob(self, x, s):
        while x not in self.kept:
            x = x[1:]
        if not x:
            return self.p0[s]
        g, t = self.kept[x]
        return (g[s] + st.WEIGHT * self.prob(x[1:], s)) / (t + st.WEIGHT)

    def within(self, w):
        s = self.sym(w)
        return (self.c[w] or (1 if s in self.single else self.unseen[s])) / ((self.n[s] + self.unseen[s]) or 1)

    def score(self, t):
        out, past = 0.0, (b"\n",)
        for w in (t or "").encode().lower().split() + [b"\n"]:
            s = self.sym(w)
            out += math.log10(self.prob(past, s) * self.within(w))
            past = (*past, s)[-self.depth :]
        return out


@pytest.mark.parametrize("most,head_share", [(1_000_000, 1e-6), (40, 2e-3)])
def test_scores_are_those_of_the_plain_tree(spark, most, head_share):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.when(F.col("doc_id") != 3, F.col("text")).alias("text"))
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    plain = Plain(rows, 40, 25, head_share)
    assert plain.depth > 3 and len(plain.kept) > 50
    got = {r["doc_id"]: r["score"] for r in st.score_texts(d, head_share=head_share, single=40, least=25, most=most).collect()}
    for i, t in rows:
        want = plain.score(t)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), (i, got[i], want)
    for x in [(), *list(plain.kept)[:: len(plain.kept) // 10]]:
        known = sum(plain.prob(x, plain.sym(w)) * plain.within(w) for w in plain.c)
        unseen = sum(plain.prob(x, s) * u / (plain.n[s] + u) for s, u in plain.unseen.items() if u)
        assert abs(known + unseen - 1) < 1e-9


def test_words_are_symbols_and_rest_and_hot_contexts_are_dealt(spark, monkeypatch):
    """By default each word seen twice is a symbol of its own; buckets of hot contexts and of unknown rows change nothing."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    plain = Plain(rows, 2, 25, 0)
    monkeypatch.setattr(st, "HOT", 300)
    monkeypatch.setattr(st, "BUCKET", 1000)
    got = {r["doc_id"]: r["score"] for r in st.score_texts(d, least=25, most=200).collect()}
    assert len(plain.single) > 5000 and max(plain.n[s] for s in plain.single) > 1000
    for i, t in rows:
        want = plain.score(t)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), (i, got[i], want)


def test_counts_of_several_spans_merge():
    flat = np.array([0, 5, 6, 5, 6, 5, 0], np.int32)
    grams = st.Grams(st.dealer(True, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))
    for _ in range(3):
        walk = st.Walk(np.arange(7), flat, np.arange(1, 7))
        walk.grow()
        grams.add(walk, flat)
    got = {}
    for b in grams.rows():
        for c, s, n in zip(b.column("ctx").to_numpy().view(np.uint64).tolist(), b.column("syms").to_pylist(), b.column("ns").to_pylist()):
            got[c] = dict(zip(np.frombuffer(s, np.uint32).tolist(), np.frombuffer(n, np.uint32).tolist(), strict=True))
    key = st.mixed(np.array([0, 5, 6])).tolist()
    assert got == {key[0]: {5: 3}, key[1]: {6: 6, 0: 3}, key[2]: {5: 6}} and not list(grams.rows())


@pytest.mark.parametrize("most", [1_000_000, 5000, 5])
def test_training_texts_ask_once_for_a_position(spark, monkeypatch, most):
    """What is asked for grows with the positions of training texts, not with the levels they pass."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    seen = []
    monkeypatch.setattr(st, "walk_texts", lambda read, symbols, levels, rest, whole=st.walk_texts: seen.append((read, symbols, levels, rest)) or whole(read, symbols, levels, rest))
    st.score_texts(d, least=25, most=most).schema
    monkeypatch.setattr(st, "CHUNK", 1000)
    read, symbols, levels, rest = seen[0]
    got = read.where("not held_out").select("rid", "held_out", "syms").toArrow()
    rows = [r for b in st.asks(got.to_batches(), symbols.kind, np.log10(symbols.p), levels, 7) for r in b.to_pylist()]
    assert len(levels) > 3 and bool(rest) == (most < 1_000_000)
    keys = {what: sum(len(r["keys"]) // 8 for r in rows if r["kind"] == what) for what in (st.FACTORS, st.SHARES)}
    positions = sum(len(x) // np.dtype(symbols.kind).itemsize for x in got.column("syms").to_pylist())
    assert keys[st.SHARES] <= positions and (keys[st.SHARES] > 0) == (most < 1_000_000)
    assert all(level.all_ctx for level in levels) == (keys[st.FACTORS] == 0) == (most > 5)
    for r in rows:
        if r["kind"] in keys:
            assert st.unpacked(r["lens"], np.uint32).sum() == len(r["keys"]) // 8 and set(np.cumsum(st.unpacked(r["rids"], np.int64)).tolist()) <= set(got.column("rid").to_pylist())


def test_small_cells_are_read_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 32) - 1, 5], np.uint32)
    cuts = np.array([1, 1, 4, 9, 9, 11])
    got, lens = st.small_values(st.small_cells(values, cuts))
    assert got.tolist() == values[1:].tolist() and lens.tolist() == [0, 3, 5, 0, 2]
    assert [len(x) for x in st.small_values(st.small_cells(values, cuts[:1]))] == [0, 0]
    n, t, q = np.array([1, 1, 7, 10**6]), np.array([200, 300, 200, 2 * 10**6]), np.array([1e-9, 0.9, 0.03, 0.5])
    p = (n + st.WEIGHT * q) / (t + st.WEIGHT)
    value = np.log10(p / q) - np.log10(st.WEIGHT / (t + st.WEIGHT))
    assert np.abs(st.share(n, value.astype(np.float32)) / (t + st.WEIGHT) / p - 1).max() < 1e-6


def test_texts_are_cut_as_their_bytes():
    """Many texts cut at once have the words that lower() and split() of their bytes give, in pieces that cut no text."""
    texts = ["  Ab\x1c c\td\x0bé\x85x\xa0y  ", "", None, "\n", "q\x00 r\x1f", "É İ ab AB\r\nab", "a" * 50, "x " * 30]
    want = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    for some in (slice(0, 8), slice(2, 5), slice(3, 3)):
        lens, own, i, text = st.cut_words(pa.array(texts, pa.string())[some])
        assert lens.tolist() == [len(w) for w in want[some]] and own[-1].as_py() == b"\n" and len(set(own.to_pylist())) == len(own)
        assert [own[k].as_py() for k in i.tolist()] == [x for w in want[some] for x in w]
        assert text.tolist() == [k for k, w in enumerate(want[some]) for _ in w]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for most in (1, 40, 1000):
        got = [p.column("text").to_pylist() for p in st.by_bytes(batch, most)]
        assert sum(got, []) == texts and (len(got) == 1) == (most == 1000)
        assert all(sum(len((t or "").encode()) for t in p[1:]) <= most for p in got)
    assert not list(st.by_bytes(batch.slice(0, 0)))


def test_few_words_are_held_while_they_are_counted(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"A{i % 7} b  B c{i}") for i in range(60)] + [(60, None)], "doc_id long, text string")
    want = Counter(w for i, t in [tuple(r) for r in d.collect()] if not st.is_held_out(i) for w in (t or "").encode().lower().split() + [b"\n"])
    for flush in (200_000, 3):
        monkeypatch.setattr(st, "FLUSH", flush)
        assert {bytes(r["word"]): r["c"] for r in st.count_words(d).collect()} == want


@pytest.mark.parametrize("hot", [1 << 20, 300])
def test_contexts_of_a_block_leave_a_task_in_one_row(spark, monkeypatch, hot):
    """However many contexts pass, a task hands on few rows of counts; blocks change no score."""
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    plain = Plain(rows, 2, 25, 0)
    sizes = []

    def counted(texts, kind, sent, hot, blocks, whole=st.count_level):
        got = whole(texts, kind, sent, hot, blocks)
        part = got.withColumn("n", F.length("ctx") / 8).groupBy(F.spark_partition_id()).agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()
        sizes.append((blocks, max(r["rows"] for r in part), sum(r["n"] for r in part)))
        return got

    monkeypatch.setattr(st, "count_level", counted)
    monkeypatch.setattr(st, "HOT", hot)
    monkeypatch.setattr(st, "BLOCK", 5_000)
    got = {r["doc_id"]: r["score"] for r in st.score_texts(d, least=25, most=5000).collect()}
    blocks, most, contexts = sizes[0]
    assert blocks > 5 and contexts > 40 * blocks and all(most <= blocks + 1 for blocks, most, _ in sizes)
    for i, t in rows:
        want = plain.score(t)
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), (i, got[i], want)


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_sums_of_neighbouring_texts_leave_in_one_row(monkeypatch, chunk):
    monkeypatch.setattr(st, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    rid, v = (rng.integers(0, 2, 5000) << 33) + rng.integers(0, 1000, 5000), rng.random(5000)
    monkeypatch.setattr(st, "answered", lambda it: ((rid[k : k + 70], v[k : k + 70]) for k in range(0, 5000, 70)))
    rows = list(st.answers([]))
    got = {r["rid"]: r["symbols_score"] for b in st.summed([*rows, *rows]) for r in b.to_pylist()}
    assert (sum(len(b) for b in rows) == 8) == (chunk > 100) and len(got) == len(set(rid.tolist()))
    assert all(abs(got[k] - 2 * v[rid == k].sum()) < 1e-9 for k in got)
    assert not list(st.summed([])) and not list(st.summed([rows[0].slice(0, 0)]))


def test_squeezed_rows_are_read_back():
    """What answers asked keys takes fewer bytes in the shuffle; asked keys stay as they are."""
    ctx, n = pa.array(range(1, 3001), pa.int64()), np.arange(3001)
    level = pa.RecordBatch.from_arrays([ctx, pa.array([500] * 3000), st.small_cells(n[1:], n), st.small_cells(n[1:] * 0 + 1, n), st.cells(np.ones(3000, np.float32), n)], ["ctx", "t", "syms", "ns", "value"])
    (pk, value, k, _) = (np.concatenate(x) for x in zip(*st.pairs([level], 0, 9)))
    order = np.argsort(pk)
    steps, rids = st.packed(np.diff(pk[order], prepend=np.uint64(0))), np.arange(3000)
    one = lambda x: pa.array([x], pa.binary())
    told = st._sought([0], st.TOLD, keys=one(steps), vals=one(st.packed(value[order])), ns=st.small_cells(k[order], np.array([0, 3000])))
    asked = st._sought([0], st.SHARES, keys=one(pk.tobytes()), rids=one(st.packed(np.diff(rids, prepend=0))), lens=one(st.packed(np.ones(3000, np.uint32))))
    rows = [*st.squeezed([told], True), *st.squeezed([asked], False)]
    assert sum(r.nbytes for r in rows) < 0.75 * (told.nbytes + asked.nbytes) and rows[1].column("keys") == asked.column("keys")
    (rid, v), = st.answered(rows)
    assert rid.tolist() == rids.tolist() and np.allclose(v, np.log10(st.share(1, np.float32(1))))
