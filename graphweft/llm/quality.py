"""Quality classifier: random-indexing word vectors pooled per document and a two-layer network.

Random indexing gives each word a sparse random index vector; a word's own vector is the sum of the
index vectors of its neighbours in all documents, scaled to length one. Every word seen `LEAST`
times or more in the corpus has its own vector; rarer ones share one for each shape (case,
digits, marks). Words are runs of letters, of digits and of marks, and line ends. A document is the mean of its words' vectors and three facts of its
text. Texts are cut into words in numpy, many at a time; equal words of these are told by 64-bit
sums over their characters, and each distinct one is a string once. The network is trained on four fifths of a labelled sample; the temperature of its
probabilities is fitted on the other fifth.

Vectors are summed by task and word, then by word, and stored as a table. Up to `MOST` words, the
most frequent, go to every task; the others of a text meet their vectors by a shuffled join. Only the
network is fitted on a sample: at most `SAMPLE` labelled documents that aren't held out, one
row of each doc_id. Every document is scored, in whole.

Defined results: null and empty texts have a zero vector and are scored from it; a null doc_id
hashes as the empty text; rows with repeated doc_id get a row each; of repeated labels the higher counts; columns other than doc_id
and text are ignored; an empty table gives no rows; without labels of both kinds the score is
the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, stored
from .suffix_tree import bit_map, in_map, mixed, runs

SAMPLE, DIM, NONZERO, REACH, LEAST, MOST = 4000, 32, 4, 2, 5, 1_000_000
#: Words after which a task hands its sums on, and characters that are cut together.
FLUSH, SPAN = 300_000, 5 << 17
#: What words are runs of; a line end is a word by itself.
KINDS = (r"[^\W\d_]+", r"\d+", r"[^\w\s]+", "_+", r"\n")
_TOKENS = re.compile("|".join(KINDS)).findall
#: What stands for the rare words of a shape; no token has a blank.
SHAPES = [f" {k}" for k in range(6)]


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, its kind (from 1; 0: in no word) and a random number."""
    every, kind = "".join(map(chr, range(0x110000))), np.zeros(0x110000, np.uint8)
    for k, pattern in enumerate(KINDS, 1):
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    return kind, mixed(np.arange(0x110000))


@dataclass
class Cut:
    """Texts cut into words."""

    names: list[str]  # the distinct ones
    number: np.ndarray  # of each word, which of names it is
    lens: np.ndarray  # words of each text
    order: np.ndarray  # the words by name
    first: np.ndarray  # where in `order` each name starts

    @property
    def n(self) -> np.ndarray:
        """Words of each name."""
        return np.diff(self.first, append=len(self.order))


def cut(texts: list[str]) -> Cut:
    kinds, random = _characters()
    joined = " ".join(texts)  # no word has a blank
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[raw]
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == len(KINDS))])) if len(raw) else np.zeros(0, np.int64)
    size = np.diff(edge, append=len(raw))
    own = kind[edge] > 0
    start, size = edge[own], size[own]
    power = np.cumprod(np.full(int(size.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.zeros(len(start), np.uint64)
    for at in range(0, len(start), 1 << 17):  # a long text's words in parts
        n, begin = size[at : at + (1 << 17)], start[at : at + (1 << 17)]
        to = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(to, n)
        sums[at : at + len(n)] = np.add.reduceat(random[raw[np.repeat(begin, n) + place]] * power[place], to)
    order = np.argsort(sums)
    fresh = runs(sums[order])
    number = np.zeros(len(start), np.int64)
    mark = np.zeros(len(start), np.int64)
    mark[fresh[1:]] = 1
    number[order] = np.cumsum(mark)
    where = order[fresh]
    names = [joined[x:y] for x, y in zip(start[where].tolist(), (start + size)[where].tolist())]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return Cut(names, number, np.diff(np.searchsorted(start, ends), prepend=0), order, fresh)


def tokens_of(text: str | None) -> list[str]:
    got = cut([text or ""])
    return [got.names[k] for k in got.number.tolist()]


def shape(token: str) -> int:
    if token[0].isalpha():
        return 0 if token.islower() else 1 if len(token) > 1 and token.isupper() else 2
    return 3 if token[0].isdigit() else 4 if len(token) == 1 else 5


def word_hash(token: str) -> int:
    """As Spark's xxhash64."""
    import xxhash

    return xxhash.xxh64_intdigest(token.encode(errors="replace"), 42)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """NONZERO entries of +1 or -1 in each row, at places that the word's hash tells (equal places add up)."""
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros((len(x), DIM), np.int8)
    rows = np.arange(len(x))
    for j in range(NONZERO):
        out[rows, (x >> np.uint64(64 - 5 * (j + 1))).astype(np.int64) % DIM] += np.where((x >> np.uint64(20 + j)) & np.uint64(1), 1, -1).astype(np.int8)
    return out


class Sums:
    """Of a task's words, counts and sums of neighbours' index vectors."""

    def __init__(self, often: np.ndarray):
        self.often = often  # a map of the words seen often enough; rare ones that it lets through join their shape when all is summed
        self.clear()

    def clear(self):
        self.at: dict[str, int] = {}  # words that the map lets through; others are looked at anew each time
        self.names = list(SHAPES)
        self.own, self.n, self.used = np.zeros((1024, DIM), np.int32), np.zeros(1024, np.int64), len(SHAPES)
        self.index = np.zeros((1024, DIM), np.int8)  # of the words, then of a span's rare ones
        self.index[: self.used] = index_vectors(np.zeros(len(SHAPES), np.uint64))

    def add(self, got: Cut) -> None:
        if not len(got.number):
            return
        slot = np.array([self.at.get(t, -1) for t in got.names], np.int64)
        fresh = np.flatnonzero(slot < 0)
        h = np.array([word_hash(got.names[k]) for k in fresh.tolist()], np.uint64)
        ok = in_map(self.often, h)
        new, rare = fresh[ok], fresh[~ok]
        names = [got.names[k] for k in new.tolist()]
        slot[new] = np.arange(self.used, self.used + len(new))
        self.at.update(zip(names, slot[new].tolist()))
        self.names += names
        self.used += len(new)
        if self.used > len(self.n):
            more = max(self.used, len(self.n) + len(self.n) // 4) - len(self.n)
            self.own, self.n = np.concatenate([self.own, np.zeros((more, DIM), np.int32)]), np.concatenate([self.n, np.zeros(more, np.int64)])
        if self.used > len(self.index):
            self.index = np.concatenate([self.index, np.zeros((self.used + len(self.index) // 4 - len(self.index), DIM), np.int8)])
        self.index[self.used - len(new) : self.used] = index_vectors(h[ok])
        index = np.zeros((len(slot) + 1, DIM), np.int8)  # of the names; the last row stands between texts
        index[:-1] = self.index[np.maximum(slot, 0)]
        index[rare] = index_vectors(h[~ok])
        place = np.arange(len(got.number)) + REACH * (1 + np.repeat(np.arange(len(got.lens)), got.lens))
        spread = np.full(len(got.number) + REACH * (1 + len(got.lens)), len(slot))
        spread[place] = got.number
        x = index[spread]
        near = np.full((len(x), DIM), BIAS, np.int8)
        for r in range(1, REACH + 1):
            near[r:] += x[:-r]
            near[:-r] += x[r:]
        sums, n = added(near, place[got.order], got.first), got.n
        named = np.flatnonzero(slot >= 0)
        self.own[slot[named]] += sums[named]
        self.n[slot[named]] += n[named]
        kind = np.array([shape(got.names[k]) for k in rare.tolist()], np.int64)
        for k in range(len(SHAPES)):
            some = rare[kind == k]
            self.own[k] += sums[some].sum(axis=0)
            self.n[k] += n[some].sum()

    def rows(self):
        """Record batches of words, counts and sums: the lowest eight bits, signed, and, where that isn't all, what is above them."""
        for at in range(0, self.used, 1 << 14):
            part = slice(at, min(self.used, at + (1 << 14)))
            own = self.own[part]
            low = (own + 128 & 255) - 128
            high = own - low >> 8
            upper = [high[k].tobytes() if o else None for k, o in enumerate(high.any(axis=1).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(self.names[part], pa.string()), pa.array(self.n[part]), _binary(low.astype(np.int8)), pa.array(upper, pa.binary())], ["token", "n", "low", "high"])


#: What makes sums of neighbours positive, and how many of them sixteen bits hold.
BIAS, STRETCH = 2 * REACH * NONZERO, (1 << 16) // (4 * REACH * NONZERO + 1)


def added(near: np.ndarray, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums, less their bias, of the stretches of rows that start at `first`: four numbers of sixteen bits added as one, in parts that can't overflow."""
    n = np.diff(first, append=len(rows))
    parts = -(-n // STRETCH)
    own = np.repeat(np.arange(len(n)), parts)
    start = first[own] + STRETCH * (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts))
    packed = near[rows].view(np.uint64)
    out, low = np.zeros((len(start), DIM), np.int32), np.uint64(0x00FF00FF00FF00FF)
    for k in range(2):
        out[:, k::2] = np.add.reduceat(packed >> np.uint64(8 * k) & low, start, axis=0).view(np.uint16)
    if len(start) > len(n):
        to = np.cumsum(parts) - parts
        whole = out[to]
        for k in np.flatnonzero(parts > 1).tolist():
            whole[k] = out[to[k] : to[k] + parts[k]].sum(axis=0)
        out = whole
    return out - (BIAS * n[:, None]).astype(np.int32)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary column."""
    offsets = (np.arange(len(x) + 1) * x.shape[1] * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equally long values as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), DIM)


def _texts(it, size: int):
    """Batches' texts in lists of about `size` characters; a longer text stands alone."""
    held, n = [], 0
    for b in it:
        for t in b.column("text"):
            held.append(t.as_py() or "")
            n += len(held[-1])
            if n >= size:
                yield held
                held, n = [], 0
    yield held


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def batches(it):
        tally: dict[str, int] = {}

        def flush():
            got = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["token", "n"])
            tally.clear()
            return got

        for texts in _texts(it, SPAN):
            got = cut(texts)
            for t, n in zip(got.names, got.n.tolist()):
                tally[t] = tally.get(t, 0) + n
            if len(tally) > FLUSH:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(batches, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def sum_vectors(docs: DataFrame, often: np.ndarray, least: int) -> DataFrame:
    """(token, n, vec, raw): each word's count and sum, of whole length one in 127ths; of shapes and of words below `least` the sum itself too."""
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def parts(it):
        sums = Sums(sent.value)
        for texts in _texts(it, SPAN):
            sums.add(cut(texts))
            if sums.used > FLUSH:
                yield from sums.rows()
                sums.clear()
        yield from sums.rows()

    def whole(it):
        held = None  # the last word's count and sum: more of it may follow
        for b in it:
            tokens = b.column("token").to_pylist()
            sums, n = _matrix(b.column("low"), np.int8).astype(np.int64), b.column("n").to_numpy()
            for k, x in enumerate(b.column("high").to_pylist()):
                if x is not None:
                    sums[k] += np.frombuffer(x, np.int32).astype(np.int64) << 8
            if held is not None:
                tokens, n, sums = [held[0], *tokens], np.concatenate([[held[1]], n]), np.concatenate([held[2][None], sums])
            if not tokens:
                continue
            start = np.flatnonzero([True, *(x != y for x, y in zip(tokens, tokens[1:]))])
            n, sums = np.add.reduceat(n, start), np.add.reduceat(sums, start, axis=0)
            names = [tokens[k] for k in start.tolist()]
            held = names[-1], n[-1], sums[-1]
            yield done(names[:-1], n[:-1], sums[:-1])
        if held is not None:
            yield done([held[0]], np.array([held[1]]), held[2][None])

    def done(names, n, sums):
        raw = (n < least) | np.array([x in SHAPES for x in names], bool)
        packed = [s.tobytes() if r else None for s, r in zip(sums, raw.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), _binary(quantised(sums)), pa.array(packed, pa.binary())], ["token", "n", "vec", "raw"])

    rows = docs.select("text").mapInArrow(parts, "token string, n long, low binary, high binary").where("n > 0")
    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(whole, "token string, n long, vec binary, raw binary")


def _shapes(rows: DataFrame) -> np.ndarray:
    """Vectors of the shapes from the sums of shapes and rare words."""

    def batches(it):
        own = np.zeros((len(SHAPES), DIM), np.int64)
        for b in it:
            for t, x in zip(b.column("token").to_pylist(), b.column("raw").to_pylist()):
                own[SHAPES.index(t) if t in SHAPES else shape(t)] += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["own"])

    total = np.zeros((len(SHAPES), DIM), np.int64)
    for r in rows.select("token", "raw").mapInArrow(batches, "own binary").toLocalIterator():  # a row for each task
        total += np.frombuffer(r["own"], np.int64).reshape(total.shape)
    return quantised(total)


def quantised(v: np.ndarray) -> np.ndarray:
    """Rows of whole length one, in 127ths."""
    v = v.astype(float)
    return np.rint(127 * v / np.maximum(1e-9, np.sqrt((v * v).sum(axis=1, keepdims=True)))).astype(np.int8)


@dataclass
class Vectors:
    """Words that every task knows with their vectors, and the table of the others (None if there are none)."""

    at: dict[str, int]
    table: np.ndarray
    often: np.ndarray
    rest: DataFrame | None

    def sent(self, spark):
        return spark.sparkContext.broadcast((self.at, self.table, self.often if self.rest is not None else None))


def learn_vectors(docs: DataFrame, least: int = LEAST, most: int = MOST) -> Vectors:
    """Vectors of all words of docs seen `least` times or more, and of the shapes of the others."""
    often = stored(count_tokens(docs).where(F.col("n") >= least), "words")
    bits = bit_map(often.select(F.xxhash64("token").alias("h")), "h")
    named = stored(sum_vectors(docs, bits, least), "vectors")
    rare = (F.col("n") < least) | F.col("token").isin(SHAPES)
    shapes, named = _shapes(named.where(rare)), named.where(~rare)
    size, total = named.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    edge = 0 if size <= most else -(-total // most)
    got = named.where(F.col("n") >= edge).select("token", "vec").toArrow()
    own = {t: np.frombuffer(v, np.int8) for t, v in zip(got.column("token").to_pylist(), got.column("vec").to_pylist())}
    words = sorted(own)
    table = np.concatenate([shapes, np.stack([own[t] for t in words]) if words else np.zeros((0, DIM), np.int8), np.zeros((1, DIM), np.int8)])  # zeros at the end
    return Vectors({t: k for k, t in enumerate(words, len(SHAPES))}, table, bits, named.where(F.col("n") < edge) if edge else None)


def pool(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """docs' columns without text, and x: mean vector; log length, share of distinct words, share of lines that repeat another."""
    keep = [f for f in docs.schema.fields if f.name not in ("text", "_rid")]
    sent, whole = vectors.sent(docs.sparkSession), vectors.rest is None

    def batches(it):
        at, table, often = sent.value
        get = at.get
        for b in it:
            sums, tails = np.zeros((len(b), DIM + 4), np.float32), [[] for _ in range(len(b))]
            r = 0
            for texts in _texts([b], SPAN):
                got = cut(texts)
                lens, names = got.lens, got.names
                known = np.array([get(t, -1) for t in names], np.int64)
                odd = np.flatnonzero(known < 0)
                known[odd] = [shape(names[k]) for k in odd.tolist()]
                text = np.repeat(np.arange(len(texts)), lens)
                pairs = np.sort(text << 32 | got.number)
                start = runs(pairs)
                distinct = np.bincount(pairs[start] >> 32, minlength=len(texts))
                if often is not None and len(odd):
                    met = odd[in_map(often, np.array([word_hash(names[k]) for k in odd.tolist()], np.uint64))]
                    asked = np.zeros(len(names), bool)
                    asked[met] = True
                    own = asked[pairs[start] & 0xFFFFFFFF]
                    for pair, n in zip(pairs[start][own].tolist(), np.diff(start, append=len(pairs))[own].tolist()):
                        k = pair & 0xFFFFFFFF
                        tails[r + (pair >> 32)].append((names[k], n, int(known[k])))
                    known[met] = len(table) - 1  # a row of zeros
                x = table[known][got.number].astype(np.float32)
                ends = np.cumsum(lens).tolist()
                for k, t in enumerate(texts):
                    if lens[k]:
                        lines = [y for y in t.split("\n") if y.strip()]
                        sums[r + k, :DIM] = x[ends[k] - lens[k] : ends[k]].sum(axis=0)
                        sums[r + k, DIM:] = lens[k], np.log1p(lens[k]) / 4 - 1, distinct[k] / lens[k], 1 - len(set(lines)) / max(1, len(lines))
                r += len(texts)
            cols = {f.name: b.column(f.name) for f in keep}
            if whole:
                yield pa.RecordBatch.from_arrays([*cols.values(), _lists(features(sums))], [*cols, "x"])
            else:
                flat = [x for t in tails for x in t]
                offsets = pa.array(np.cumsum([0, *map(len, tails)]), pa.int32())
                tail = pa.StructArray.from_arrays([pa.array([x[j] for x in flat], k) for j, k in enumerate((pa.string(), pa.int32(), pa.int32()))], ["token", "k", "shape"])
                yield pa.RecordBatch.from_arrays([b.column("_rid"), *cols.values(), _lists(sums), pa.ListArray.from_arrays(offsets, tail)], ["_rid", *cols, "sums", "tail"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    names = [f.name for f in keep]
    if whole:
        return docs.select(*names, "text").mapInArrow(batches, f"{own}, x array<float>")
    rows = docs.select(*names, "text", F.monotonically_increasing_id().alias("_rid")).mapInArrow(batches, f"_rid long, {own}, sums array<float>, tail array<struct<token:string,k:int,shape:int>>")
    rows = stored(rows, "pooled")
    tail = rows.select("_rid", F.explode("tail").alias("t")).select("_rid", "t.token", "t.k", "t.shape")
    found = tail.join(vectors.rest.select("token", "vec"), "token", "left").select("_rid", "k", "shape", "vec").repartition("_rid").sortWithinPartitions("_rid")

    def add(it):
        _, table, _ = sent.value
        rid, v = None, np.zeros(DIM)
        out = []

        def done():
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), _lists(np.array([x for _, x in out], np.float32).reshape(-1, DIM))], ["_rid", "more"])

        for b in it:
            for r, k, s, x in zip(*(c.to_pylist() for c in b.columns)):
                if r != rid:
                    if rid is not None:
                        out.append((rid, v))
                    rid, v = r, np.zeros(DIM)
                v = v + k * (table[s] if x is None else np.frombuffer(x, np.int8)).astype(float)
            if len(out) > 1 << 14:
                yield done()
                out = []
        if rid is not None:
            out.append((rid, v))
        yield done()

    def finish(it):
        for b in it:
            sums = np.stack(b.column("sums").to_pylist()).astype(np.float32) if len(b) else np.zeros((0, DIM + 4), np.float32)
            for r, m in enumerate(b.column("more").to_pylist()):
                if m is not None:
                    sums[r, :DIM] += np.array(m, np.float32)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _lists(features(sums))], [*names, "x"])

    return rows.drop("tail").join(found.mapInArrow(add, "_rid long, more array<float>"), "_rid", "left").select(*names, "sums", "more").mapInArrow(finish, f"{own}, x array<float>")


def features(sums: np.ndarray) -> np.ndarray:
    """The network's input from sums of vectors, token counts and facts."""
    return np.concatenate([sums[:, :DIM] * np.float32(8 / 127) / np.maximum(sums[:, DIM : DIM + 1], 1), sums[:, DIM + 1 :]], axis=1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.astype(np.float32).ravel()))


class Network:
    """One hidden layer of tanh units, trained by Adam on the log loss; a temperature divides its output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, y = (x - self.mean) / self.scale, y.astype(float)
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        held = np.arange(len(x)) % 5 == 4
        own = np.flatnonzero(~held)
        m, v, k = [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(own), max(1, len(own) // batch)):
                h = np.tanh(x[part] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[part]) / len(part)
                back = np.outer(d, p[2]) * (1 - h**2)
                g = [x[part].T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], d.sum(keepdims=True)]
                k += 1
                for j in range(4):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g[j], 0.999 * v[j] + 0.001 * g[j] ** 2
                    p[j] = p[j] - rate * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if held.any():
            z = self._logit(x[held])
            grid = np.exp(np.linspace(-1.5, 2.5, 81))
            loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x):
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -40, 40)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 2, of: int = 4, least: int = LEAST, most: int = MOST):
    """Vectors from all of docs, and a network from at most `sample` labelled documents (smallest id hash, one row of each) whose crc32 mod `of` isn't `held_out`."""
    vectors = learn_vectors(docs, least, most)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod(F.col("doc_id"), of) != held_out))
    some = bounded_sample(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", sample)
    rows = pool(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", "text"), vectors)
    got = rows.groupBy("doc_id").agg(F.min(F.struct("x", "quality")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    y = got["quality"].to_numpy()
    if len(set(y)) < 2:
        return vectors, Constant(float(y.mean()) if len(y) else 0.5)
    order = np.random.default_rng(3).permutation(len(y))
    return vectors, Network(np.stack(got["x"].to_list())[order].astype(float), y[order])


def score_quality(docs: DataFrame, model, threshold: float = 0.7, held_out: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    vectors, network = model

    def batches(it):
        for b in it:
            x = np.stack(b.column("x").to_pylist()).astype(float) if len(b) else np.zeros((0, DIM + 3))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(network.predict(x).astype(np.float64))], ["doc_id", "score"])

    scored = pool(docs.select("doc_id", "text"), vectors).mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), of) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
