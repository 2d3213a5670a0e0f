"""Language-model scoring with a probabilistic suffix tree learned from the corpus.

A text is read as lower-cased words and an end. Each word has a symbol: words seen `SINGLE` times
or more are symbols of their own; words seen once stand for those never seen and share `SHARED`
symbols by their first two bytes, as do words beyond the `KNOWN` most frequent ones, whose counts
every task knows. The tree predicts the symbol of each word from the symbols before it, back to the
end of the text before (one end stands in front of a text).

The tree grows level by level, as deep as contexts pass. A context of k symbols is counted if it
was seen `LEAST` times or more and its suffix of k-1 symbols was kept; it is kept if its
next-symbol distribution diverges from its suffix's by more than what it costs to state it. All
next symbols of a kept context stay, smoothed with `WEIGHT` counts of the suffix's distribution. A
word is scored in the longest kept suffix of its past: its symbol's probability there times the
word's share of its symbol. In a shared symbol the words that training lacks are one outcome with
the mass of the words seen once, so the model sums to one over known words and these outcomes.

Levels are tables with a row for each context, its next symbols packed in arrays. Counts meet the
probabilities after their suffix in one shuffle by blocks of suffixes; the symbols of a hot one are dealt over
several tasks. The `MOST` most frequent pairs of context and symbol of a level are known to every
task, the others are asked for by bucket of keys. A training text's symbol was seen after each of
its contexts, so the probability after the last kept one is asked for. For held-out texts it isn't
known which pair is there: a longer context multiplies a probability by a factor, whose logarithms
are asked for on each level and add up. Bitmaps of bounded size say which contexts can be kept.

The counts of words that tasks don't know meet their texts by a shuffled join.

Defined results: null text counts as empty (an end alone); a null doc_id hashes as the empty
text (held out); rows with repeated doc_id get a row each and are all learned from; other
columns are ignored; an empty table gives no rows; with no training text N is 0 and all
probabilities are those of the smoothing alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, last_stored, stored
from .markov import END

#: Words whose counts are sent to every task, at most: the most frequent ones (20 bytes each).
KNOWN = 2_000_000
#: Occurrences from which a known word is a symbol of its own, and symbols that other words share. Words seen once stand for those never seen.
SINGLE, SHARED = 2, 256
#: Occurrences from which a context is counted.
LEAST = 200
#: Counts that a context borrows from its suffix.
WEIGHT = 100.0
#: Rows of each level that every task knows, at most.
MOST = 1_000_000
#: Bits of a map of contexts that can be kept: 32 for each, but 8 MB at most, whatever the corpus.
MAP_BITS = 26
#: Distinct words after which a task hands its counts on, and positions that are looked at together.
FLUSH, SPAN = 200_000, 1 << 19
#: Distinct rows of a level after which a task hands its counts on.
HELD = 1_000_000
#: Occurrences of a context whose next symbols one task takes, and rows beyond MOST that one takes: more are dealt out.
HOT, BUCKET = 1 << 20, 1 << 18
#: Occurrences of the contexts, or symbols after their suffixes, that meet in a block of a level.
BLOCK = 1 << 17
#: Pairs that a task looks at together.
CHUNK = 1 << 20
#: Bits of a text's number among its neighbours.
NEAR = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def mixed(symbol: np.ndarray) -> np.ndarray:
    """The key of a symbol: its number spread over 64 bits."""
    x = (symbol.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def as_context(key: np.ndarray) -> np.ndarray:
    """A context's own key among looked-up rows, where the same sequence may also stand as a context and its symbol."""
    return key ^ np.uint64(0xD6E8FEB86659FD93)


def by_bytes(batch: pa.RecordBatch, most: int = 4 * SPAN):
    """Pieces of a batch whose texts have about `most` bytes together; no text is cut."""
    if not len(batch):
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.append(runs((size - 1) // most), len(batch))
    for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
        yield batch.slice(x, y - x)


def cut_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of many texts: how many words each has, its end included; the distinct ones, the end last; all words as their numbers; each word's text."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    full = np.concatenate([[0], np.cumsum(pc.binary_length(cut.flatten()).to_numpy(zero_copy_only=False) > 0)])  # space at an edge leaves an empty piece
    lens = np.diff(full[cut.offsets.to_numpy() - cut.offsets[0].as_py()]) + 1
    got = cut.flatten().filter(pa.array(np.diff(full) > 0)).dictionary_encode()
    i = np.full(lens.sum(), len(got.dictionary))
    inner = np.ones(len(i), bool)
    inner[np.cumsum(lens) - 1] = False
    i[inner] = got.indices.to_numpy()
    return lens, pa.concat_arrays([got.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), i, np.repeat(np.arange(len(lens)), lens)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of all training texts, ends included."""

    def batches(it):
        parts, size = [], 0
        for b in it:
            for piece in by_bytes(b):
                _, own, i, _ = cut_words(piece.column("text").filter(pa.array([not is_held_out(x) for x in piece.column("doc_id").to_pylist()], pa.bool_())))
                n = np.bincount(i, minlength=len(own))
                seen = np.flatnonzero(n)
                parts.append(pa.table({"word": own.take(pa.array(seen)), "n": n[seen]}))
                size += len(seen)
                if size > 2 * FLUSH:
                    parts = [merged(parts)]
                    if len(parts[0]) > FLUSH:
                        yield from parts.pop().to_batches()
                    size = sum(map(len, parts))
            pa.default_memory_pool().release_unused()
        if parts:
            yield from merged(parts).to_batches()

    def merged(parts):
        return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    return docs.select("doc_id", "text").mapInArrow(batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def word_keys(some: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64 of the bytes."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in some], np.uint64)


@dataclass
class Known:
    """Words that every task knows."""

    key: np.ndarray  # rising
    c: np.ndarray
    number: np.ndarray  # their symbols, -1 for shared ones

    def of(self, some: list[bytes], kind) -> tuple[np.ndarray, np.ndarray]:
        """Counts (-1 where a word isn't known) and symbols of words."""
        keys = word_keys(some)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = self.key[at] == keys
        number = np.where(hit, self.number[at], -1)
        for k in np.flatnonzero(number < 0).tolist():
            number[k] = 1 + zlib.crc32(some[k][:2]) % SHARED
        return np.where(hit, self.c[at], -1).astype(float), number.astype(kind)


@dataclass
class Symbols:
    """Numbers of symbols (the end is 0, then SHARED shared ones, then single words by falling count) and what each says of its words."""

    words: Known
    n: np.ndarray  # training tokens of each symbol
    unseen: np.ndarray  # of the end and shared symbols, mass of the words that training lacks

    @property
    def p(self):
        return (self.n + 0.5) / (self.n.sum() + 0.5 * len(self.n))

    @property
    def kind(self):
        return np.uint16 if len(self.n) < 1 << 16 else np.uint32


def known_edge(counts: DataFrame, most: int) -> int:
    """The count from which words are known to every task: `most` of them at most."""
    return max(1, _edge(counts.groupBy(F.least("c", F.lit(10_000)).alias("n")).agg(F.count("*").alias("size")).toPandas(), most))


def learn_symbols(counts: DataFrame, edge: float, least: int) -> Symbols:
    """Symbols from the counts of all words; those seen `edge` times or more are known, and `least` times or more single."""
    end = word_keys([END])[0]
    got = counts.where((F.col("c") >= edge) & (F.col("word") != bytearray(END))).select(F.xxhash64("word").alias("key"), "c").toArrow()  # KNOWN rows at most
    key, c = got.column("key").to_numpy().view(np.uint64), got.column("c").to_numpy()
    ends = counts.where(F.col("word") == bytearray(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    own = np.flatnonzero(c >= least)
    own = own[np.lexsort((key[own], -c[own]))]
    number = np.full(len(c), -1)
    number[own] = 1 + SHARED + np.arange(len(own))
    n, unseen = np.zeros(1 + SHARED + len(own)), np.zeros(1 + SHARED)
    n[0], n[1 + SHARED :] = ends, c[own]
    bucket = F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(SHARED)).cast("int").alias("k")
    others = counts.where((F.col("word") != bytearray(END)) & (F.col("c") < max(edge, least)))
    for k, total, once in others.groupBy(bucket).agg(F.sum("c"), F.sum((F.col("c") == 1).cast("long"))).collect():  # SHARED rows at most
        n[1 + k], unseen[1 + k] = total, once
    unseen[1:] = np.maximum(unseen[1:], 0.5)
    key, c, number = np.append(key, end), np.append(c, ends), np.append(number, 0)
    order = np.argsort(key)
    return Symbols(Known(key[order], c[order], number[order].astype(np.int32)), n, unseen)


def read_texts(docs: DataFrame, symbols: Symbols, sent, n: int, v: int) -> DataFrame:
    """Everything of a text that known words (broadcast) and symbols tell, its symbols (two or four bytes each), and the counts of its other words."""
    mass, kind = symbols.n[: 1 + SHARED] + symbols.unseen, symbols.kind
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, head_known long, head_score double, own double, syms binary, tail array<binary>, tail_n array<int>"

    def batches(it):
        known = sent.value
        below = np.log10(0.1 * (v + 1) + n)
        whole = np.log10(mass, out=np.zeros(len(mass)), where=mass > 0)

        def told(b):
            lens, cut, i, text = cut_words(b.column("text"))
            own = cut.to_pylist()
            count, symbol = known.of(own, kind)
            far = count < 0
            base = np.where(far, 0.0, np.log10(np.maximum(count, 0) + 0.1) - below)
            shared = symbol <= SHARED  # a single word is all of its symbol
            inner = np.where(shared, np.log10(count, out=np.zeros(len(own)), where=count > 0) - whole[np.where(shared, symbol, 0)], 0.0)
            sums = [np.bincount(text, x[i], len(lens)) for x in ((count > 0).astype(float), base, inner)]
            rare = far[i]
            pairs, k = np.unique(text[rare] * len(own) + i[rare], return_counts=True)
            tail_ends = pa.array(np.searchsorted(pairs, np.arange(len(lens) + 1) * len(own)), pa.int32())
            tail = pa.ListArray.from_arrays(tail_ends, cut.take(pa.array(pairs % len(own))))
            syms, ends = symbol[i], np.cumsum([0, *lens])
            held = [is_held_out(x) for x in b.column("doc_id").to_pylist()]
            cells = [b.column("rid"), b.column("doc_id"), pa.array(held, pa.bool_()), pa.array(lens, pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            cells += [pa.array([packed(syms[x:y]) for x, y in zip(ends, ends[1:])], pa.binary()), tail, pa.ListArray.from_arrays(tail_ends, pa.array(k.astype(np.int32)))]
            return pa.RecordBatch.from_arrays(cells, ["rid", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "own", "syms", "tail", "tail_n"])

        for b in it:
            for piece in by_bytes(b):
                yield told(piece)
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")).mapInArrow(batches, schema)


def packed(syms: np.ndarray) -> bytes:
    """Symbols as bytes, all first bytes before all second ones: the upper ones are mostly zeros."""
    return syms.view(np.uint8).reshape(-1, syms.itemsize).T.tobytes()


def unpacked(cell: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(cell, np.uint8).reshape(size, -1).T).view(kind).ravel()


def spans(batch: pa.RecordBatch, kind, most: int = SPAN):
    """Texts' symbols in pieces of about `most`: (text number of each symbol, its place from 1, symbols, positions to predict), every text with an end in front at place 0.

    The positions are those of the column `at` (four bytes each), or all. A long text is never cut: its symbols are two or four bytes each.
    """
    held, size = [], 0
    column, some = batch.column("syms"), batch.column("at") if "at" in batch.schema.names else None
    for k, s in enumerate(column):
        held.append((k, unpacked(s.as_py(), kind)))
        size += len(held[-1][1])
        if size >= most or k == len(column) - 1:
            lens = np.array([len(s) + 1 for _, s in held])
            first = np.cumsum(lens) - lens
            flat = np.zeros(lens.sum(), np.int32)
            for (_, s), at in zip(held, first.tolist()):
                flat[at + 1 : at + 1 + len(s)] = s
            place = np.arange(len(flat)) - np.repeat(first, lens)
            at = np.flatnonzero(place) if some is None else np.concatenate([np.frombuffer(some[k].as_py(), np.int32) + f for (k, _), f in zip(held, first.tolist())])
            yield np.repeat([k for k, _ in held], lens), place, flat, at
            held, size = [], 0


class Walk:
    """Contexts of growing length of the positions of a span; those that can't be kept are left behind."""

    def __init__(self, place: np.ndarray, flat: np.ndarray, at: np.ndarray):
        self.key, self.k = mixed(flat), 0
        self.at, self.place = at, place
        self.ctx = np.zeros(len(self.at), np.uint64)
        self.low = self.key[self.at]

    def grow(self) -> None:
        """One symbol more into the past."""
        self.sfx, before = self.ctx, self.at - 1 - self.k
        ok = self.place[self.at] > self.k
        self.only(ok)
        self.ctx = self.sfx + self.key[before[ok]] * _power(self.k)
        self.k += 1
        self.low = self.key[self.at] + _BASE * self.sfx
        self.pk = self.key[self.at] + _BASE * self.ctx

    def only(self, ok: np.ndarray) -> None:
        for name in ("at", "ctx", "sfx", "low", "pk", "each", "cost"):
            if hasattr(self, name):
                setattr(self, name, getattr(self, name)[ok])


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def bit_map(keys: DataFrame, column: str, count: int | None = None) -> np.ndarray:
    """Bits of the keys' lowest bits, gathered as 64-bit words: bounded in size, so keys may share a bit."""
    bits = min(MAP_BITS, max(6, (32 * (keys.count() if count is None else count)).bit_length()))
    word = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(F.shiftright(word, 6).alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy().view(np.uint64)
    return out


def in_map(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys & np.uint64(64 * len(bits) - 1)
    return (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) > 0


def walked(batch: pa.RecordBatch, kind, maps: list[np.ndarray]):
    """Of each span, its text numbers, places and symbols, and the walk over the contexts of len(maps) symbols that the maps let through."""
    for text, place, flat, at in spans(batch, kind):
        walk = Walk(place, flat, at)
        for m in maps:
            walk.grow()
            walk.only(in_map(m, walk.ctx))
        yield text, place, flat, walk


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def slices(it, column: str, most: int = 1 << 20):
    """Batches cut so that a column's cells have about `most` bytes."""
    for b in it:
        n = max(1, len(b) * most // max(1, b.column(column).nbytes))
        for at in range(0, len(b), n):
            yield b.slice(at, n)


class Grams:
    """Counts of what follows contexts, of several spans, merged before they leave the task as a row for each context and bucket of symbols, by block."""

    def __init__(self, deal, put=None, blocks: int = 1):
        self.parts, self.size, self.deal, self.put, self.blocks = [], 0, deal, put or cells, blocks

    def add(self, walk: Walk, flat: np.ndarray) -> None:
        order = np.argsort(walk.pk)
        keys = walk.pk[order]
        start = runs(keys)
        where = order[start]
        self.parts.append((keys[start], walk.sfx[where], walk.ctx[where], flat[walk.at[where]].astype(np.uint32), np.diff(np.append(start, len(keys))).astype(np.uint32)))
        self.size += len(start)

    def merge(self) -> int:
        """Make one part of all; its rows."""
        if len(self.parts) > 1:
            columns: list = [list(x) for x in zip(*self.parts)]
            self.parts = []
            for j in range(len(columns)):
                columns[j] = np.concatenate(columns[j])  # its pieces go before the next one's are joined
            pk, *cells, n = columns
            del columns
            order = np.argsort(pk)
            pk = pk[order]
            start = runs(pk)
            self.parts = [(pk[start], *(x[order[start]] for x in cells), np.add.reduceat(n[order], start, dtype=np.uint32))]
        self.size = 0  # what is merged doesn't count towards the next merge
        return len(self.parts[0][0]) if self.parts else 0

    def rows(self):
        """Everything, merged, in record batches; nothing stays."""
        if not self.merge():
            return
        sfx, ctx, sym, n = self.parts.pop()[1:]
        g, k = self.deal(sfx, ctx, sym)
        row = ctx + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        by = block_of(g, k, self.blocks).view(np.uint64)
        by <<= np.uint64(40)
        by += row >> np.uint64(24)
        order = np.argsort(by)
        del by
        start = runs(row[order])
        ctx, sym, n, g, k = (x[order] for x in (ctx, sym, n, g, k))
        cuts = np.append(start, len(ctx))
        for at in range(0, len(start), 1 << 13):
            part = cuts[at : at + (1 << 13) + 1]
            own = part[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(g[own].view(np.int64)), pa.array(k[own].astype(np.int32)), pa.array(ctx[own].view(np.int64)), self.put(sym, part), self.put(n, part)], ["g", "k", "ctx", "syms", "ns"])


def cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of values between cuts as a binary column."""
    data = np.ascontiguousarray(values[cuts[0] : cuts[-1]])
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - cuts[0]) * values.itemsize).astype(np.int32)), pa.py_buffer(data)])


def flat_cells(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column (null: none), and how many each row has."""
    rows = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(rows), kind), np.array([len(x) for x in rows], np.int64) // np.dtype(kind).itemsize


def small(column: pa.Array) -> pa.Array:
    """A binary column by zstd, each cell behind its size."""
    return pa.array((None if x is None else len(x).to_bytes(4, "little") + pa.compress(x, "zstd", asbytes=True) for x in column.to_pylist()), pa.binary())


def whole(cell: bytes | None) -> bytes | None:
    return None if cell is None else pa.decompress(cell[4:], int.from_bytes(cell[:4], "little"), "zstd", asbytes=True)


def small_cells(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """As `cells`, whole numbers in as many bytes as they need: seven bits each, the eighth says that more follow."""
    v = values[cuts[0] : cuts[-1]].astype(np.uint32)
    size = np.ones(len(v), np.int64)
    for bits in (7, 14, 21, 28):
        size += v >= 1 << bits
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = np.zeros(ends[-1], np.uint8)
    for j in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > j)
        raw[ends[own] + j] = v[own] >> np.uint32(7 * j) & np.uint32(127) | (size[own] > j + 1).astype(np.uint32) << np.uint32(7)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(ends[cuts - cuts[0]].astype(np.int32)), pa.py_buffer(raw)])


def small_values(column) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of `small_cells` (null: none), and how many each row has."""
    rows = [x or b"" for x in column.to_pylist()]
    raw = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    start = np.concatenate([[0], ends[:-1]])[: len(ends)]
    out, size = (raw[start] & 127).astype(np.uint32), ends - start
    for j in range(1, int(size.max(initial=1))):
        own = np.flatnonzero(size > j)
        out[own] |= (raw[start[own] + j] & 127).astype(np.uint32) << np.uint32(7 * j)
    return out, np.diff(np.searchsorted(ends, np.cumsum([len(x) for x in rows]), side="right"), prepend=0)


def share(n: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A pair's probability times its context's count and `weight`: p = (n + weight q) / (t + weight), where the factor `value` tells q."""
    return n / -np.expm1(-np.log(10) * value.astype(float))


def block_of(g: np.ndarray, k: np.ndarray, blocks: int) -> np.ndarray:
    """Where rows of a level meet: the block of a key and its bucket of symbols."""
    return ((g.view(np.uint64) >> np.uint64(16)).astype(np.int64) + k) % blocks


def block_column(g: str, blocks: int):
    """As `block_of`."""
    return F.pmod(F.shiftrightunsigned(F.col(g), 16) + F.col("k"), F.lit(blocks)).cast("int")


def dealer(first: bool, hot: tuple[np.ndarray, np.ndarray]):
    """How rows of a level meet: by the context on the first level (every suffix is empty there), else by the suffix; symbols of hot ones are dealt out."""

    def deal(sfx, ctx, sym):
        g, k = ctx if first else sfx, np.zeros(len(sym), np.int32)
        if len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], g), len(hot[0]) - 1)
            many = np.flatnonzero(hot[0][at] == g)
            k[many] = (mixed(sym[many]) >> np.uint64(20)) % hot[1][at[many]]
        return g, k

    return deal


def count_level(texts: DataFrame, kind, sent: list, hot, blocks: int) -> DataFrame:
    """(b, ctx, lens, syms, ns): what follows the contexts of len(sent) symbols that the maps (broadcast) let through, in training texts; partial counts, contexts of a block side by side."""
    first = len(sent) == 1

    def batches(it):
        maps, grams = [m.value for m in sent], Grams(dealer(first, hot.value), blocks=blocks)
        for b in it:
            for _, _, flat, walk in walked(b, kind, maps):
                grams.add(walk, flat)
                if grams.size > 500_000 and grams.merge() > HELD:
                    yield from side_by_side(grams.rows(), blocks)
        yield from side_by_side(grams.rows(), blocks)

    return texts.mapInArrow(batches, "b int, ctx binary, lens binary, syms binary, ns binary")


def side_by_side(rows, blocks: int):
    """Rows of `Grams`, those of a block in one row: contexts by planes of bytes, how many symbols each has, and these with their counts."""
    for r in rows:
        block = block_of(r.column("g").to_numpy(), r.column("k").to_numpy(), blocks)
        ctx = r.column("ctx").to_numpy().view(np.uint64)
        (sym, lens), (n, _) = (flat_cells(r.column(x), np.uint32) for x in ("syms", "ns"))
        start = runs(block)
        cuts = np.append(start, len(block))
        at = np.concatenate([[0], np.cumsum(lens)])[cuts]
        planes = pa.array([packed(ctx[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(block[start].astype(np.int32)), planes, *(small(small_cells(*x)) for x in ((lens, cuts), (sym, at), (n, at)))], ["b", "ctx", "lens", "syms", "ns"])


LEVEL = "ctx long, t long, gain double, d long, syms binary, ns binary, value binary, next binary, next_low binary, next_n binary"


#: Kinds of rows that meet in a block: probabilities after suffixes (key, syms, p), contexts to count (key, their suffix g, t) and partial counts (ctx, lens, syms, ns).
ABOVE, CAN, COUNTED = range(3)


def judge_level(rows: DataFrame, root, least: int, weight: float) -> DataFrame:
    """Counts merged and held against their suffixes' (`root` has those of the first level): a row for each context and block, with a share of its gain. rows are sorted by block b and kind."""

    def batches(it):
        held, own = [], None
        for b in it:
            block = b.column("b").to_numpy()
            cuts = np.append(runs(block), len(block))
            for x, y in zip(cuts.tolist(), cuts[1:].tolist()):
                if held and block[x] != own:
                    yield from settled(held)
                    held = []
                held.append(b.slice(x, y - x))
                own = block[x]
        if held:
            yield from settled(held)

    def settled(held):
        b = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        kind = b.column("kind").to_numpy()
        above, can, counted = (b.slice(x, y - x) for x, y in (np.searchsorted(kind, [k, k + 1]).tolist() for k in (ABOVE, CAN, COUNTED)))
        if len(can) and len(counted):
            yield from judged(can, counted, after(above))

    def after(above):
        if root is not None:
            return None
        sym, lens = small_values(above.column("syms"))
        low = mixed(sym) + _BASE * np.repeat(above.column("key").to_numpy().view(np.uint64), lens)
        order = np.argsort(low)
        return low[order], flat_cells(above.column("p"), np.float32)[0][order]

    def judged(can, b, parents):
        can_ctx, can_g, can_t = (can.column(x).to_numpy().view(kind) for x, kind in (("key", np.uint64), ("g", np.uint64), ("t", np.int64)))
        at = np.argsort(can_ctx, kind="stable")
        can_ctx, can_g, can_t = can_ctx[at], can_g[at], can_t[at]
        sym, n, lens = (small_values(pa.array(map(whole, b.column(x).to_pylist()), pa.binary()))[0] for x in ("syms", "ns", "lens"))
        ctx = np.repeat(np.concatenate([unpacked(x, np.uint64) for x in b.column("ctx").to_pylist()]), lens)
        at = np.minimum(np.searchsorted(can_ctx, ctx), len(can_ctx) - 1)
        ok = can_ctx[at] == ctx  # a map lets more through
        sym, n, ctx, g, t = (x[ok] for x in (sym, n, ctx, can_g[at], can_t[at]))
        if not len(ctx):
            return
        pk = mixed(sym) + _BASE * ctx
        order = np.argsort(pk)
        start = runs(pk[order])
        n, where = np.add.reduceat(n[order].astype(np.int64), start), order[start]
        order = np.argsort(ctx[where])
        where, n = where[order], n[order]
        sym, ctx, g, t = sym[where], ctx[where], g[where], t[where]
        low = mixed(sym) + (np.uint64(0) if root is not None else _BASE * g)
        if root is not None:
            q = root.value[sym]
        else:
            at = np.minimum(np.searchsorted(parents[0], low), len(parents[0]) - 1)
            if not (parents[0][at] == low).all():
                raise RuntimeError("a context's symbol is missing after its suffix")
            q = parents[1][at].astype(float)
        p = (n + weight * q) / (t + weight)
        value = np.log10(p / q) - np.log10(weight / (t + weight))
        first = runs(ctx)
        cuts = np.append(first, len(ctx))
        gain = np.add.reduceat(n * np.log2(n / t / q), first)
        more = np.flatnonzero((n >= least) & (sym > 0))  # nothing follows an end
        at_more = np.searchsorted(more, cuts)
        pk = mixed(sym[more]) + _BASE * ctx[more]
        out = [pa.array(ctx[first].view(np.int64)), pa.array(t[first]), pa.array(gain), pa.array(np.diff(cuts))]
        out += [small_cells(sym, cuts), small_cells(n, cuts), cells(value.astype(np.float32), cuts)]
        yield pa.RecordBatch.from_arrays([*out, cells(pk, at_more), cells(low[more], at_more), cells(n[more], at_more)], [x.split()[0] for x in LEVEL.split(", ")])

    return rows.mapInArrow(batches, LEVEL)


def pairs(it, least: int, below: int):
    """Arrays (pk, value, n, t) of the pairs of a level's batches that were seen from `least` to less than `below` times."""
    for b in slices(it, "syms"):
        (sym, lens), (n, _), (value, _) = small_values(b.column("syms")), small_values(b.column("ns")), flat_cells(b.column("value"), np.float32)
        pk = mixed(sym) + _BASE * np.repeat(b.column("ctx").to_numpy().view(np.uint64), lens)
        ok = (n >= least) & (n < below)
        yield pk[ok], value[ok], n[ok], np.repeat(b.column("t").to_numpy(), lens)[ok]


def pairs_of(level: DataFrame, least: int, weight: float) -> DataFrame:
    """(pk, value, p) of a level's pairs seen `least` times or more."""

    def batches(it):
        for pk, value, n, t in pairs(it, least, 1 << 62):
            yield pa.RecordBatch.from_arrays([pa.array(pk.view(np.int64)), pa.array(value), pa.array((share(n, value) / (t + weight)).astype(np.float32))], ["pk", "value", "p"])

    return level.select("ctx", "t", "syms", "ns", "value").mapInArrow(batches, "pk long, value float, p float")


def next_contexts(level: DataFrame) -> DataFrame:
    """(ctx, g, t): longer contexts seen often enough, their suffixes, and how often they were seen."""

    def batches(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(flat_cells(b.column(x), np.int64)[0]) for x in ("next", "next_low", "next_n")], ["ctx", "g", "t"])

    return level.select("next", "next_low", "next_n").mapInArrow(batches, "ctx long, g long, t long")


def suffix_rows(level: DataFrame, hot, weight: float) -> DataFrame:
    """(g, k, syms, p): a level's probabilities, dealt out as the counts of the next level are."""

    def batches(it):
        deal = dealer(False, hot.value)
        for b in slices(it, "syms"):
            sym, lens = small_values(b.column("syms"))
            p = share(small_values(b.column("ns"))[0], flat_cells(b.column("value"), np.float32)[0]) / np.repeat(b.column("t").to_numpy() + weight, lens)
            g = np.repeat(b.column("ctx").to_numpy().view(np.uint64), lens)
            _, k = deal(g, g, sym)
            row = np.repeat(np.arange(len(lens)) << 32, lens) + k
            order = np.argsort(row, kind="stable")
            start = runs(row[order])
            g, k, sym, p = g[order], k[order], sym[order], p[order]
            cuts = np.append(start, len(row))
            yield pa.RecordBatch.from_arrays([pa.array(g[start].view(np.int64)), pa.array(k[start].astype(np.int32)), small_cells(sym, cuts), cells(p.astype(np.float32), cuts)], ["g", "k", "syms", "p"])

    return level.select("ctx", "t", "syms", "ns", "value").mapInArrow(batches, "g long, k int, syms binary, p binary")


def frontier(texts: DataFrame, kind, sent: list) -> DataFrame:
    """(syms, at): the texts with positions whose contexts of len(sent) symbols are kept, and these positions: all that deeper levels have to read."""

    def batches(it):
        maps = [m.value for m in sent]
        for b in it:
            out: list[bytes] = [b""] * len(b)
            for text, place, _, walk in walked(b, kind, maps):
                if len(walk.at):
                    own = text[walk.at]
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    for k, part in zip(own[np.concatenate([[0], cuts])].tolist(), np.split(place[walk.at].astype(np.int32), cuts)):
                        out[k] = part.tobytes()
            got = pa.RecordBatch.from_arrays([b.column("syms"), pa.array(out, pa.binary())], ["syms", "at"])
            yield got.filter(pa.array([bool(x) for x in out], pa.bool_()))

    return texts.mapInArrow(batches, "syms binary, at binary")


class Table:
    """Values of 64-bit keys, found by open addressing; made where it is used, from its sorted keys."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values, self.slots = keys, [x.astype(np.float32) for x in values], None

    def _made(self) -> np.ndarray:
        size = 1 << max(4, (2 * len(self.keys)).bit_length())
        slots, left, r = np.zeros(size, np.int32), np.arange(len(self.keys)), 0
        while len(left):
            at = ((self.keys[left] + np.uint64(r)) & np.uint64(size - 1)).astype(np.int64)
            free = slots[at] == 0
            slots[at[free]] = left[free] + 1  # of those that want one slot the last gets it
            left, r = left[slots[at] != left + 1], r + 1
        return slots

    def find(self, keys: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Values of the keys (0 where there is none), and whether there is one; `which`: of several values, this one."""
        if self.slots is None:
            self.slots = self._made()
        out, hit = np.zeros(len(keys)), np.zeros(len(keys), bool)
        if not len(self.keys):
            return out, hit
        left, r, last = np.arange(len(keys)), 0, np.uint64(len(self.slots) - 1)
        while len(left):
            got = self.slots[((keys[left] + np.uint64(r)) & last).astype(np.int64)] - 1
            here = got >= 0
            left, got = left[here], got[here]
            same = self.keys[got] == keys[left]
            out[left[same]], hit[left[same]] = self.values[which][got[same]], True
            left, r = left[~same], r + 1
        return out, hit


@dataclass
class Level:
    """What every task knows of a level: contexts, context-symbol pairs, and a map of the pairs that it doesn't know (None: it knows all)."""

    map: np.ndarray
    ctx: Table
    pair: Table
    all_ctx: bool
    all_pairs: bool
    weight: float


@dataclass
class Rest:
    """What tasks don't know of a level: contexts (None: they know all), and the pairs seen less than `below` times."""

    ctx: DataFrame | None
    level: DataFrame
    below: int
    size: int


def _edge(by_n, most: int) -> int:
    """From a table of counts and how many have them, the count from which rows are known to tasks: `most` at most (0: all are)."""
    by_n = by_n.sort_values("n", ascending=False)  # 10,000 rows at most
    fits = by_n["n"][by_n["size"].cumsum() <= most]
    return 0 if len(fits) == len(by_n) else int(fits.min()) if len(fits) else 1 << 62


def _known(rows: DataFrame, key: str, *values: str) -> Table:
    got = rows.select(key, *values).toArrow()
    keys = got.column(key).to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return Table(keys[order], *(got.column(x).to_numpy()[order] for x in values))


def sizes_of(level: DataFrame):
    """How many of a level's pairs were seen n times (10,000 stands for more)."""

    def batches(it):
        for b in it:
            n, k = np.unique(np.minimum(small_values(b.column("ns"))[0], 10_000), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64))], ["n", "size"])

    return level.select("ns").mapInArrow(batches, "n long, size long").groupBy("n").agg(F.sum("size").alias("size")).toPandas()


def _hot(spark, keys: np.ndarray, n: np.ndarray):
    """Keys of more than HOT occurrences and over how many buckets their symbols are dealt: for tasks, and as a table."""
    order = np.argsort(keys)
    keys, deal = keys[order], -(-n[order].astype(np.int64) // HOT)
    table = spark.createDataFrame(pa.table({"g": keys.view(np.int64), "deal": deal}))
    return spark.sparkContext.broadcast((keys, deal)), table  # bounded: the corpus over HOT


def grow(read: DataFrame, symbols: Symbols, least: int = LEAST, weight: float = WEIGHT, bits: float = 3.0, most: int = MOST) -> tuple[list[Level], list[Rest]]:
    """The levels that every task knows, and the rest."""
    spark, n = read.sparkSession, symbols.n
    context = spark.sparkContext
    keys, often = mixed(np.arange(len(n))), np.flatnonzero(n >= least)
    can = spark.createDataFrame(pa.table({"ctx": keys[often].view(np.int64), "g": keys[often].view(np.int64), "t": n[often].astype(np.int64)}))
    passed = None
    maps, levels, rest, own, root = [], [], [], None, context.broadcast(symbols.p)  # bounded: KNOWN
    hot, deal = _hot(spark, keys[n > HOT], n[n > HOT])
    texts = read.where(~F.col("held_out")).select("syms")
    null = lambda kind: F.lit(None).cast(kind)
    while True:
        can = stored(can, "contexts")
        if can.isEmpty():
            return levels, rest
        maps.append(context.broadcast(bit_map(can, "ctx")))
        blocks = 1 + max(can.agg(F.sum("t")).first()[0], own.agg(F.sum("d")).first()[0] if own is not None else 0) // BLOCK
        rows = count_level(texts, symbols.kind, maps, hot, blocks).select("b", F.lit(COUNTED).alias("kind"), null("long").alias("key"), null("long").alias("g"), null("long").alias("t"), "ctx", "lens", "syms", "ns", null("binary").alias("p"))
        dealt = F.explode(F.sequence(F.lit(0), F.coalesce("deal", F.lit(1)).cast("int") - 1)).alias("k")
        told = can.join(F.broadcast(deal), "g", "left").select("g", dealt, "ctx", "t").withColumn("b", block_column("g", blocks))
        rows = rows.unionByName(told.select("b", F.lit(CAN).alias("kind"), F.col("ctx").alias("key"), "g", "t"), allowMissingColumns=True)
        if own is not None:
            above = suffix_rows(own.join(can.select(F.col("g").alias("ctx")).distinct(), "ctx", "left_semi"), hot, weight).withColumn("b", block_column("g", blocks))
            rows = rows.unionByName(above.select("b", F.lit(ABOVE).alias("kind"), F.col("g").alias("key"), "syms", "p"), allowMissingColumns=True)
        rows = rows.repartition("b").sortWithinPartitions("b", "kind")
        level = stored(judge_level(rows, root if own is None else None, least, weight), "level", "zstd")
        if own is None:
            root.destroy()  # deeper levels have their suffixes' probabilities in the shuffle
        gained = level.groupBy("ctx").agg(F.first("t").alias("n"), F.sum("gain").alias("gain"), F.sum("d").alias("d")).where(F.col("gain") > bits * F.col("d") + 8)
        kept = stored(gained.select("ctx", "n", F.log10(F.lit(weight) / (F.col("n") + weight)).alias("value")), "kept")
        if kept.isEmpty():
            return levels, rest
        own_map = bit_map(kept, "ctx")
        maps.pop().destroy()
        maps.append(context.broadcast(own_map))
        some = kept.select("ctx")
        own = level.join(F.broadcast(some) if some.count() <= most else some, "ctx", "left_semi")
        edge = _edge(kept.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("size")).toPandas(), most)
        sizes = sizes_of(own)
        below = _edge(sizes, most)
        levels.append(Level(own_map, _known(kept.where(F.col("n") >= edge), "ctx", "value"), _known(pairs_of(own, below, weight), "pk", "value", "p"), not edge, not below, weight))
        if edge or below:
            rest.append(Rest(kept.where(F.col("n") < edge) if edge else None, own, below, int(sizes["size"][sizes["n"] < below].sum())))
        can = next_contexts(level).join(kept.select(F.col("ctx").alias("g")), "g", "left_semi").select("ctx", "g", "t")
        many = kept.where(F.col("n") > HOT).select("ctx", "n").toArrow()
        hot, deal = _hot(spark, many.column("ctx").to_numpy().view(np.uint64), many.column("n").to_numpy())
        if len(maps) % 2 == 0:
            texts = stored(frontier(texts, symbols.kind, maps), "frontier")
            if passed:
                discard(spark, passed)
            passed = last_stored()
        del rows, gained
        spark._jvm.System.gc()  # Spark removes the shuffle files of what nothing refers to any more: a level's go before the next one's come


SOUGHT = "bucket int, kind int, keys binary, vals binary, ns binary, rids binary, lens binary"
#: Kinds of rows: what is known of a bucket's keys, asked factors, asked shares, and what texts have without asking.
TOLD, FACTORS, SHARES, DONE = range(4)


def _sought(bucket, kind, **columns) -> pa.RecordBatch:
    cell = [columns.get(x, pa.nulls(len(bucket), pa.binary())) for x in ("keys", "vals", "ns", "rids", "lens")]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(np.full(len(bucket), kind), pa.int32()), *cell], ["bucket", "kind", "keys", "vals", "ns", "rids", "lens"])


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Rising with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def squeezed(rows, keys: bool):
    """Rows of keys in fewer bytes: all cells but asked keys (`keys`: those too), which have nothing to squeeze."""
    for b in rows:
        columns = [small(c) if n in ("vals", "ns", "rids", "lens") or keys and n == "keys" else c for n, c in zip(b.schema.names, b.columns)]
        yield pa.RecordBatch.from_arrays(columns, b.schema.names)


def rest_rows(level: DataFrame, below: int, buckets: int, contexts: bool) -> DataFrame:
    """Keys (each less the one before, by planes of bytes), factors and counts of a level's pairs seen less than `below` times (or of contexts), a row for each bucket of a batch."""

    def batches(it):
        own = ((as_context(b.column("ctx").to_numpy().view(np.uint64)), b.column("value").to_numpy().astype(np.float32), np.ones(len(b), np.uint32), None) for b in it) if contexts else pairs(it, 0, below)
        for keys, values, n, _ in own:
            order = np.argsort(keys)
            keys = keys[order]
            bucket = _buckets(keys, buckets)
            start = runs(bucket)
            cuts = np.append(start, len(keys))
            values, n = values[order], n[order]
            steps = pa.array([packed(np.diff(keys[x:y], prepend=np.uint64(0))) for x, y in zip(cuts, cuts[1:])], pa.binary())
            planes = pa.array([packed(values[x:y]) for x, y in zip(cuts, cuts[1:])], pa.binary())
            yield from squeezed([_sought(bucket[start], TOLD, keys=steps, vals=planes, ns=small_cells(n, cuts))], True)

    return level.select(*(("ctx", "value") if contexts else ("ctx", "t", "syms", "ns", "value"))).mapInArrow(batches, SOUGHT)


def _ask(what: int, asked: list, rid: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of the asked (key, text number): its keys by text, and the texts (each less the one before, by planes of bytes) with how many they ask for."""
    keys, text = (np.concatenate(x) for x in zip(*asked))
    pair = _buckets(keys, buckets).astype(np.int64) << 32 | text
    order = np.argsort(pair)
    keys, pair = keys[order], pair[order]
    run, start = runs(pair), runs(pair >> 32)
    cuts, in_runs = np.append(start, len(keys)), np.append(np.searchsorted(run, start), len(run))
    rids, lens = rid[pair[run] & 0xFFFFFFFF], np.diff(np.append(run, len(keys))).astype(np.uint32)
    each = [slice(x, y) for x, y in zip(in_runs, in_runs[1:])]
    return _sought(pair[start] >> 32, what, keys=cells(keys, cuts), rids=pa.array([packed(np.diff(rids[x], prepend=0)) for x in each], pa.binary()), lens=pa.array([packed(lens[x]) for x in each], pa.binary()))


def asks(it, kind, p: np.ndarray, levels: list[Level], buckets: int):
    """Of batches of texts, what tasks know of their scores (DONE) and what they ask for.

    A position of a training text has its symbol's probability after its longest context that is known to be kept. From where that isn't known,
    and in held-out texts, each level's factors are added.
    """
    for b in it:
        out, rid, held = np.zeros(len(b)), b.column("rid").to_numpy(), b.column("held_out").to_numpy(zero_copy_only=False)
        asked: dict[int, list] = {FACTORS: [], SHARES: []}
        for text, place, flat, at in spans(b, kind, SPAN // 2):

            def add(at, value):
                np.add(out, np.bincount(text[at], value, len(b)), out)

            def ask(what, at, keys):
                if len(at):
                    asked[what].append((keys, text[at]))

            def settle(level, at, pk, cost):
                if level is None:
                    return add(at, p[flat[at]])
                own, met = level.pair.find(pk, 1)
                add(at[met], np.log10(own[met]))
                add(at[~met], cost[~met] - np.log10(level.weight))  # 1 / (t + weight), times the share asked for
                ask(SHARES, at[~met], pk[~met])

            walk, above = Walk(place, flat, at), None
            walk.pk, walk.each, walk.cost = walk.low, held[text[at]], np.zeros(len(at))
            settle(None, at[walk.each], None, None)
            for level in levels:
                was, pk, each, cost = walk.at, walk.pk, walk.each, walk.cost
                walk.grow()
                if not level.all_ctx:
                    walk.only(in_map(level.map, walk.ctx))
                value, hit = level.ctx.find(walk.ctx)
                if level.all_ctx:
                    walk.only(hit)
                    value, hit = value[hit], hit[hit]
                last = np.ones(len(flat), bool)
                last[walk.at[hit]] = False
                last = last[was] & ~each
                settle(above, was[last], pk[last], cost[last])
                each, walk.cost = walk.each | ~hit, value
                walk.each = each
                add(walk.at[each], value[each])
                ask(FACTORS, walk.at[~hit], as_context(walk.ctx[~hit]))
                where, pk = walk.at[each], walk.pk[each]
                more, met = level.pair.find(pk)
                add(where, more)
                if not level.all_pairs:
                    ask(FACTORS, where[~met], pk[~met])
                above = level
            settle(above, walk.at[~walk.each], walk.pk[~walk.each], walk.cost[~walk.each])
            for what, some in asked.items():
                if sum(len(x) for x, _ in some) > CHUNK // 2:
                    yield _ask(what, some, rid, buckets)
                    some.clear()
        for what, some in asked.items():
            if some:
                yield _ask(what, some, rid, buckets)
        if len(b):
            yield _sought([int(rid[0]) % buckets], DONE, rids=cells(rid, np.array([0, len(b)])), vals=cells(out, np.array([0, len(b)])))


class Sums:
    """Sums of values by text number."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, rid: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((rid, v))
        self.size += len(rid)
        if self.size > CHUNK // 4:
            self.parts, self.size = [self.merged()], 0

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers, rising, and their sums."""
        rid, v = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(rid, kind="stable")
        start = runs(rid[order])
        return rid[order][start], np.add.reduceat(v[order], start)

    def rows(self):
        """Everything, in record batches; nothing stays."""
        if not self.parts:
            return
        rid, v = self.merged()
        self.parts, self.size = [], 0
        cuts = np.append(runs(rid >> NEAR), len(rid))
        for at in range(0, len(cuts) - 1, 1 << 10):
            part = cuts[at : at + (1 << 10) + 1]
            yield pa.RecordBatch.from_arrays([pa.array(rid[part[:-1]] >> NEAR), small_cells(rid & (1 << NEAR) - 1, part), cells(v, part)], ["block", "rids", "vals"])


def answers(it):
    """(block, rids, vals) from rows sorted by bucket and kind: what they add to texts' sums, neighbouring texts side by side in a row, each less the first of its block."""
    sums = Sums()
    for rid, v in answered(it):
        sums.add(rid, v)
        if not sums.size and len(sums.parts[0][0]) > CHUNK // 4:
            yield from sums.rows()
    yield from sums.rows()


def summed(it):
    """(rid, symbols_score) from all rows of some blocks of `answers`."""
    sums = Sums()
    for b in it:
        if len(b):
            rid, lens = small_values(b.column("rids"))
            sums.add((np.repeat(b.column("block").to_numpy(), lens) << NEAR) + rid, flat_cells(b.column("vals"), np.float64)[0])
    if sums.parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.merged()], ["rid", "symbols_score"])


def answered(it):
    """Pairs (rid, v) of arrays from rows sorted by bucket and kind."""
    keys, told, at, parts = None, (), (), []
    for b in slices(it, "keys"):
        for k in range(len(b)):
            bucket, what, mine, *others = (c[k].as_py() for c in b.columns)
            vals, ns, rids, lens = map(whole, others)
            if bucket != at:
                at, parts, keys = bucket, [], None
            if what == TOLD:
                parts.append((np.cumsum(unpacked(whole(mine), np.uint64), dtype=np.uint64), unpacked(vals, np.float32), small_values(pa.array([ns], pa.binary()))[0]))
                continue
            if what == DONE:
                yield np.frombuffer(rids, np.int64), np.frombuffer(vals, np.float64)
                continue
            if keys is None:
                keys, *told = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(1, np.uint64), np.zeros(1, np.float32), np.zeros(1, np.uint32))
                order = np.argsort(keys)
                keys, told, parts = keys[order], [x[order] for x in told], []
            mine = np.frombuffer(mine, np.uint64)
            order = np.argsort(mine)  # neighbours are found faster
            i = np.minimum(np.searchsorted(keys, mine[order]), len(keys) - 1)
            hit = keys[i] == mine[order]
            value = np.zeros(len(mine))
            if what == FACTORS:
                value[order] = np.where(hit, told[0][i], 0.0)
            elif hit.all():
                value[order] = np.log10(share(told[1][i], told[0][i]))
            else:
                raise RuntimeError("a training text's symbol is missing after its context")
            lens = unpacked(lens, np.uint32).astype(np.int64)
            yield np.cumsum(unpacked(rids, np.int64)), np.add.reduceat(value, np.cumsum(lens) - lens)


def walk_texts(read: DataFrame, symbols: Symbols, levels: list[Level], rest: list[Rest]) -> DataFrame:
    """(rid, symbols_score): the symbols' log10 probabilities. What tasks don't know is asked for by bucket of keys."""
    sent = read.sparkSession.sparkContext.broadcast((np.log10(symbols.p), levels))  # bounded: KNOWN, MOST and MAP_BITS
    kind, buckets = symbols.kind, 1 + sum(r.size for r in rest) // BUCKET

    def batches(it):
        yield from squeezed(asks(it, kind, *sent.value, buckets), False)

    rows = read.select("rid", "held_out", "syms").mapInArrow(batches, SOUGHT)
    for r in rest:
        if r.below:
            rows = rows.unionByName(rest_rows(r.level, r.below, buckets, False))
        if r.ctx is not None:
            rows = rows.unionByName(rest_rows(r.ctx, 0, buckets, True))
    met = rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answers, "block long, rids binary, vals binary")
    return met.repartition("block").mapInArrow(summed, "rid long, symbols_score double")


def score_texts(docs: DataFrame, head_share: float = 0.0, single: int = SINGLE, least: int = LEAST, most: int = MOST) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of docs.

    Words below `head_share` of all tokens aren't known to every task, so that they share symbols.
    """
    counts = stored(count_words(docs), "word-counts", "zstd")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    edge = max(1, single, n * head_share, known_edge(counts, KNOWN))
    symbols = learn_symbols(counts, edge, single)
    sent = docs.sparkSession.sparkContext.broadcast(symbols.words)  # bounded: see KNOWN
    read = stored(read_texts(docs, symbols, sent, n, v), "read", "zstd")
    sent.destroy()
    levels, rest = grow(read, symbols, least, most=most) if n else ([], [])
    walked = walk_texts(read, symbols, levels, rest)
    tail = read.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("rid", F.col("x.tail").alias("word"), F.col("x.tail_n").alias("k"))
    met = tail.join(counts.where(F.col("c") < edge), "word", "left")
    unit = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / (n + 0.1 * (v + 1)))
    unseen = F.element_at(F.array(*[F.lit(float(np.log10(x))) for x in symbols.unseen[1:]]), F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(SHARED)).cast("int") + 1)
    inner = F.when(F.col("c").isNotNull(), F.log10("c")).otherwise(unseen)
    parts = met.groupBy("rid").agg(F.sum(F.col("k") * unit).alias("base"), F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("known"), F.sum(F.col("k") * inner).alias("told"))
    out = read.select("rid", "doc_id", "held_out", "n_tokens", "head_known", "head_score", "own").join(walked, "rid").join(parts, "rid", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("base", zero)).alias("base_score"), (F.col("symbols_score") + F.col("own") + F.coalesce("told", zero)).alias("score"),
    )
