"""SentencePiece encoding and decoding: merges by a score-ordered agenda of adjacent pairs.

For merge-type (BPE) vocabularies whose text normalisation is the identity with an added front
space. A text is cut where no piece can reach across: before each run of space marks, and around
control characters that no piece holds. Each stretch is merged on its own and remembered by the
worker under a number, so texts become arrays of numbers and these arrays of ids; new stretches are checked against the sentencepiece library, batch by batch. A stretch that the
library encodes differently gets the library's ids; the job fails only if there are more than one
in `DIFFERING` of at least `CHECKED` stretches, as the vocabulary is then of another kind.

Defined results: null and empty texts have no ids and decode to the empty text; rows with
repeated or null doc_id get a row each; other columns pass through, but for those named like
a result, which give way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import let_go

MARK = "▁"
#: Bytes of stretches and ids that a worker remembers, about, if it isn't told another bound; of more it keeps those met most often, up to half of it.
REMEMBERED = 64 << 20
#: What a stretch takes beside its characters (two bytes each) and ids (four): string, dict slot, number, cells.
EACH = 220
#: Stretches from which on, and one in how many of them that may differ from the library's, a worker gives up.
CHECKED, DIFFERING = 1000, 100


class Pieces:
    """A merge-type vocabulary, read from a sentencepiece model."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif lib.is_unused(i):
                raise ValueError("vocabularies with unused pieces aren't supported")
            elif not lib.is_control(i) and not lib.is_unknown(i):
                self.ids[piece] = i
        self.scores = {p: -lib.get_score(i) for p, i in self.ids.items()}
        held = "".join(self.ids)
        alone = "".join(c for c in "\n\t\r" if c not in held)
        if any(MARK in p.lstrip(MARK) for p in self.ids) or not alone.startswith("\n"):
            raise ValueError("pieces reach across space marks or line ends")
        self.stretches = re.compile(rf"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+").findall
        self.checked = self.differing = 0
        self.remembered = REMEMBERED
        self.forget()

    def forget(self) -> None:
        self.numbers, self.bytes_held = _Numbers(), 0
        self.start, self.size, self.met, self.held = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), array("i")

    def shrink(self) -> None:
        """Forget stretches met once, and the rarest of the others beyond half of what may be held."""
        names, n = list(self.numbers), len(self.numbers)
        order = np.argsort(-self.met[:n], kind="stable")
        cost = EACH + 4 * self.size[:n] + 2 * np.fromiter(map(len, names), np.int64, n)
        order = order[(np.cumsum(cost[order]) <= self.remembered // 2) & (self.met[order] > 1)]
        start, size, met, held = self.start[order], self.size[order], self.met[order], np.frombuffer(self.held, np.int32)
        self.forget()
        for k in order.tolist():
            self.numbers[names[k]] = len(self.numbers)
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        self.held, self.bytes_held = array("i", held[at].tobytes()), int(cost[order].sum())
        more = max(1024 - len(order), 0)
        self.start, self.size, self.met = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (ends - size, size, met))

    def merge(self, text: str) -> list[int]:
        """Symbols start as characters; the adjacent pair of best score (then leftmost) is joined until no pair is a piece."""
        scores = self.scores
        symbols: list[str | None] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, str]] = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in scores:
                agenda.append((scores[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            if symbols[i] is None or (j := after[i]) >= n or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been joined to another since
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in scores:
                    heapq.heappush(agenda, (scores[new], i, new))
            if (k := before[i]) >= 0 and (new := symbols[k] + pair) in scores:
                heapq.heappush(agenda, (scores[new], k, new))
        return self._numbers(s for s in symbols if s is not None)

    def _numbers(self, symbols) -> list[int]:
        """Ids of pieces; a character that is none becomes its bytes."""
        out: list[int] = []
        for s in symbols:
            if (known := self.ids.get(s)) is not None:
                out.append(known)
            else:
                out.extend(self.bytes[b] for b in s.encode())
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin. Stretches not met before are merged, then checked."""
        if self.bytes_held > self.remembered:
            self.shrink()
        cut = [self.stretches(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        lens = np.array([len(c) for c in cut], np.int64)
        flat = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(cut)), np.int64, int(lens.sum()))
        if fresh := self.numbers.fresh:
            made = self.check(fresh, [self.merge(s) for s in fresh])
            first, last = len(self.numbers) - len(fresh), len(self.numbers)
            if last > len(self.size):
                more = np.zeros(max(last, 2 * len(self.size)) - len(self.size), np.int64)
                self.start, self.size, self.met = (np.concatenate([x, more]) for x in (self.start, self.size, self.met))
            sizes = np.array([len(m) for m in made], np.int64)
            self.size[first:last] = sizes
            self.start[first:last] = len(self.held) + np.cumsum(sizes) - sizes
            self.held.extend(itertools.chain.from_iterable(made))
            self.bytes_held += EACH * len(fresh) + 2 * sum(map(len, fresh)) + 4 * int(sizes.sum())
            self.numbers.fresh = []
        self.met[: len(self.numbers)] += np.bincount(flat, minlength=len(self.numbers))
        sizes = self.size[flat]
        ends = np.cumsum(sizes)
        at = np.repeat(self.start[flat] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(self.held, np.int32)[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])]

    def look_up(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """Of each text, its ids and their decimal forms joined by commas."""
        ids, cut = self.encode(texts)
        return [(ids[a:b].tolist(), told) for a, b, told in zip(cut, cut[1:], decimal(ids, cut))]

    def check(self, stretches: list[str], made: list[list[int]]) -> list[list[int]]:
        """Merged ids of stretches, or the library's where it has others; a stretch without a space mark in front follows a line end, which is a byte of its own."""
        marked = [k for k, s in enumerate(stretches) if s[0] == MARK and s != MARK]
        bare = [k for k, s in enumerate(stretches) if s[0] != MARK]
        told: list[tuple[int, list[int]]] = []
        if marked:  # a lone mark is the empty text to the library, which has no ids for it; the front mark of a text is never alone there
            told += zip(marked, self.library.encode([stretches[k][1:] for k in marked], num_threads=1))
        if bare:
            front = len(self.library.encode("\n"))
            told += [(k, ids[front:]) for k, ids in zip(bare, self.library.encode(["\n" + stretches[k] for k in bare], num_threads=1))]
        for k, ids in told:
            if ids != made[k]:
                self.differing += 1
                made[k] = ids
        self.checked += len(told)
        if self.checked >= CHECKED and self.differing * DIFFERING > self.checked:
            raise ValueError(f"the library encodes {self.differing} of {self.checked} stretches differently")
        return made


class _Numbers(dict):
    """Numbers of stretches in the order in which they are first met; `fresh` lists those not yet merged."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, s: str) -> int:
        self[s] = n = len(self)
        self.fresh.append(s)
        return n


def decimal(ids: np.ndarray, cut: np.ndarray) -> list[str]:
    """Each text's ids in decimal, joined by commas."""
    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids).cast(pa.string()))
    return pc.binary_join(lists, ",").to_pylist()


_known: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    """One for each worker process: what it remembers serves all its tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _known:
        _known[key] = Pieces(model)
    return _known[key]


def _parts(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Slices of a batch with their texts, of about `most` characters; what Arrow frees of each goes back to the system."""
    at, texts, size = 0, [], 0
    for t in batch.column(column):
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size > most:
            yield batch.slice(at, len(texts)), texts
            at, texts, size = at + len(texts), [], 0
            pa.default_memory_pool().release_unused()
    if texts:
        yield batch.slice(at), texts


def _lists(ids: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids))


def _kept(df: DataFrame, *gone: str):
    fields = [f for f in df.schema.fields if f.name not in gone]
    return [f.name for f in fields], "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)


def encode_texts(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """df with `ids` (array of int) instead of the text."""
    keep, schema = _kept(df, text, "ids")
    sent = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary file: its size doesn't follow the data

    def batches(it):
        let_go()
        pieces = _pieces(sent.value)
        for b in it:
            for part, texts in _parts(b, text):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), _lists(*pieces.encode(texts))], [*keep, "ids"])

    return df.select(*keep, text).mapInArrow(batches, f"{schema}ids array<int>")


def decode_ids(df: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """df with `text` instead of the ids."""
    keep, schema = _kept(df, ids, "text")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        lib = _pieces(sent.value).library
        for b in it:
            texts = [lib.decode(x.as_py() or []) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, ids).mapInArrow(batches, f"{schema}text string")


def round_trip(df: DataFrame, model: bytes, text: str = "text", with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """df without the text, with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: encoded and decoded in one go. `remembered`: bytes that a worker may hold, about."""
    keep, schema = _kept(df, text, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
    sent = df.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        let_go()  # of earlier stages
        pieces = _pieces(sent.value)
        pieces.remembered = remembered
        decode, sha = pieces.library.decode, hashlib.sha256
        for b in it:
            for part, texts in _parts(b, text):
                ids, cut = pieces.encode(texts)
                told = [sha(x.encode()).hexdigest() for x in decimal(ids, cut)]
                back = [sha(decode(ids[x:y].tolist()).encode() if y > x else b"").hexdigest() for x, y in zip(cut.tolist(), cut[1:].tolist())]
                cols = [*(part.column(x) for x in keep), pa.array(np.diff(cut), pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string()), *([_lists(ids, cut)] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return df.select(*keep, text).mapInArrow(batches, f"{schema}n_tokens long, ids_sha256 string, decoded_sha256 string{', ids array<int>' if with_ids else ''}")
