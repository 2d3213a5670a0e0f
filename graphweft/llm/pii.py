"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans.

The tagger is trained in numpy from labelled spans: those that the patterns find in a bounded
sample of documents, and written variants set into stretches of the same documents. It reads
windows of `WINDOW` characters that overlap by half. Every kind needs a digit or an at sign, so a
span has some window with one; a window with neither is read if a span of a window beside it
reaches its edge. Pieces that edges cut are joined on the text with all pieces of their kind that they meet, so a span may be
longer than a window. Spans of all windows of a text are reconciled at once: each must pass its
kind's check, may not touch a pattern's span, and of those that overlap the set with the
highest total margin stays (weighted interval scheduling).

The tagger is trained on at most `SAMPLE_WINDOWS` windows: a third of them from at most
`SAMPLE_DOCS` documents, eight of each spread over its whole text, the others written.

Defined results: null and empty texts have no spans; rows with repeated or null doc_id get a row
each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STEP = 64, 32
#: Documents and windows that the tagger is trained on, at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 2000, 2400

_AT_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can't start within a run of digits unless one could start at the run's first.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches; each lies within one run of its characters, so only runs with an at sign are searched."""
    at = text.find("@")
    while at >= 0:
        a = at
        while a and (text[a - 1].isascii() and (text[a - 1].isalnum() or text[a - 1] in "._%+-")):
            a -= 1
        b = _AT_RUN.match(text, at).end()
        start = a
        while start < b:
            sign = text.find("@", start, b)
            if sign < 0:
                break
            m = _EMAIL.match(text, start) if sign > start else None
            if m:
                yield m.start(), m.end()
                start = m.end()
            else:
                start = sign + 1  # what precedes this sign can't match, wherever it starts
        at = text.find("@", b)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def _plausible(text: str, a: int, b: int, kind: int) -> bool:
    """Whether a span that the tagger proposes can be of its kind at all."""
    s = text[a:b]
    if s != s.strip() or (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    digits = re.sub(r"[^0-9]", "", s)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+[\x20(\[]{0,2}@[\x20)\]]{0,2}[^\s@]+\.[^\s@]+", s))
    if kind == 1:
        got = re.split(r"[^0-9]+", s)
        return len(got) == 4 and all(x and len(x) <= 3 and int(x) <= 255 for x in got)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9][0-9\x20./_-]*[0-9]", s))
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9\x20()./-]*[0-9]", s)) and len(re.findall(r"[^0-9]+", s)) >= 2


def char_classes(text: str) -> np.ndarray:
    """Small numbers for characters: digits, letters by case, white space, each ASCII mark, other letters, everything else."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _TABLE[np.minimum(code, 128)]


def _class_table() -> np.ndarray:
    marks = "@.-_+%(),:;/\\'\"[]{}<>=#*&!?|$^`~"
    out = np.zeros(129, np.int64)
    for c in range(128):
        ch = chr(c)
        out[c] = 1 if ch.isdigit() else 2 if ch.islower() else 3 if ch.isupper() else 4 if ch.isspace() else 5 + marks.index(ch) if ch in marks else 0
    out[128] = 5 + len(marks)
    return out


_TABLE = _class_table()
CLASSES = int(_TABLE.max()) + 1
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """BiLSTM over character classes, a linear layer to tag scores, CRF transitions."""

    def __init__(self, hidden: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.p[f"h{d}"] = rng.normal(0, 0.3, (h, 4 * h))
            self.p[f"b{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["out"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.p["bias"] = np.zeros(TAGS)
        self.p["trans"] = rng.normal(0, 0.1, (TAGS, TAGS))
        self.p["start"] = np.zeros(TAGS)

    def _run(self, x, d, keep=None):
        """States of one direction for classes x (steps first)."""
        h, p = self.hidden, self.p
        state, cell = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        out = np.zeros((*x.shape, h))
        order = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        for t in order:
            z = p[f"x{d}"][x[t]] + state @ p[f"h{d}"] + p[f"b{d}"]
            i, f, o, g = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h]), np.tanh(z[:, 3 * h :])
            old_state, old_cell = state, cell
            cell = f * old_cell + i * g
            tc = np.tanh(cell)
            state = o * tc
            out[t] = state
            if keep is not None:
                keep.append((t, i, f, o, g, old_cell, tc, old_state))
        return out

    def emissions(self, x):
        both = np.concatenate([self._run(x, "f"), self._run(x, "b")], axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradients(self, x, y):
        """Loss (mean negative log-likelihood of the tag paths) and gradients, for classes x and tags y, steps first."""
        h, p, (steps, n) = self.hidden, self.p, x.shape
        keeps = {d: [] for d in "fb"}
        states = {d: self._run(x, d, keeps[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        e = both @ p["out"] + p["bias"]
        alpha, beta = np.zeros((steps, n, TAGS)), np.zeros((steps, n, TAGS))
        alpha[0] = p["start"] + e[0]

        def lse(v, axis):
            m = v.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(v - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + p["trans"], 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(p["trans"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[:, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        rows = np.arange(n)
        gold = p["start"][y[0]] + e[0][rows, y[0]]
        for t in range(steps):
            de[t][rows, y[t]] -= 1
            if t:
                pair = np.exp(alpha[t - 1][:, :, None] + p["trans"] + (e[t] + beta[t])[:, None, :] - z[:, None, None])
                g["trans"] += pair.sum(axis=0)
                np.add.at(g["trans"], (y[t - 1], y[t]), -1)
                gold += p["trans"][y[t - 1], y[t]] + e[t][rows, y[t]]
        g["start"] = de[0].sum(axis=0)
        g["bias"] = de.sum(axis=(0, 1))
        g["out"] = np.einsum("tnh,tnk->hk", both, de)
        dboth = de @ p["out"].T
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            ds, dc = np.zeros((n, h)), np.zeros((n, h))
            for t, i, f, o, gg, old_cell, tc, old_state in reversed(keeps[d]):
                ds = ds + part[t]
                dc = dc + ds * o * (1 - tc**2)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * old_cell * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1)
                np.add.at(g[f"x{d}"], x[t], dz)
                g[f"h{d}"] += old_state.T @ dz
                g[f"b{d}"] += dz.sum(axis=0)
                ds, dc = dz @ p[f"h{d}"].T, dc * f
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, x, y, epochs: int = 8, batch: int = 64, rate: float = 0.02, seed: int = 7):
        """Adam over shuffled batches; x and y are windows by rows."""
        rng = np.random.default_rng(seed)
        m, v, k = {a: 0.0 for a in self.p}, {a: 0.0 for a in self.p}, 0
        loss = 0.0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                loss, g = self.gradients(x[part].T, y[part].T)
                k += 1
                for a in self.p:
                    m[a] = 0.9 * m[a] + 0.1 * g[a]
                    v[a] = 0.999 * v[a] + 0.001 * g[a] ** 2
                    self.p[a] = self.p[a] - rate * (m[a] / (1 - 0.9**k)) / (np.sqrt(v[a] / (1 - 0.999**k)) + 1e-8)
        return loss

    def decode(self, x):
        """Best tag paths of windows (rows), and the emissions' margin over "outside" at each step."""
        e = self.emissions(x.T)
        steps, n, _ = e.shape
        best, back = self.p["start"] + e[0], np.zeros((steps, n, TAGS), np.int8)
        for t in range(1, steps):
            got = best[:, :, None] + self.p["trans"]
            back[t] = got.argmax(axis=1)
            best = got.max(axis=1) + e[t]
        path = np.zeros((steps, n), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = back[t][np.arange(n), path[t]]
        margin = np.take_along_axis(e, path[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return path.T, margin.T


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    got: dict[int, None] = {}
    for m in _SIGN.finditer(text):
        k = m.start() // STEP
        if k:
            got[(k - 1) * STEP] = None
        got[k * STEP] = None
    return list(got)


def path_spans(path, margin) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, margin) of a window's tags; one that begins inside stands for a span that the window's edge cuts."""
    out, t = [], 0
    while t < len(path):
        if path[t]:
            kind, a = (path[t] - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            out.append((a, t, int(kind), float(margin[a:t].sum())))
        else:
            t += 1
    return out


def joined(pieces: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int, float]]:
    """Spans of pieces (start, end, kind, margin, cut): cut ones grow by all pieces of their kind that they meet."""
    out = [(a, b, k, m) for a, b, k, m, cut in pieces if not cut]
    for kind in range(len(KINDS)):
        own, run = sorted(p for p in pieces if p[2] == kind), []

        def done():
            if any(p[4] for p in run):
                end, total = run[0][0], 0.0
                for a, b, _, m, _ in run:
                    if b > end:
                        total += m * (b - max(a, end)) / (b - a)
                        end = b
                out.append((run[0][0], end, kind, total))

        for p in own:
            if run and p[0] > max(q[1] for q in run):
                done()
                run = []
            run.append(p)
        if run:
            done()
    return out


def reconcile(text: str, proposed: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of all windows' proposals the plausible ones, off the base spans, that don't overlap and have the highest total margin."""
    best: dict[tuple[int, int, int], float] = {}
    for a, b, kind, m in proposed:
        if m > 0 and _plausible(text, a, b, kind) and not any(x < b and a < y for x, _, y in base):
            best[a, b, kind] = max(m, best.get((a, b, kind), 0.0))
    jobs = sorted((b, a, kind, m) for (a, b, kind), m in best.items())
    ends, total, take = [j[0] for j in jobs], [0.0], []
    for i, (b, a, _, m) in enumerate(jobs):
        k = bisect_right(ends, a, 0, i)
        take.append((total[k] + m > total[i], k))
        total.append(max(total[i], total[k] + m))
    out, i = [], len(jobs)
    while i:
        if take[i - 1][0]:
            b, a, kind, _ = jobs[i - 1]
            out.append((a, kind, b))
            i = take[i - 1][1]
        else:
            i -= 1
    return out


def find_spans(texts: list[str], tagger: Tagger, most: int = 2048) -> list[tuple[list, list]]:
    """Of each text, base spans and added ones."""
    base = [base_spans(t) for t in texts]
    pieces: list[list] = [[] for _ in texts]
    todo = [(k, a) for k, t in enumerate(texts) for a in windows_of(t)]
    read = set(todo)
    while todo:
        further = []
        for at in range(0, len(todo), most):
            part = todo[at : at + most]
            x = np.full((len(part), WINDOW), 4, np.int64)
            for r, (k, a) in enumerate(part):
                c = char_classes(texts[k][a : a + WINDOW])
                x[r, : len(c)] = c
            path, margin = tagger.decode(x)
            for r in np.flatnonzero(path.any(axis=1)):
                k, a = part[r]
                size = len(texts[k])
                for s, e, kind, m in path_spans(path[r], margin[r]):
                    left, right = s == 0 and a > 0, e == WINDOW and a + WINDOW < size
                    pieces[k].append((a + s, min(a + e, size), kind, m, left or right))
                    further += [(k, b) for b, cut in ((a - STEP, left), (a + STEP, right)) if cut]
        todo = sorted(set(further) - read)
        read.update(todo)
    return [(b, reconcile(t, joined(p), b) if p else []) for t, p, b in zip(texts, pieces, base)]


def written(rng: np.random.Generator, kind: int) -> str:
    """A labelled example of a kind, in one of several ways of writing it."""
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    name = lambda k: "".join(chr(97 + c) for c in rng.integers(0, 26, k))
    if kind == 0:
        if rng.random() < 0.4:  # a long one, often with spaces around the sign
            return f"{'.'.join(name(rng.integers(3, 12)) for _ in range(rng.integers(1, 4)))}{pick('@', ' @ ', ' @ ')}{'.'.join(name(rng.integers(4, 14)) for _ in range(rng.integers(1, 5)))}.{pick('com', 'net', 'org')}"
        return f"{name(rng.integers(2, 9))}{pick('', '.', '_')}{n(rng.integers(0, 3))}{name(1)}{pick('@', '@', ' @ ')}{name(rng.integers(3, 9))}.{pick('com', 'net', 'org', 'example.com')}"
    if kind == 1:
        return pick(".", ".", "-", ":").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        digits = n(15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return pick("", " ", "-", ".").join(digits[i : i + 4] for i in range(0, 16, 4))
    a, b, c = n(3), n(3), n(4)
    return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+49 {a} {b}{c}", f"{a}.{b}.{c}", f"+1-{a}-{b}-{c}")


def labelled_windows(text: str, most: int = 8) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Stretches of a whole text with the base spans in them (those that an edge cuts begin before or end after it): at most `most` windows with signs, spread over the text, and a plain one from its middle."""
    spans, starts, out = base_spans(text), windows_of(text), []
    for a in starts[:: max(1, -(-len(starts) // most))]:
        near = [(s, k, e) for s, k, e in spans if s < a + WINDOW and e > a]
        out.append((text[a : a + WINDOW], [(s - a, k, e - a) for s, k, e in near]))
    middle = max(0, len(text) // 2 - WINDOW // 2)
    stretch = text[middle : middle + WINDOW]
    if stretch and not _SIGN.search(stretch):
        out.append((stretch, []))
    return out


def training_windows(stretches: list[tuple[str, list[tuple[int, int, int]]]], most: int = SAMPLE_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags: labelled stretches, plain ones, and plain ones with written examples set in."""
    rng = np.random.default_rng(seed)
    own, plain = [x for x in stretches if _SIGN.search(x[0])], [t for t, _ in stretches if not _SIGN.search(t)]
    rows = [own[i] for i in rng.permutation(len(own))[: most // 3]]
    plain = [plain[i] for i in rng.permutation(len(plain))[: most // 4]] or ["a plain stretch of words without anything personal in it at all"]
    rows += [(t, []) for t in plain]
    while len(rows) < most:
        kind = int(rng.integers(4))
        s, host = written(rng, kind), plain[int(rng.integers(len(plain)))]
        inside = rng.random() < 0.7 and len(s) < WINDOW
        at = int(rng.integers(0, max(1, WINDOW - len(s) - 1))) if inside else int(rng.integers(2 - len(s), WINDOW - 1))
        if at < 0:
            rows.append(((s[-at:] + " " + host)[:WINDOW], [(at, kind, at + len(s))]))
        else:
            lead = (host[: at - 1] + " ") if at else ""
            rows.append(((lead + s + " " + host[at:])[:WINDOW], [(len(lead), kind, len(lead) + len(s))]))
    x, y = np.full((len(rows), WINDOW), 4, np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for r, (t, spans) in enumerate(rows):
        c = char_classes(t)
        x[r, : len(c)] = c
        for s, k, e in sorted(spans, key=lambda z: -z[1]):
            y[r, max(0, s) : e] = 2 + 2 * k
            if s >= 0:
                y[r, s] = 1 + 2 * k
    return x, y


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Tagger:
    """A tagger from labelled windows of at most `sample` documents (those of smallest id hash); only the windows reach the driver."""
    from .common import bounded_sample

    some = bounded_sample(docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", sample)

    def batches(it):
        for b in it:
            got = [x for t in b.column("text") for x in labelled_windows(t.as_py() or "")]
            told = [",".join(f"{a}:{k}:{e}" for a, k, e in spans) for _, spans in got]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array(told, pa.string())], ["stretch", "told"])

    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text").mapInArrow(batches, "stretch string, told string").distinct().toPandas()
    stretches = sorted((t, [tuple(map(int, x.split(":"))) for x in told.split(",") if x]) for t, told in zip(rows["stretch"], rows["told"]))
    tagger = Tagger()
    tagger.fit(*training_windows(stretches))
    return tagger


def _told(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger.p)  # weights of a fixed shape
    hidden = tagger.hidden

    def batches(it):
        tagger = Tagger(hidden)
        tagger.p = {k: v.astype(np.float32) for k, v in sent.value.items()}
        for b in it:
            out = []
            texts, size = [], 0

            def flush():
                for base, added in find_spans(texts, tagger):
                    n = [sum(k == i for _, k, _ in base) for i in range(4)]
                    out.append((*n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(base + added), len(added)))
                texts.clear()

            for t in b.column("text"):
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size > 1 << 21:
                    flush()
                    size = 0
            flush()
            cols = [list(c) for c in zip(*out)] or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
