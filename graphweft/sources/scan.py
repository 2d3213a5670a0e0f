"""One large JSON document read by many tasks: its parts, their elements, and early stops.

A document is one object with a few top-level keys whose values are scalars or long arrays. The text reader deals its bytes
out in blocks, cut into pieces at closing braces. A first pass tells, for each block, what it does to the string state and the
depth (both for a block that begins within a string and for one that doesn't), and which top-level key it ends in. Summed up
over blocks (one small row each, on the driver) that gives the state every block begins in, so that a second pass can cut
its elements on its own. Both passes stop at the block in which the wanted part ends; other blocks are left unread.

Defined results: an empty file has no rows; elements come in no order; an array element cut by a block's edge is put together
again; a part that is missing or empty has no rows; one that isn't an array and a document that isn't an object raise
ValueError in the task; elements that don't parse fail the job; a task holds one batch of pieces and one element.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.runtime import settled

_KEY = re.compile(rb'"([^"]*)"\s*:$')
#: The least depth of a colon where there is none.
_NO_COLON = 1 << 40
_SUMMARY = "block long, turns int, " + ", ".join(f"delta{i} long, least{i} long, key{i} string, met{i} boolean" for i in (0, 1))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """piece (the bytes up to a closing brace), file, block (where the block begins in the file); in order within a block, which is one partition."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _chunks(batches) -> Iterator[tuple[int, bytes]]:
    """(block, bytes) of each batch, the braces put back; the document's own opening brace and what is before it are left out."""
    begun = file = None
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block")[0].as_py()
        files = {file, *b.column("file").unique().to_pylist()} - {None}
        if len(files) > 1:
            raise ValueError("more than one document")
        file = files.pop()
        raw = b"}".join([*b.column("piece").to_pylist(), b""])
        if block == 0 and not begun:
            at = len(raw) - len(raw.lstrip(b"\xef\xbb\xbf \t\r\n"))
            if raw[at : at + 1] != b"{":
                raise ValueError("the document isn't an object")
            raw, begun = raw[at + 1 :], True
        yield block, raw


def _plain(raw: bytes) -> np.ndarray:
    """The bytes with escapes blanked, so that every quote left begins or ends a string."""
    return np.frombuffer(raw.replace(b"\\\\", b"__").replace(b'\\"', b"__"), np.uint8)


def _depths(x: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte whether it is outside strings, and the depth after it, counted from 0."""
    quote = x == 34
    out = (((np.cumsum(quote) - quote + inside) & 1) == 0) & ~quote
    step = np.where((x == 91) | (x == 123), 1, np.where((x == 93) | (x == 125), -1, 0)) * out
    return out, np.cumsum(step)


def _key(raw: bytes, colon: int) -> str:
    """The key before a colon; empty for one that is longer or stranger than any that is asked for."""
    found = _KEY.search(raw[max(0, colon - 512) : colon + 1])
    return found[1].decode(errors="replace") if found else ""


def _summary(part: str):
    """Over a block's batches: one row of what the block does to the state that it begins in."""

    def batches(it):
        block, turns = None, 0
        now = [{"delta": 0, "least": _NO_COLON, "key": None, "met": False} for _ in range(2)]
        for block, raw in _chunks(it):
            x = _plain(raw)
            for start, s in enumerate(now):
                out, depth = _depths(x, start ^ turns)
                if not len(depth):
                    continue
                depth = depth + s["delta"]
                s["delta"] = int(depth[-1])
                colons = np.flatnonzero(out & (x == 58))
                if not len(colons) or (least := int(depth[colons].min())) > s["least"]:
                    continue
                if least < s["least"]:
                    s.update(least=least, met=False)
                colons = colons[depth[colons] == least]
                s["key"] = _key(raw, int(colons[-1]))
                s["met"] |= f'"{part}"'.encode() in raw and any(_key(raw, int(c)) == part for c in colons)
            turns ^= int((x == 34).sum()) & 1
        if block is not None:
            row = {"block": block, "turns": turns} | {f"{k}{i}": v for i, s in enumerate(now) for k, v in s.items()}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("turns", pa.int32()), *((f"{k}{i}", t) for i in (0, 1) for k, t in (("delta", pa.int64()), ("least", pa.int64()), ("key", pa.string()), ("met", pa.bool_())))]))

    return batches


def block_states(spark: SparkSession, path: str, part: str, to_end: bool = False) -> dict[int, tuple[int, int, str | None]]:
    """Of the blocks that hold some of `part`, by where they begin: within a string or not (1, 0), depth and top-level key they begin with.

    Blocks are summed up 1, 4, 16, ... at a time until the part has ended, or all of them (to_end: for documents that repeat a key). The driver holds one row of each.
    """
    summed = _pieces(spark, path).mapInArrow(_summary(part), _SUMMARY)
    most = 1
    while True:
        rows = summed.collect() if to_end else summed.take(most)
        if len({r["block"] for r in rows}) < len(rows):
            raise ValueError("more than one document")
        inside, depth, key, met, states = 0, 1, None, False, {}
        for r in sorted(rows, key=lambda r: r["block"]):
            i = inside
            top = depth + r[f"least{i}"] == 1
            here = top and r[f"met{i}"]
            if here or key == part:
                states[r["block"]] = (inside, depth, key)
            met |= here
            inside, depth, key = i ^ r["turns"], depth + r[f"delta{i}"], r[f"key{i}"] if top else key
        if to_end or len(rows) < most or (met and key != part):
            return states
        most *= 4


def _elements(part: str, states: dict[int, tuple[int, int, str | None]]):
    """Over a block's batches: its elements of `part`; those that a block's edge cuts come as what is before its first end (opens: false) and after its last (closes: false)."""

    def batches(it):
        state = None
        for block, raw in _chunks(it):
            if state is None:
                if block not in states:
                    return
                state = states[block]
                inside, depth, key = state
                held, opens, within = [], False, key == part and depth >= 2
            x = _plain(raw)
            out, d = _depths(x, inside)
            d = d + depth
            marks = np.flatnonzero(out & (((x == 58) & (d == 1)) | ((x == 44) & (d == 2)) | (((x == 91) | (x == 123)) & (d == 2)) | ((x == 93) & (d == 1))))
            at, rows = 0, []
            for m in marks.tolist():
                c = raw[m]
                if c == 58:
                    key, within = _key(raw, m), False
                elif key != part:
                    continue
                elif c == 123:
                    raise ValueError(f"{part} isn't an array")
                elif c == 91:
                    held, opens, within, at = [], True, True, m + 1
                elif within:
                    rows.append((block, opens, True, b"".join([*held, raw[at:m]])))
                    held, opens, within, at = [], True, c == 44, m + 1
            if within:
                held.append(raw[at:])
            if rows:
                yield _rows(rows)
            if len(d):
                depth, inside = int(d[-1]), inside ^ (int((x == 34).sum()) & 1)
            if depth <= 0:
                break
        if state is not None and within:
            yield _rows([(block, opens, False, b"".join(held))])

    return batches


def _rows(rows) -> pa.RecordBatch:
    block, opens, closes, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(opens, pa.bool_()), pa.array(closes, pa.bool_()), pa.array([t.decode().strip() if o and c else None for t, o, c in zip(text, opens, closes)], pa.string()), pa.array([None if o and c else t for t, o, c in zip(text, opens, closes)], pa.binary())], ["block", "opens", "closes", "element", "cut"])


def elements(spark: SparkSession, path: str, part: str, to_end: bool = False) -> DataFrame:
    """element: the JSON text of each element of the array `part`."""
    states = block_states(spark, path, part, to_end)
    found = _pieces(spark, path).mapInArrow(_elements(part, states), "block long, opens boolean, closes boolean, element string, cut binary")
    whole = found.where("opens and closes and element <> ''").select("element")
    if len(states) < 2:
        return whole
    edges = settled(found.where("not (opens and closes)"), "cut-elements")  # two rows of a block at most
    order = Window.orderBy("block", "opens")  # what a block begins with isn't opened in it
    group = F.max(F.when(F.col("opens"), F.col("block"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = edges.withColumn("own", group).groupBy("own").agg(F.array_sort(F.collect_list(F.struct("block", "opens", "cut"))).alias("cuts"))
    text = F.btrim(F.decode(F.aggregate("cuts", F.lit(b""), lambda a, c: F.concat(a, c["cut"])), "UTF-8"), F.lit(" \t\r\n"))
    return whole.unionByName(joined.select(text.alias("element")).where("element <> ''"))


def header(spark: SparkSession, path: str, names: list[str]) -> dict[str, object]:
    """The scalars of some top-level keys. Where they stand before the first closing brace, as they do in documents written here, one task reads that far and no further; else the whole document is parsed for them."""
    first = spark.read.option("lineSep", "}").text(path).select("value").take(1)
    if not first:
        return {}
    text, found, at = first[0]["value"], {}, 0
    scan = json.JSONDecoder()
    key = re.compile(r'\s*[{,]\s*("(?:[^"\\]|\\.)*")\s*:\s*')
    while m := key.match(text, at):
        try:
            value, at = scan.raw_decode(text, m.end())
        except ValueError:  # a value that goes on beyond the piece
            break
        found[json.loads(m[1])] = value
    return {n: found[n] for n in names if n in found}
