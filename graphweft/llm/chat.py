"""Chat formatting: conversations to training strings and back, by Spark expressions only.

Template of a run of turns with one role: `<s>` role `<text>` text [`<turn>` text ...] `</s>`.
Those four strings are the controls. In roles and texts a backslash is doubled and a control
gets a backslash after its `<`, which can be undone exactly: between `<` and the rest of a
control an escaped text has an even number of backslashes, or one.

The loss mask covers the texts of assistant turns: `segments` cuts the formatted string into
pieces with a flag each, so the mask is kept without positions.

Defined results: null role and null text count as empty; turns with one number are ordered by
role, then text, and repeated rows are turns of their own; a null conv_id is a conversation;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_sha256

#: What follows `<` in each control string.
TAILS = ["s>", "/s>", "text>", "turn>"]
#: Turns that one array aggregation merges: appending is quadratic within a block and linear over blocks.
BLOCK = 256


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for tail in TAILS:
        text = F.replace(text, F.lit(f"<{tail}"), F.lit(f"<\\{tail}"))
    return text


def unescape(text: Column) -> Column:
    for tail in reversed(TAILS):
        text = F.replace(text, F.lit(f"<\\{tail}"), F.lit(f"<{tail}"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _runs(turns: Column, n: Column) -> Column:
    """Adjacent turns of one role as struct(role, opens, texts); `opens` is false where a run goes on from the block before."""
    kind = "array<struct<role:string,opens:boolean,texts:array<string>>>"

    def add(runs, t):
        last = F.element_at(runs, -1)
        grown = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["role"].alias("role"), last["opens"].alias("opens"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))))
        fresh = F.concat(runs, F.array(F.struct(t["role"].alias("role"), F.lit(True).alias("opens"), F.array(t["text"]).alias("texts"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["role"] == t["role"]), F.when(F.size(runs) > 0, grown)).otherwise(fresh).cast(kind)

    def block(start):
        runs = F.aggregate(F.slice(turns, start + 1, F.lit(BLOCK)), F.array().cast(kind), add)
        before = F.get(turns, start - 1)["role"]
        return F.transform(runs, lambda r, i: F.struct(r["role"].alias("role"), ((i > 0) | (start == 0) | ~F.coalesce(before == r["role"], F.lit(False))).alias("opens"), r["texts"].alias("texts")))

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), block))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, segments (array of piece, loss) and n_runs, one row for each conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))
    got = got.withColumn("_runs", _runs(F.col("_turns"), F.size("_turns")))

    def pieces(r, i):
        opening = F.when(r["opens"], F.concat(F.when(i > 0, F.lit("</s>")).otherwise(F.lit("")), F.lit("<s>"), escape(r["role"]), F.lit("<text>"))).otherwise(F.lit("<turn>"))
        texts = F.transform(r["texts"], lambda t, k: F.array(
            F.struct(F.when(k == 0, opening).otherwise(F.lit("<turn>")).alias("piece"), F.lit(False).alias("loss")),
            F.struct(escape(t).alias("piece"), (r["role"] == "assistant").alias("loss")),
        ))
        return F.flatten(texts)

    end = F.array(F.struct(F.lit("</s>").alias("piece"), F.lit(False).alias("loss")))
    got = got.withColumn("segments", F.concat(F.flatten(F.transform("_runs", pieces)), end))
    return got.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"), "segments",
        F.size(F.filter("_runs", lambda r: r["opens"])).cast("long").alias("n_runs"),
    )


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted string: array of struct(role, text)."""
    runs = F.filter(F.split(formatted, r"\Q</s>\E", -1), lambda r: r != "")

    def halves(run):
        parts = F.split(F.substring(run, 4, 2147483647), r"\Q<text>\E", -1)
        return F.struct(unescape(parts[0]).alias("role"), parts[1].alias("body"))

    def turns(run):
        return F.transform(F.split(run["body"], r"\Q<turn>\E", -1), lambda t: F.struct(run["role"].alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.transform(runs, halves), turns))


def digest(chats: DataFrame) -> DataFrame:
    """Read turns and loss text back from formatted chats and digest them."""
    lossy = F.filter("segments", lambda s: s["loss"])
    got = chats.withColumn("_t", parse_chats(F.col("formatted"))).withColumn("_loss", F.array_join(F.transform(lossy, lambda s: unescape(s["piece"])), ""))
    told = F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id", F.size("_t").cast("long").alias("n_turns"), hex_sha256(told).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), hex_sha256(F.col("_loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_runs",
    )
