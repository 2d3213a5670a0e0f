"""Checks of rendered documents: structure, headings and links, symbols, claims against facts, prose."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions.text import has_secret

BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK)))


def fences_balanced(text: Column) -> Column:
    """Whether every opened code fence is closed: each fence line opens or closes, whichever of the two marks it has."""
    return F.size(F.filter(_lines(text), lambda x: x.startswith("```") | x.startswith("~~~"))) % 2 == 0


def table_rows_whole(text: Column) -> Column:
    """Whether every line that begins with a bar has another one."""
    return F.forall(_lines(text), lambda x: ~x.startswith("|") | F.substr(x, F.lit(2)).contains("|"))


def slug(heading: Column) -> Column:
    """A heading's anchor: lower case, letters, numbers, hyphens and underscores kept, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(heading), r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def prose_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of lines outside code fences."""
    flat = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    fence = F.btrim("line", F.lit(BLANK)).rlike("^(```|~~~)")
    before = F.sum(fence.cast("int")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return flat.withColumns({"_f": fence, "_n": before}).where(~F.col("_f") & (F.col("_n") % 2 == 0)).drop("_f", "_n")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, level, title, anchor) of headings outside fences, but for the heading of a table of contents; the n-th of one anchor gets -n."""
    line = F.ltrim(F.translate("line", "\t", " "))
    level = F.length(F.regexp_extract(line, r"^(#{1,6})(?: |\r?$)", 1))
    title = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(line, "^#{1,6}", ""), F.lit(BLANK)), "#+$", ""), F.lit(BLANK))
    got = prose_lines(docs).select("doc_id", "pos", level.alias("level"), title.alias("title")).where((F.col("level") > 0) & (F.col("title") != ""))
    got = got.where(~((F.col("level") == 2) & F.lower("title").isin("contents", "table of contents"))).withColumn("base", slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("pos")) - 1
    return got.withColumn("n", n).select("doc_id", "pos", "level", "title", F.when(F.col("n") > 0, F.concat("base", F.lit("-"), F.col("n").cast("string"))).otherwise(F.col("base")).alias("anchor"))


def tables_of_contents(docs: DataFrame) -> DataFrame:
    """(doc_id, toc): a list of links to the headings of each document, indented by level."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")"))
    rows = headings(docs).select("doc_id", F.struct("pos", entry.alias("e")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["e"]), "\n").alias("toc"))


def links(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, target) of links outside fences."""
    each = F.regexp_extract_all("line", F.lit(r"(\[[^\]]*\]\([^)\s]*\))"), F.lit(1))
    one = prose_lines(docs).select("doc_id", "pos", F.explode(each).alias("l"))
    return one.select("doc_id", "pos", F.regexp_extract("l", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("l", r"\(([^)]*)\)$", 1).alias("target"))


def broken_references(docs: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(doc_id, pos, target, reason) of docs (doc_id, path, text): links to files that aren't there, to anchors that no heading has, to lines beyond the end, and unknown
    symbols in labels. Links that leave the documents are not followed."""
    lk = links(docs).where(~F.col("target").isin("", "#") & ~F.col("target").rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~F.col("target").startswith("//"))
    lk = lk.join(docs.select("doc_id", "path"), "doc_id")
    folder = F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    file = F.regexp_extract("target", "^([^#]*)", 1)
    anchor = F.when(F.col("target").contains("#"), F.regexp_extract("target", "#(.*)$", 1))
    whole = F.when(file == "", F.col("path")).when(file.startswith("/"), F.substr(file, F.lit(2))).otherwise(F.concat(folder, F.regexp_replace(file, r"^\./", "")))
    lk = lk.select("doc_id", "pos", "target", whole.alias("file"), anchor.alias("anchor"))
    known = docs.select(F.col("path").alias("file"), F.col("doc_id").alias("to"), F.size(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("n_lines"))
    met = lk.join(known, "file", "left")
    span = r"^L(\d+)(?:-L?(\d+))?$"
    first, last = F.regexp_extract("anchor", span, 1).try_cast("int"), F.regexp_extract("anchor", span, 2).try_cast("int")
    last = F.coalesce(last, first)
    missing = met.where("to is null").select("doc_id", "pos", "target", F.lit("file not found").alias("reason"))
    ranges = met.where(F.col("to").isNotNull() & F.col("anchor").rlike(span) & ((first < 1) | (last < first) | (last > F.col("n_lines")))).select("doc_id", "pos", "target", F.lit("line out of range").alias("reason"))
    own = headings(docs).select(F.col("doc_id").alias("to"), "anchor")
    loose = met.where(F.col("to").isNotNull() & (F.coalesce("anchor", F.lit("")) != "") & ~F.col("anchor").rlike(span)).join(own, ["to", "anchor"], "left_anti").select("doc_id", "pos", "target", F.lit("anchor not found").alias("reason"))
    out = missing.unionByName(ranges).unionByName(loose)
    if symbols is not None:
        named = links(docs).select("doc_id", "pos", F.explode(F.regexp_extract_all("label", F.lit("`([^`]+)`"), F.lit(1))).alias("symbol"))
        out = out.unionByName(named.join(symbols.select("symbol"), "symbol", "left_anti").select("doc_id", "pos", F.col("symbol").alias("target"), F.lit("unknown symbol").alias("reason")))
    return out


def named_symbols(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("`([A-Za-z_][A-Za-z0-9_.]+)`"), F.lit(1)))


def unknown_symbols(docs: DataFrame, symbols: DataFrame, allowed: list[str] = ()) -> DataFrame:
    """(doc_id, symbol) of backticked names that are neither symbols (symbol) nor allowed."""
    named = docs.select("doc_id", F.explode(named_symbols(F.col("text"))).alias("symbol"))
    return named.where(~F.col("symbol").isin(list(allowed))).join(symbols.select("symbol"), "symbol", "left_anti").select("doc_id", "symbol")


#: First words that a diagram may begin with.
DIAGRAMS = ["graph", "flowchart", "sequenceDiagram", "classDiagram", "stateDiagram", "stateDiagram-v2", "erDiagram", "gantt", "pie", "journey", "mindmap", "timeline", "gitGraph", "C4Context", "quadrantChart"]


def diagrams_known(text: Column) -> Column:
    """Whether every fenced Mermaid block begins with a kind of diagram that there is."""
    first = F.regexp_extract_all(text, F.lit(r"(?s)```mermaid[ \t]*\r?\n\s*(\S*)"), F.lit(1))
    return F.forall(first, lambda w: w.isin(DIAGRAMS))


def words_of_section(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def gate(sections: DataFrame, symbols: DataFrame | None = None, allowed: list[str] = (), synonyms: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, failed, no_op) of sections (doc_id, old, text): the first gate that fails, 1 syntax, 2 diagrams, 3 symbols (if given), 4 secrets, 0 if none; and whether the
    words, synonyms taken as one, are those of the old text."""
    out = sections
    if symbols is not None:
        bad = unknown_symbols(sections, symbols, allowed).select("doc_id").distinct().withColumn("_bad", F.lit(True))
        out = out.join(bad, "doc_id", "left")
    else:
        out = out.withColumn("_bad", F.lit(None).cast("boolean"))
    t = F.col("text")
    failed = F.when(~(fences_balanced(t) & table_rows_whole(t)), 1).when(~diagrams_known(t), 2).when(F.coalesce("_bad", F.lit(False)), 3).when(has_secret(t), 4).otherwise(0)
    same = {k.lower(): v.lower() for k, v in (synonyms or {}).items()}

    def plain(text):
        if not same:
            return words_of_section(text)
        names = F.create_map(*[F.lit(x) for kv in same.items() for x in kv])
        return F.array_sort(F.array_distinct(F.transform(words_of_section(text), lambda w: F.coalesce(F.try_element_at(names, w), w))))

    return out.select("doc_id", failed.alias("failed"), ((failed == 0) & (plain(F.coalesce("old", F.lit(""))) == plain(t))).alias("no_op"))


# Claims against facts

ABBREVIATIONS = {"etc", "mr", "mrs", "ms", "dr", "vs", "fig", "no", "st", "jr", "sr", "prof"}
_LINK, _URL, _AUTO, _COMMENT = re.compile(r"\[([^\]]*)\]\([^)]*\)"), re.compile(r"https?://\S+|www\.\S+"), re.compile(r"<https?://[^>]*>"), re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_MARK, _SPAN, _RULE = re.compile(r"^(?:[#>]+\s*|[-*+]\s+|\d+[.)]\s+)+"), re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S), re.compile(r"[|\-: \t]*")


def sentences(text: str) -> list[str]:
    """Claims of a text: its sentences and lines outside fences, comments, links' targets and table heads."""
    kept, fenced = [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            kept.append(line)
    rows = _URL.sub("", _LINK.sub(r"\1", _AUTO.sub("", _COMMENT.sub("", "\n".join(kept))))).split("\n")
    heads = {i + d for i, r in enumerate(rows) if "-" in r and _RULE.fullmatch(r) for d in (-1, 0)}
    out = []
    for i, row in enumerate(rows):
        if i in heads:
            continue
        row, start, code = _MARK.sub("", row.strip()), 0, False
        k = 0
        while k < len(row):
            if row[k] == "`":
                code = not code
            elif not code and row[k] in ".!?":
                end = k
                while end < len(row) and row[end] in ".!?":
                    end += 1
                close = end
                while close < len(row) and row[close] in "\"')]`":
                    close += 1
                word = re.search(r"[A-Za-z]*$", row[start:k]).group().lower()
                if (close == len(row) or row[close] in " \t") and not (row[k] == "." and word in ABBREVIATIONS):
                    out.append(row[start:close])
                    start = close
                k = end - 1
            k += 1
        out.append(row[start:])
    return [c for c in (" ".join(x.split()) for x in out) if any(ch.isalnum() for ch in c)]


def supported(claim: str, blob: str, tokens: set[str], stop: set[str]) -> bool:
    """Whether every backticked name of a claim is among the facts or, without any, whether one of its longer words is."""
    named = False
    for _, span in _SPAN.findall(claim):
        parts = [p for p in re.split(r"\W+", span) if p and not p.isdigit()]
        if parts:
            named = True
            if span.strip().lower() not in blob and any(p.lower() not in tokens for p in parts):
                return False
    return named or any(w in tokens for w in re.split(r"[\W_]+", claim.lower()) if len(w) >= 4 and w not in stop)


def faithfulness(sections: DataFrame, stop: list[str]) -> DataFrame:
    """(doc_id, claims, held, score) of sections (doc_id, text, facts): supported claims over all, 1 without any."""
    words = set(stop)

    def batches(it):
        for pdf in it:
            out = []
            for i, text, facts in zip(pdf["doc_id"], pdf["text"], pdf["facts"]):
                blob = (facts or "").lower()
                tokens = {w for w in re.split(r"\W+", blob) if w}
                told = sentences(text or "")
                held = sum(supported(c, blob, tokens, words) for c in told)
                out.append((i, len(told), held, held / len(told) if told else 1.0))
            yield pd.DataFrame(out, columns=["doc_id", "claims", "held", "score"])

    kind = sections.schema["doc_id"].dataType.simpleString()
    return sections.select("doc_id", "text", "facts").mapInPandas(batches, f"doc_id {kind}, claims long, held long, score double")


# Prose

# Forms of be, misspelt words.
BE = ["is", "are", "was", "were", "be", "been", "being"]
TYPOS = [
    "teh", "recieve", "seperate", "occurrance", "accomodate", "definately", "arguement", "calender", "cemetary", "changable", "collegue", "comming", "commited", "dependance", "existance", "experiance", "freind",
    "goverment", "grammer", "harrass", "imediate", "independant", "knowlege", "liason", "maintanance", "managment", "millenium", "neccessary", "noticable", "ocasionally", "persue", "posession", "publically",
    "rythm", "saftey", "seige", "sucess", "thier", "tommorow", "truely",
]


def prose(docs: DataFrame, jargon: list[str] = (), strict: bool = False) -> DataFrame:
    """(doc_id, passive, typos, doubled, jargon, skips, tops, trailing, tabs, long_sentences, score): findings in prose lines and what they leave of 100.

    Passive: a form of be with a word on -ed or -en among the next three. Errors (misspelt and doubled words, headings that skip a level, tabs, and jargon if strict)
    cost five points, others two; so does each word that sentences have on average beyond 20, and each percent of words of seven letters beyond 30, one.
    """
    own = prose_lines(docs)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("line"), "`[^`]*`", " "), r"\]\([^)]*\)", "]"), r"<https?://[^>]*>|https?://\S+|www\.\S+", " ")
    words = F.filter(F.split(F.lower(bare), r"[^\p{L}\p{N}'-]+"), lambda w: w.rlike(r"\p{L}"))
    w = F.col("w")
    n = F.size("w")
    ids = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    passive = F.size(F.filter(ids, lambda i: F.array_contains(F.array(*map(F.lit, BE)), F.get(w, i)) & F.exists(F.slice(w, i + 2, F.lit(3)), lambda x: x.endswith("ed") | x.endswith("en"))))
    doubled = F.size(F.filter(ids, lambda i: (i > 0) & (F.get(w, i) == F.get(w, i - 1))))
    bad = F.size(F.filter(w, lambda x: x.isin(TYPOS)))
    terms = F.size(F.filter(w, lambda x: x.isin([j.lower() for j in jargon]))) if jargon else F.lit(0)
    long = F.size(F.filter(w, lambda x: F.length(F.regexp_replace(x, r"[^\p{L}]", "")) >= 7))
    ends = F.size(F.regexp_extract_all(F.btrim(bare, F.lit(BLANK)), F.lit(r"([.!?]+)(?:\s|\z)"), F.lit(1)))
    per_line = own.withColumn("w", words).select("doc_id", "pos", "line", n.alias("n"), passive.alias("passive"), doubled.alias("doubled"), bad.alias("typos"), terms.alias("jargon"), long.alias("long"), ends.alias("ends"))
    sums = per_line.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n", "passive", "doubled", "typos", "jargon", "long", "ends")], F.count_if(F.col("line").rlike("[ \t]+\r?$")).alias("trailing"), F.count_if(F.col("line").rlike("^[ ]*\t")).alias("tabs"))
    h = headings(docs)
    before = F.lag("level").over(Window.partitionBy("doc_id").orderBy("pos"))
    heads = h.withColumn("b", before).groupBy("doc_id").agg(F.count_if(F.col("level") > F.col("b") + 1).alias("skips"), F.greatest(F.count_if(F.col("level") == 1) - 1, F.lit(0)).alias("tops"))
    met = docs.select("doc_id").join(sums, "doc_id", "left").join(heads, "doc_id", "left").na.fill(0)
    errors = F.col("typos") + F.col("doubled") + F.col("skips") + F.col("tabs") + (F.col("jargon") if strict else F.lit(0))
    warns = F.col("passive") + F.col("tops") + F.col("trailing") + (F.lit(0) if strict else F.col("jargon"))
    mean = F.col("n") / F.greatest(F.col("ends"), F.lit(1))
    share = F.when(F.col("n") > 0, 100.0 * F.col("long") / F.col("n")).otherwise(0.0)
    over = lambda x: F.greatest(F.floor(x), F.lit(0))
    score = F.greatest(F.lit(0), 100 - 5 * errors - 2 * warns - over(mean - 20) - over(share - 30)).cast("double")
    return met.select("doc_id", "passive", "typos", "doubled", "jargon", "skips", "tops", "trailing", "tabs", score.alias("score"))
