"""Bookkeeping of generated documents: levels, cascades, queues, ledgers, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Events that reach aggregate documents.
CRITICAL = ["SERVICE_ADDED", "SERVICE_REMOVED", "COMPONENT_SPLIT", "COMPONENT_MERGED", "CYCLE_INTRODUCED", "CYCLE_RESOLVED", "LAYER_VIOLATION", "INTERFACE_CHANGED", "NEW_DATABASE_LAYER"]


def doc_level(target: Column, kind: Column, scopes: Column) -> Column:
    """root, aggregate or leaf, by a document's path, kind and scope globs."""
    low = F.lower(F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), r"^\./", ""))
    wide = F.exists(scopes, lambda s: s.isin("**", "internal/**", "cmd/**"))
    return F.when(low.isin("readme.md", "docs/index.md", "docs/readme.md"), "root").when(kind.isin("architecture", "system") | low.contains("architecture.md") | low.contains("overview.md") | wide, "aggregate").otherwise("leaf")


def cascades(events: Column, intent: Column) -> Column:
    """Whether a change reaches aggregate documents: a critical event, or any event of a refactoring or security commit."""
    named = F.transform(events, lambda e: F.upper(F.trim(e)))
    return F.arrays_overlap(named, F.array(*map(F.lit, CRITICAL))) | (F.upper(F.trim(intent)).isin("REFACTOR", "SECURITY") & (F.size(events) > 0))


def exported_symbol(fqn: Column) -> Column:
    """Whether the last name of a qualified one begins with a capital."""
    return F.regexp_extract(fqn, r"([^:./]*)$", 1).rlike(r"^\p{Lu}")


def priority(grounds: Column, sentinels: Column, events: Column, exported: Column) -> Column:
    """5 for sections on configuration alone, 1 for those on errors when sentinels changed, 2 when there were events, 3 when exported symbols changed, else 4."""
    low = F.transform(grounds, lambda g: F.lower(F.trim(g)))
    config = (F.size(grounds) > 0) & F.forall(low, lambda g: g == "config_vars")
    errors = F.exists(low, lambda g: g.isin("sentinels", "error_returns"))
    return F.when(config, 5).when(errors & (sentinels > 0), 1).when(events > 0, 2).when(exported, 3).otherwise(4)


def budget(sections: DataFrame, most: int) -> DataFrame:
    """Sections (doc_id, section_id, priority) in order, the first `most` of them (0: all)."""
    ordered = sections.orderBy("priority", "doc_id", "section_id")
    return ordered.limit(most) if most > 0 else ordered


def ledger_summary(runs: DataFrame, last: int = 0) -> DataFrame:
    """One row over the last runs (run, ts, tokens, duration, docs, fallbacks, freshness, tracks map): sums, means, first and last time, tracks added up."""
    kept = runs.orderBy(F.desc("run")).limit(last) if last else runs
    main = kept.agg(
        F.count("*").alias("runs"), F.sum("tokens").alias("tokens"), F.avg("duration").alias("duration"), F.sum("docs").alias("docs"), F.sum("fallbacks").alias("fallbacks"),
        F.avg("freshness").alias("freshness"), F.min_by("ts", "run").alias("first"), F.max_by("ts", "run").alias("last"),
    )
    tracks = kept.select(F.explode("tracks").alias("track", "n")).groupBy("track").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("track", "n")))).alias("tracks"))
    return main.crossJoin(tracks)  # one row and one row


def alerts(summary: DataFrame, max_tokens: int = 0, min_freshness: float = 0.0, max_fallbacks: int = 0) -> DataFrame:
    """(alert): texts for the bounds that a summary breaks; 0 switches a bound off."""
    told = F.array_compact(F.array(
        F.when(F.lit(max_tokens > 0) & (F.col("tokens") > max_tokens), F.format_string(f"tokens %d exceed budget {max_tokens}", "tokens")),
        F.when(F.lit(min_freshness > 0) & (F.col("freshness") < min_freshness), F.format_string(f"freshness %.1f below minimum {min_freshness:.1f}", "freshness")),
        F.when(F.lit(max_fallbacks > 0) & (F.col("fallbacks") > max_fallbacks), F.format_string(f"fallbacks %d exceed maximum {max_fallbacks}", "fallbacks")),
    ))
    return summary.select(F.explode(told).alias("alert"))


def newest(rows: DataFrame, order: str, keep: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(keep) if keep > 0 else rows


def chunks(sections: DataFrame) -> DataFrame:
    """One JSON line for each section (doc_id, section_id, title, text, kind): id from its content, counts of characters and tokens."""
    from graphweft.functions.text import chunk_id, token_estimate

    t = F.coalesce("text", F.lit(""))
    row = F.struct(chunk_id(t).alias("id"), F.col("doc_id").alias("doc"), F.col("section_id").alias("section"), "title", "kind", F.length(t).alias("chars"), token_estimate(t).alias("tokens"), t.alias("text"))
    return sections.select("doc_id", "section_id", F.to_json(row).alias("value"))


def timeline_lines(entries: DataFrame, style: str = "text") -> DataFrame:
    """(k, line): a timeline (ts, commit, kind, title, description) as text, full text or a Mermaid timeline, oldest first; the numbers come from one sort."""
    day, short = F.date_format("ts", "yyyy-MM-dd"), F.substring("commit", 1, 8)
    if style == "mermaid":
        line = F.concat(F.lit("    "), day, F.lit(" : "), F.replace("title", F.lit(":"), F.lit(" ")))
    else:
        line = F.concat(F.lit("["), day, F.lit("] "), short, F.lit(" "), "kind", F.lit(": "), "title")
        if style == "full":
            line = F.concat(line, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n    "), "description")).otherwise(""))
    return entries.select("ts", "commit", "kind", "title", line.alias("line"))


def bounded_queue(refs: DataFrame, capacity: int) -> DataFrame:
    """What a bounded queue that drops its oldest holds after refs (seq) have come in order."""
    return refs.orderBy(F.desc("seq")).limit(capacity)


def pick_sections(sections: DataFrame, changed: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, hash) that are new or whose hash differs from `changed` (doc_id, section_id, old)."""
    met = sections.join(changed, ["doc_id", "section_id"], "left")
    return met.where(~F.col("hash").eqNullSafe(F.col("old"))).select("doc_id", "section_id", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("why"))


def capped(facts: DataFrame, caps: dict[str, int], default: int) -> DataFrame:
    """Facts (section, kind, name) up to a cap for each section and kind, by name."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("kind")), F.lit(default)) if caps else F.lit(default)
    return facts.withColumn("_r", F.row_number().over(Window.partitionBy("section", "kind").orderBy("name"))).where(F.col("_r") <= cap).drop("_r")
