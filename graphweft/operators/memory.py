"""Event logs folded into memory, claims, aging and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(events: DataFrame, key: str = "component", ts: str = "ts", id: str = "event_id", state: str = "event_type") -> DataFrame:
    """Per component: first and last time, number of events, the latest state."""
    return events.groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.countDistinct(id).alias("events"), F.max_by(state, F.struct(ts, id)).alias("state"))


def resolve_conflicts(claims: DataFrame, subject: str, score: str, start: str, tie: str) -> DataFrame:
    """Of each subject's exclusive claims the best stays ACTIVE; the others are HISTORICAL, valid until the winner's start."""
    w = Window.partitionBy(subject).orderBy(F.desc(score), F.desc(start), tie)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.row_number().over(w) == 1
    return claims.withColumn("state", F.when(best, "ACTIVE").otherwise("HISTORICAL")).withColumn("valid_until", F.when(~best, F.first(start).over(whole)))


def overlay(rows: DataFrame, corrections: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` replaced by the latest correction (key, value, ts, seq) of their key."""
    last = corrections.groupBy(key).agg(F.max_by("value", F.struct("ts", "seq")).alias("_new"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def evidence(items: DataFrame, claim: str = "claim") -> DataFrame:
    """Per claim: greatest confidence times reliability, and the most reliable source (then name)."""
    return items.groupBy(claim).agg(F.max(F.col("confidence") * F.col("reliability")).alias("aggregate"), F.max_by("source", F.struct("reliability", "source")).alias("primary_source"))


def budgeted(ranked: DataFrame, section: str, order: list, cost: str, budget: int) -> DataFrame:
    """The longest prefix of each section that fits the budget, its first row always."""
    w = Window.partitionBy(section).orderBy(*order)
    total = F.sum(F.col(cost) + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_t", total).withColumn("_r", F.row_number().over(w)).where((F.col("_t") <= budget) | (F.col("_r") == 1)).drop("_t", "_r")


def fill_budget(rows: DataFrame, section: str, score: str, id: str, cost: str, budget: int, top: int | None = None) -> DataFrame:
    """Greedy fill by score: what doesn't fit is passed over and cheaper rows after it may still fit; with `top`, only that many rows of a section compete.

    A section's rows stream through one task in order, which holds what is left of the budget and nothing else.
    """
    import pyarrow as pa

    if top is not None:
        w = Window.partitionBy(section).orderBy(F.desc(score), id)
        rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    types = dict(rows.dtypes)
    ordered = rows.select(section, id, cost, score).repartition(section).sortWithinPartitions(F.col(section), F.desc(score), F.col(id)).select(section, id, cost)

    def batches(it):
        now, left, first = None, budget, True
        for b in it:
            keep = []
            for s, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if first or s != now:
                    now, left, first = s, budget, False
                fits = c is not None and c <= left
                left -= c if fits else 0
                keep.append(fits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], [section, id]).filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(batches, f"`{section}` {types[section]}, `{id}` {types[id]}")


# Weights of states, predicates of event kinds (those of removals end a claim), kinds of reasons by source.
STATE_WEIGHTS = {"CURRENT": 1.0, "EXPERIMENTAL": 0.8, "DEPRECATED": 0.6, "HISTORICAL": 0.4, "REMOVED": 0.3}
PREDICATES = {
    "SERVICE_ADDED": "was_added", "SERVICE_REMOVED": "was_removed", "SERVICE_SPLIT": "was_split", "SERVICE_MERGED": "was_merged", "DEPENDENCY_ADDED": "depends_on", "DEPENDENCY_REMOVED": "no_longer_depends_on",
    "PATTERN_DETECTED": "pattern_detected", "PATTERN_REMOVED": "pattern_lost", "SMELL_DETECTED": "smell_introduced", "SMELL_RESOLVED": "smell_resolved", "CYCLE_INTRODUCED": "cycle_introduced",
    "CYCLE_RESOLVED": "cycle_resolved", "COUPLING_INCREASED": "coupling_increased", "COUPLING_DECREASED": "coupling_decreased", "LAYER_VIOLATION": "layer_violation", "DEAD_CODE_DETECTED": "dead_code_detected",
    "CACHING_ADDED": "caching_added", "ASYNC_PATTERN_INTRODUCED": "async_introduced", "DATA_STORE_ADDED": "datastore_added", "API_ENDPOINT_ADDED": "api_added", "SECURITY_LAYER_ADDED": "security_added",
    "BOUNDARY_CREATED": "boundary_created", "STATE_CHANGE": "state_changed_to",
}
ENDING = ["SERVICE_REMOVED", "DEPENDENCY_REMOVED", "PATTERN_REMOVED", "SMELL_RESOLVED", "CYCLE_RESOLVED"]
EXPLICIT_SOURCES, INFERRING_SOURCES = ["git", "pr", "docs", "issue", "user"], ["llm", "heuristic", "rule"]
#: Days in which what a source says loses half its weight.
HALF_LIVES = {"code": 365, "docs": 270, "git": 180, "llm": 90}


def claims_of(events: DataFrame) -> DataFrame:
    """(event_id, subject, predicate, object, kind, state, valid_until) from events (event_id, kind, ts, components, affected, intent, source, tags).

    A fact for each component: of two components each is the other's object, otherwise the first affected id, and what a state change's tag says; a reason
    where there is an intent, explicit or inferred by its source.
    """
    from graphweft.functions.text import state_of_tags

    predicate = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv]), F.col("kind")), F.lit("involved_in_event"))
    ends = F.col("kind").isin(ENDING)
    fact = events.select("*", F.posexplode("components").alias("pos", "subject"))
    other = F.when((F.size("components") > 1) & (F.col("subject") == F.col("components")[0]), F.col("components")[1]).when((F.size("components") > 1) & (F.col("subject") == F.col("components")[1]), F.col("components")[0])
    thing = F.when(F.col("kind") == "STATE_CHANGE", state_of_tags(F.col("tags"))).otherwise(F.coalesce(other, F.get("affected", 0), F.lit("")))
    facts = fact.select("event_id", "subject", predicate.alias("predicate"), thing.alias("object"), F.lit("FACT").alias("claim_kind"), F.when(ends, "REMOVED").otherwise("CURRENT").alias("state"), F.when(ends, F.col("ts")).alias("valid_until"))
    why = F.when(F.col("source").isin(EXPLICIT_SOURCES), "EXPLICIT_REASON").when(F.col("source").isin(INFERRING_SOURCES), "INFERENCE").otherwise("SPECULATION")
    about = F.coalesce(F.get("components", 0), F.lit("architecture"))
    reasons = events.where(F.coalesce("intent", F.lit("")) != "").select("event_id", about.alias("subject"), F.lit("was_changed_because").alias("predicate"), F.col("intent").alias("object"), why.alias("claim_kind"), F.lit("CURRENT").alias("state"), F.lit(None).cast(events.schema["ts"].dataType).alias("valid_until"))
    return facts.unionByName(reasons)


def resolve_claims(claims: DataFrame, exclusive: list[str]) -> DataFrame:
    """Claims (id, subject, predicate, object, source, reliability, confidence, valid_from, state) with identical ones as one and contradictions settled.

    Of identical claims (subject, predicate, object) the one of highest reliability, then confidence, then least id stays, with the earliest start and every source.
    Of an exclusive predicate's different objects the first in that order stays, the others are HISTORICAL until its start.
    """
    best = [F.desc("reliability"), F.desc("confidence"), F.asc("id")]
    same = Window.partitionBy("subject", "predicate", "object")
    one = claims.withColumns({"_r": F.row_number().over(same.orderBy(*best)), "_from": F.min("valid_from").over(same), "sources": F.array_sort(F.collect_set("source").over(same))})
    one = one.where("_r = 1").drop("_r", "valid_from").withColumnRenamed("_from", "valid_from")
    group = Window.partitionBy("subject", "predicate").orderBy(*best)
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lost = (F.row_number().over(group) > 1) & F.col("predicate").isin(exclusive)
    return one.withColumns({"_lost": lost, "_won": F.first("valid_from").over(whole)}).withColumns({"state": F.when(F.col("_lost"), "HISTORICAL").otherwise(F.col("state")), "valid_until": F.when(F.col("_lost"), F.col("_won"))}).drop("_lost", "_won")


def next_states(history: DataFrame, present: DataFrame, referenced: DataFrame, now: Column, grace_days: int = 7, promotion: int = 3, history_days: int = 180) -> DataFrame:
    """(component, state, next): the transition of each component of history (component, state, last_seen, events).

    Absent ones keep their state for the grace period; then current and experimental ones are DEPRECATED if anything refers to them, else REMOVED.
    Experimental ones that are present with enough events become CURRENT, as do deprecated ones that are present again; deprecated ones unseen for long are
    HISTORICAL. Other states don't change.
    """
    days = (F.unix_micros(now) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 86_400_000_000
    met = history.join(present.select("component", F.lit(True).alias("here")).distinct(), "component", "left").join(referenced.select("component", F.lit(True).alias("used")).distinct(), "component", "left")
    here, used = F.coalesce("here", F.lit(False)), F.coalesce("used", F.lit(False))
    waited = F.col("last_seen").isNull() | F.lit(grace_days <= 0) | (days >= grace_days)
    gone = F.when(used, "DEPRECATED").otherwise("REMOVED")
    young, old = F.col("state") == "EXPERIMENTAL", F.col("state") == "DEPRECATED"
    step = F.when(F.col("state").isin("CURRENT", "EXPERIMENTAL") & ~here & waited, gone).when(young & here & (F.col("events") >= promotion), "CURRENT").when(old & here, "CURRENT").when(old & (days > history_days), "HISTORICAL")
    return met.select("component", "state", F.coalesce(step, "state").alias("next"))


def freshness_by_source(age_hours: Column, source: Column, gone: Column, default: int = 180) -> Column:
    """0.5 ^ (age / half-life of the source); 0 for what is removed or expired, 1 for what is not yet valid."""
    half = F.lit(default)
    for name, days in HALF_LIVES.items():
        half = F.when(source == name, days).otherwise(half)
    return F.when(gone, 0.0).when(age_hours <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_hours / (24.0 * half)))


def query_memory(components: DataFrame, claims: DataFrame, events: DataFrame, timeline: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """(section, rank, key, score): the k best components (name, state), claims (id, text, confidence, freshness) and events (id, text, confidence) that match a term, and the newest k
    entries of the timeline (commit, kind, title, text, ts) that mention one. No terms, no rows."""
    from graphweft.functions.text import match_score

    if not terms or k <= 0:
        return components.select(F.lit("").alias("section"), F.lit(0).alias("rank"), F.col("name").alias("key"), F.lit(0.0).alias("score")).limit(0)
    weight = F.lit(0.5)
    for state, w in STATE_WEIGHTS.items():
        weight = F.when(F.col("state") == state, w).otherwise(weight)
    positive = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(default)
    scored = [
        ("component", components.select(F.col("name").alias("key"), (match_score(F.col("name"), terms) * weight).alias("score"))),
        ("claim", claims.select(F.col("id").alias("key"), (match_score(F.col("text"), terms) * positive("confidence", 0.5) * positive("freshness", 1.0)).alias("score"))),
        ("event", events.select(F.col("id").alias("key"), (match_score(F.col("text"), terms) * positive("confidence", 0.7)).alias("score"))),
    ]
    out = None
    for section, rows in scored:
        top = rows.where("score > 0").orderBy(F.desc("score"), "key").limit(k)  # k rows: one task ranks them
        top = top.select(F.lit(section).alias("section"), F.row_number().over(Window.orderBy(F.desc("score"), "key")).alias("rank"), F.col("key").cast("string").alias("key"), "score")
        out = top if out is None else out.unionByName(top)
    related = related_timeline(timeline, terms).limit(k)
    order = Window.orderBy(F.desc("ts"), F.desc("commit"), "kind", "title")
    return out.unionByName(related.select(F.lit("timeline").alias("section"), F.row_number().over(order).alias("rank"), F.concat_ws("/", "commit", "kind", "title").alias("key"), F.lit(1.0).alias("score")))


def related_timeline(timeline: DataFrame, terms: list[str]) -> DataFrame:
    """Entries whose text holds a term in any case, each commit, kind and title once, newest first."""
    low, hit = F.lower("text"), F.lit(False)
    for t in terms:
        if t:
            hit = hit | low.contains(t.lower())
    once = timeline.where(hit).groupBy("commit", "kind", "title").agg(F.min("ts").alias("ts"))
    return once.orderBy(F.desc("ts"), F.desc("commit"), "kind", "title")


def cluster_commits(commits: DataFrame, key: str, gap_hours: int = 24) -> DataFrame:
    """commits (key, id, ts, subject, files) with `cluster`: one that follows within the gap and shares a file or a significant word with the cluster so far joins it.

    A key's commits stream through one task in order, which holds the words and files of the cluster that is open.
    """
    import pyarrow as pa

    from graphweft.functions.text import significant

    ready = commits.select(key, "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), significant(F.coalesce("subject", F.lit(""))).alias("words"), F.transform(F.coalesce("files", F.array().cast("array<string>")), lambda f: F.lower(f)).alias("files"))
    types = dict(ready.dtypes)

    def batches(it):
        now, last, number, words, files = None, None, 0, set(), set()
        first = True
        for b in it:
            out = []
            for k, at, w, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                if first or k != now:
                    now, first, number, words, files, last = k, False, 0, set(), set(), None
                near = at == last if at is None or last is None else abs(at - last) <= gap_hours * 3_600_000_000
                if last is not None and near and (files & set(f) or words & set(w)):
                    words |= set(w)
                    files |= set(f)
                else:
                    number, words, files = number + 1, set(w), set(f)
                last = at
                out.append(number)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], [key, "id", "cluster"])

    return ready.repartition(key).sortWithinPartitions(key, "at", "id").mapInArrow(batches, f"`{key}` {types[key]}, id {types['id']}, cluster long")
