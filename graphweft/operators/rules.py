"""Declarative rules over nodes and edges: each is data, evaluated as one projection or a few joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions.paths import directory, has_folder, is_excluded, is_exported
from graphweft.operators.graphs import bfs, dealt, strong_components, weak_components
from graphweft.operators.relational import glob_regex
from graphweft.operators.vocabulary import CODE_UNITS, DEPENDENCY, DOMAIN_WORDS, EVENTS, INFRA_WORDS, OWN_RESOURCES, STRUCTURAL
from graphweft.runtime import settled


#: What is within reach of a node, by bit: primitives first, then flags.
PRIMITIVES = ["NETWORK_IO", "DISK_IO", "DATABASE", "CACHE", "DI_CONTAINER"]
FLAGS = ["security", "async", "context", "pubsub", "injection", "escape", "ffi", "constraint"]
BIT = {f: 1 << k for k, f in enumerate(PRIMITIVES + FLAGS)}
# Names, edge types and steps that set flags.
SECURITY_WORDS = ["auth", "jwt", "security", "validate"]
FLAG_EDGES = {
    "async": ["SPAWNS_CONCURRENT", "DISPATCHES_EVENT"], "pubsub": ["PUBLISHES_EVENT", "SUBSCRIBES_EVENT", "DISPATCHES_EVENT"], "injection": ["DI_INJECTS"], "context": ["1CFA_CALL"],
    "escape": ["ESCAPES_TO_HEAP", "HEAP_ALIAS"], "ffi": ["FFI_CALL"], "constraint": ["BRANCH_CONSTRAINT"],
}
STEPS = ["CALLS", "SPAWNS_CONCURRENT", "CFG_FLOW", "1CFA_CALL"]


@dataclass(frozen=True)
class NodeRule:
    """Fires where any of `words` is in the lower-cased name or any of `facts` within reach, and any of `needs` (if given) is within reach."""

    id: str
    name: str
    tier: str
    text: str
    words: tuple[str, ...] = ()
    facts: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()


# Ids, names, tiers, texts and conditions of the node rules.
NODE_RULES = [
    NodeRule("rule_01", "Web-to-Storage Traffic", "structural", "handles Web-to-Storage traffic", ("router", "api", "http"), ("NETWORK_IO",), ("DISK_IO", "DATABASE")),
    NodeRule("rule_02", "Security Gate Audit", "structural", "enforces Security Validation before Storage Persistence", (), ("security",), ("DISK_IO", "DATABASE")),
    NodeRule("rule_03", "Async Background Tasks", "structural", "executes Asynchronous Background Processing", (), ("async",)),
    NodeRule("rule_04", "External API Integrator", "structural", "communicates over Remote Network Protocols", (), ("NETWORK_IO",)),
    NodeRule("rule_05", "Repository Pattern", "heuristic", "implements the Repository Data Access Pattern", ("repository", "repo", "store"), (), ("DATABASE",)),
    NodeRule("rule_06", "Service Layer", "heuristic", "functions as a Business Logic Service", ("service", "usecase")),
    NodeRule("rule_07", "Controller / Handler Layer", "heuristic", "serves as an Inbound API Controller", ("controller", "handler", "endpoint")),
    NodeRule("rule_08", "Gateway Pattern", "heuristic", "acts as an Integration Gateway", ("gateway", "client")),
    NodeRule("rule_09", "Event Publisher / Producer", "heuristic", "publishes Domain Events to Queue/Broker", ("publisher", "producer", "emitter"), ("pubsub",)),
    NodeRule("rule_10", "Event Consumer / Subscriber", "heuristic", "consumes Asynchronous Message Queue Events", ("consumer", "subscriber", "listener")),
    NodeRule("rule_11", "CQRS Command Handler", "heuristic", "handles State Mutation Commands (CQRS)", ("command", "mutation")),
    NodeRule("rule_12", "CQRS Query Handler", "heuristic", "handles Read-Only Query Projections (CQRS)", ("query", "reader")),
    NodeRule("rule_13", "Cache Layer", "heuristic", "acts as an In-Memory Cache Tier", ("cache", "redis", "memcached")),
    NodeRule("rule_14", "Authentication / Authorization Middleware", "heuristic", "executes Identity Authentication/Authorization", ("auth", "jwt", "token")),
    NodeRule("rule_15", "Input Validation Gate", "heuristic", "validates and sanitizes incoming payload data", ("validator", "sanitizer")),
    NodeRule("rule_16", "Secret Manager Access", "heuristic", "interacts with Key/Secret Management Services", ("secret", "vault", "keyvault")),
    NodeRule("rule_17", "Metrics Emitter", "heuristic", "emits Telemetry Metrics", ("metric", "prometheus", "statsd")),
    NodeRule("rule_18", "Distributed Tracer", "heuristic", "participates in Distributed Tracing Spans", ("trace", "opentelemetry", "jaeger")),
    NodeRule("rule_19", "Structured Logger", "heuristic", "emits Structured Audit Logs", ("logger", "log")),
    NodeRule("rule_20", "Circuit Breaker / Resilience", "heuristic", "implements Resilience Fault-Tolerance Mechanisms", ("circuit", "retry", "fallback")),
    NodeRule("rule_21", "Cache-Aside Pattern", "structural", "implements the Cache-Aside Pattern", ("cache",), ("CACHE",), ("DATABASE",)),
    NodeRule("rule_22", "Saga Orchestrator", "heuristic", "acts as a Saga Orchestrator for Distributed Transactions", ("saga", "orchestrator")),
    NodeRule("rule_23", "Event-Driven Architecture (Pub/Sub)", "structural", "participates in Event-Driven Pub/Sub architecture", (), ("pubsub",)),
    NodeRule("rule_24", "Dependency Injection", "structural", "utilizes Dependency Injection", (), ("injection", "DI_CONTAINER")),
    NodeRule("rule_25", "Context Cancellation/Propagation", "structural", "handles Context Propagation (Timeouts/Cancellation)", (), ("context",)),
    NodeRule("rule_26", "Memory-Intensive / Escape Analysis", "structural", "performs Memory Allocations that Escape to the Heap", (), ("escape",)),
    NodeRule("rule_27", "FFI / CGO Bridge", "structural", "interfaces with Native/C code via FFI", (), ("ffi",)),
    NodeRule("rule_28", "Security / Bounds Checking", "structural", "enforces Branch Constraints for Security/Bounds Checking", (), ("constraint",)),
]


def reachable_facts(nodes: DataFrame, edges: DataFrame, hops: int = 5) -> DataFrame:
    """(id, facts): bits of the primitives and flags of a node and of all that it reaches in `hops` steps.

    Facts travel one step a round and are merged by or, so no pairs of nodes are made.
    """
    low = F.lower("name")
    primitives = F.transform(F.split(F.coalesce("primitive", F.lit("")), ","), lambda p: F.trim(p))
    own = F.lit(0).cast("long")
    for p in PRIMITIVES:
        own = own.bitwiseOR(F.when(F.array_contains(primitives, p), BIT[p]).otherwise(0).cast("long"))
    own = own.bitwiseOR(F.when(F.greatest(*[low.contains(w) for w in SECURITY_WORDS]), BIT["security"]).otherwise(0).cast("long"))
    flag = F.lit(0).cast("long")
    for f, types in FLAG_EDGES.items():
        flag = flag.bitwiseOR(F.when(F.col("type").isin(types), BIT[f]).otherwise(0).cast("long"))
    of_edges = edges.groupBy(F.col("source_id").alias("id")).agg(F.bit_or(flag).alias("e"))
    base = settled(nodes.select("id", own.alias("o")).join(dealt(of_edges), "id", "left").select("id", F.col("o").bitwiseOR(F.coalesce("e", F.lit(0).cast("long"))).alias("facts")), "facts")
    steps = settled(edges.where(F.col("type").isin(STEPS)).select("source_id", "target_id").distinct(), "steps")
    now = base
    for _ in range(hops):
        far = steps.join(dealt(now.select(F.col("id").alias("target_id"), "facts")), "target_id").groupBy(F.col("source_id").alias("id")).agg(F.bit_or("facts").alias("f"))
        now = base.join(dealt(far), "id", "left").select("id", F.col("facts").bitwiseOR(F.coalesce("f", F.lit(0).cast("long"))).alias("facts"))
    return now


def apply_node_rules(nodes: DataFrame, edges: DataFrame, rules: list[NodeRule] = NODE_RULES, kinds: tuple[str, ...] = ("MODULE", "FILE", "STRUCT", "CLASS", "FUNCTION"), mode: str = "all", disabled: tuple[str, ...] = (), facts: DataFrame | None = None) -> DataFrame:
    """(id, rule, message) of every rule that fires on a node of the kinds. Mode `structural` leaves heuristic rules out, `disabled` all; `facts` (id, facts) are those of the nodes, if already known."""
    low = F.lower("name")
    on = [r for r in rules if r.id not in disabled and mode != "disabled" and (mode != "structural" or r.tier != "heuristic")]

    def near(facts):
        return F.col("facts").bitwiseAND(F.lit(sum(BIT[f] for f in facts)).cast("long")) != 0

    def fires(r):
        hit = F.lit(False)
        for w in r.words:
            hit = hit | low.contains(w)
        hit = hit | near(r.facts) if r.facts else hit
        return hit & near(r.needs) if r.needs else hit

    own = nodes.where(F.col("kind").isin(*kinds)).join(dealt(reachable_facts(nodes, edges) if facts is None else facts), "id")
    if not on:
        return own.select("id", F.lit("").alias("rule"), F.lit("").alias("message")).limit(0)
    fired = F.array_compact(F.array(*[F.when(fires(r), F.struct(F.lit(r.id).alias("rule"), F.format_string(f"Component %s {r.text} [{r.tier}]", "name").alias("message"))) for r in on]))
    return own.select("id", F.explode(fired).alias("x")).select("id", "x.rule", "x.message")


@dataclass(frozen=True)
class LintRule:
    """One rule of a ruleset; see `load_rules` for the file form."""

    id: str
    source: str = ""
    severity: str = "ERROR"
    deny: tuple[str, ...] = ()
    allow_only: tuple[str, ...] = ()
    require_layer: str = ""
    prevent_cycles: bool = False
    max_fan_out: int = 0
    scope: str = "**"
    name: str = ""


def load_rules(text: str) -> tuple[list[LintRule], list[str]]:
    """Rules and excluded globs of a ruleset in YAML (the plain subset of lists and scalars that rulesets are written in).

    A rule without severity is an ERROR, one without id is `rule-N`, one without name is named like its id.
    """
    top: dict = {}
    rules: list[dict] = []
    now, block, depth = top, None, 0  # the mapping that lines belong to; the list that `- ` lines belong to and its key's indent

    def value(x: str):
        x = x.strip()
        if x.startswith("[") and x.endswith("]"):
            return [value(y) for y in x[1:-1].split(",") if y.strip()]
        if x[:1] in ("'", '"') and x[-1:] == x[:1]:
            return x[1:-1]
        return {"true": True, "false": False}.get(x, int(x) if x.isdigit() else x)

    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        body = line.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(line) - len(body)
        if body.startswith("- "):
            if block is not None and block is not rules and indent >= depth:
                block.append(value(body[2:]))
                continue
            now, body, indent = {}, body[2:], indent + 2
            rules.append(now)
        elif indent == 0:
            now = top
        key, _, rest = body.partition(":")
        block, depth = None, indent
        if rest.strip():
            now[key.strip()] = value(rest)
        else:
            block = rules if now is top and key.strip() == "rules" else []
            now[key.strip()] = block
    out = []
    for k, r in enumerate(rules):
        own = r.get("id") or f"rule-{k + 1}"
        out.append(LintRule(own, r.get("from", ""), r.get("severity") or "ERROR", tuple(r.get("deny_imports", ())), tuple(r.get("allow_only", ())), r.get("require_layer", ""), bool(r.get("prevent_cycles")), int(r.get("max_fan_out") or 0), r.get("scope") or "**", r.get("name") or own))
    return out, list(top.get("exclude") or [])


def _any_glob(path, globs) -> Column:
    return path.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def _between_files(nodes: DataFrame, edges: DataFrame, exclude) -> DataFrame:
    """Dependency edges between different files that aren't excluded, with both paths (sp, tp)."""
    n = nodes.select("id", "path").where(~_any_glob(F.col("path"), exclude) & (F.col("path") != ""))
    met = edges.where(F.col("type").isin(DEPENDENCY)).select("source_id", "target_id", "type")
    return met.join(n.select(F.col("id").alias("source_id"), F.col("path").alias("sp")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("path").alias("tp")), "target_id").where("sp <> tp")


def package_cycles(nodes: DataFrame, edges: DataFrame, scope: str = "**", exclude: list[str] = ()) -> DataFrame:
    """(component, length, path) of packages (folders) within the scope that depend on each other in a circle: one closed path for each strong component, as `cycle_paths` tells it."""
    from graphweft.operators.graphs import cycle_paths

    met = _between_files(nodes, edges, exclude).select(directory(F.col("sp")).alias("source_id"), directory(F.col("tp")).alias("target_id")).where("source_id <> target_id")
    inside = settled(met.where(F.col("source_id").rlike(glob_regex(scope)) & F.col("target_id").rlike(glob_regex(scope))).distinct(), "packages")
    return cycle_paths(inside.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), inside)


def lint(nodes: DataFrame, edges: DataFrame, rules: list[LintRule], exclude: list[str] = ()) -> DataFrame:
    """(rule, severity, source_path, source_id, target_path, target_id): violations.

    Dependency edges between files: denied targets, targets outside an allow list (but for the same folder), callers of `source` from outside the
    layer that it requires. Packages (folders): those on a cycle within the scope, each with the least other package of its cycle, and
    those with too many distinct targets.
    """
    met = settled(_between_files(nodes, edges, exclude), "lint")
    same = directory(F.col("sp")) == directory(F.col("tp"))
    out = None
    for r in rules:
        parts = []
        own = met.where(F.col("sp").rlike(glob_regex(r.source))) if r.source else met.limit(0)
        if r.deny:
            parts.append(own.where(_any_glob(F.col("tp"), r.deny)))
        if r.allow_only:
            parts.append(own.where(~_any_glob(F.col("tp"), r.allow_only) & ~same))
        if r.require_layer and r.source:
            parts.append(met.where(F.col("tp").rlike(glob_regex(r.source)) & ~F.col("sp").rlike(glob_regex(r.require_layer)) & ~same))
        parts = [p.select(F.col("sp").alias("source_path"), "source_id", F.col("tp").alias("target_path"), "target_id") for p in parts]
        none = F.lit(None).cast("string")
        packages = met.select(directory(F.col("sp")).alias("s"), directory(F.col("tp")).alias("t")).where("s <> t").distinct()
        if r.prevent_cycles:
            inside = settled(packages.where(F.col("s").rlike(glob_regex(r.scope)) & F.col("t").rlike(glob_regex(r.scope))), "packages")
            comp = strong_components(inside.select(F.explode(F.array("s", "t")).alias("id")).distinct(), inside.select(F.col("s").alias("source_id"), F.col("t").alias("target_id")))
            comp = settled(comp, "cycles")
            two = comp.groupBy("component").agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
            other = F.when(F.col("ids")[0] == F.col("id"), F.col("ids")[1]).otherwise(F.col("ids")[0])
            parts.append(comp.join(two, "component").select(F.col("id").alias("source_path"), none.alias("source_id"), other.alias("target_path"), none.alias("target_id")))
        if r.max_fan_out:
            many = packages.where(F.col("s").rlike(glob_regex(r.scope))).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > r.max_fan_out)
            parts.append(many.select(F.col("s").alias("source_path"), none.alias("source_id"), none.alias("target_path"), none.alias("target_id")))
        for p in parts:
            p = p.select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "source_path", "source_id", "target_path", "target_id")
            out = p if out is None else out.unionByName(p)
    return out


def drift(layered: DataFrame, order: dict[str, int], forbidden: list[tuple[str, str]], every: bool = False) -> DataFrame:
    """(kind, source_id, target_id) of edges that are forbidden between layers or lead to an upper one; layered has both ends' layers. With `every`, each edge and its layers."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    pair = F.concat_ws(">", "source_layer", "target_layer")
    bad = pair.isin([f"{a}>{b}" for a, b in forbidden])
    up = F.try_element_at(rank, F.col("source_layer")) > F.try_element_at(rank, F.col("target_layer"))
    got = layered.where("source_layer <> target_layer").withColumn("kind", F.when(bad, "forbidden").when(up, "upward")).where("kind is not null")
    return got if every else got.select("kind", "source_id", "target_id").distinct()


def component_coupling(nodes: DataFrame, edges: DataFrame, component: Column) -> DataFrame:
    """component, ca, ce (distinct other components that depend on it, that it depends on), instability, weight (its nodes)."""
    member = settled(nodes.select("id", component.alias("component")), "members")
    ends = edges.where(F.col("type").isin(STRUCTURAL)).select("source_id", "target_id")
    ends = ends.join(member.select(F.col("id").alias("source_id"), F.col("component").alias("s")), "source_id").join(member.select(F.col("id").alias("target_id"), F.col("component").alias("t")), "target_id")
    pairs = ends.where("s <> t").select("s", "t").distinct()
    weight = member.groupBy("component").agg(F.count("*").alias("weight"))
    ca, ce = pairs.groupBy(F.col("t").alias("component")).agg(F.count("*").alias("ca")), pairs.groupBy(F.col("s").alias("component")).agg(F.count("*").alias("ce"))
    got = weight.join(ca, "component", "left").join(ce, "component", "left").na.fill(0, ["ca", "ce"])
    both = F.col("ca") + F.col("ce")
    return got.select("component", "ca", "ce", F.when(both > 0, F.col("ce") / both).otherwise(0.0).alias("instability"), "weight")


def god_types(nodes: DataFrame, edges: DataFrame, fan_in: int = 15, methods: int = 30) -> DataFrame:
    """(id, fan_in, methods) of structs and classes over both bounds; fan-in counts distinct structural sources, methods are functions that it contains or receives."""
    own = nodes.where("kind in ('STRUCT', 'CLASS')").select("id")
    fan = edges.where(F.col("type").isin(STRUCTURAL)).select("source_id", "target_id").distinct().groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("fan_in")).where(F.col("fan_in") > fan_in)
    held = edges.where("type in ('HAS_RECEIVER', 'CONTAINS')").join(nodes.where("kind = 'FUNCTION'").select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return own.join(fan, "id").join(held.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("methods")).where(F.col("methods") > methods), "id")


def smells(nodes: DataFrame, edges: DataFrame, component: Column, roots: DataFrame, layered: DataFrame | None = None, order: dict[str, int] | None = None, forbidden: list[tuple[str, str]] = (), fan_in: int = 15, methods: int = 30, small: int = 3, large: int = 5, share: float = 40.0, unstable: float = 0.8) -> DataFrame:
    """(smell, subject, severity, affected): SD-01 god objects, SD-02 cycles, SD-03 dead code, SD-04 layer violations (with `layered`, edges with both ends'
    layers), SD-05 god packages, SD-06 tight coupling, SD-07 unstable abstractions. `affected` counts ids; a cycle's subject is its least id."""
    structural = edges.where(F.col("type").isin(STRUCTURAL))
    row = lambda smell, subject, severity, n: (F.lit(smell).alias("smell"), subject.alias("subject"), severity.alias("severity"), n.cast("long").alias("affected"))
    out = god_types(nodes, edges, fan_in, methods).select(*row("SD-01", F.col("id"), F.lit("HIGH"), F.lit(1)))
    cycles = settled(strong_components(nodes, structural), "cycles").groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    graded = F.when(F.col("n") > large, "HIGH").when(F.col("n") <= small, "LOW").otherwise("MEDIUM")
    out = out.unionByName(cycles.select(*row("SD-02", F.col("component"), graded, F.col("n"))))
    dead = dead_code(nodes, edges, roots).agg(F.count("*").alias("n")).where("n > 0")
    out = out.unionByName(dead.select(*row("SD-03", F.lit("dead code"), F.lit("LOW"), F.col("n"))))
    if layered is not None:
        bad = drift(layered.where(F.col("type").isin(STRUCTURAL)), order, forbidden, every=True)
        pairs = bad.groupBy(F.concat_ws(" depends on ", "source_layer", "target_layer").alias("pair")).agg(F.count("*").alias("n"))
        out = out.unionByName(pairs.select(*row("SD-04", F.col("pair"), F.lit("MEDIUM"), F.col("n"))))
    total = nodes.agg(F.count("*").alias("total"))
    coupling = settled(component_coupling(nodes, edges, component).join(F.broadcast(total)), "coupling")  # one row of totals
    god = coupling.where((F.col("weight") / F.col("total") * 100 >= share) & (F.col("ca") >= 3))
    out = out.unionByName(god.select(*row("SD-05", F.col("component"), F.lit("HIGH"), F.lit(1))))
    out = out.unionByName(coupling.where("ca >= 5 and ce >= 5").select(*row("SD-06", F.col("component"), F.lit("MEDIUM"), F.lit(1))))
    return out.unionByName(coupling.where((F.col("ce") >= 3) & (F.col("instability") >= unstable)).select(*row("SD-07", F.col("component"), F.lit("LOW"), F.lit(1))))


def dead_code(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Code units (id, kind) that no root reaches over structural edges: neither in excluded paths nor exported without any inbound edge. None without a root in the graph."""
    known = roots.select("id").join(nodes.select("id"), "id", "left_semi")
    live = bfs(edges.where(F.col("type").isin(STRUCTURAL)), known)
    units = nodes.where(F.col("kind").isin(CODE_UNITS) & ~is_excluded(F.col("path")))
    surface = nodes.where(is_exported(F.col("name"))).join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").select("id")
    some = known.agg((F.count("*") > 0).alias("some"))
    dead = units.join(live.select("id"), "id", "left_anti").join(surface, "id", "left_anti").select("id", "kind")
    return dead.join(F.broadcast(some.where("some"))).select("id", "kind")  # one row or none


def patterns(nodes: DataFrame, edges: DataFrame, component: Column, event_share: float = 15.0) -> DataFrame:
    """(pattern, confidence) of PR-02 to PR-07: clean architecture, independent services, bounded contexts, command and query types, events, repositories."""
    spark = nodes.sparkSession
    structural = edges.where(F.col("type").isin(STRUCTURAL))
    bucket = F.when(has_folder(F.col("path"), DOMAIN_WORDS), "domain").when(has_folder(F.col("path"), INFRA_WORDS), "infra")
    buckets = settled(nodes.select("id", bucket.alias("bucket")).where("bucket is not null"), "buckets")
    sizes = {r["bucket"]: r["count"] for r in buckets.groupBy("bucket").count().collect()}  # two rows
    ends = structural.join(buckets.select(F.col("id").alias("source_id"), F.col("bucket").alias("s")), "source_id").join(buckets.select(F.col("id").alias("target_id"), F.col("bucket").alias("t")), "target_id")
    ways = {(r["s"], r["t"]): r["count"] for r in ends.groupBy("s", "t").count().collect()}  # four rows
    found = []
    if min(sizes.get("domain", 0), sizes.get("infra", 0)) >= 3 and not ways.get(("domain", "infra")) and ways.get(("infra", "domain")):
        found.append(("PR-02", 0.85))
    member = settled(nodes.select("id", component.alias("component")), "members")
    linked = structural.join(member.select(F.col("id").alias("source_id"), F.col("component").alias("s")), "source_id").join(member.select(F.col("id").alias("target_id"), F.col("component").alias("t")), "target_id").where("s <> t").select("s", "t").distinct()
    linked = settled(linked, "linked")
    owners = settled(edges.where(F.col("type").isin(OWN_RESOURCES)).select(F.col("source_id").alias("id")).join(member, "id").select("component").distinct(), "owners")
    services = owners.count()
    if services >= 2 and linked.join(owners.withColumnRenamed("component", "s"), "s", "left_semi").join(owners.withColumnRenamed("component", "t"), "t", "left_semi").isEmpty():
        found.append(("PR-03", 0.8))
    components = member.select(F.col("component").alias("id")).distinct()
    if components.count() >= 3 and weak_components(components, linked.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"))).select("component").distinct().count() >= 2:
        found.append(("PR-04", 0.8))
    name, folder = F.col("name"), directory(F.col("path"))
    role = F.when(name.endswith("Command"), "command").when(name.endswith("CommandHandler"), "handler").when(name.endswith("Query"), "query").when(name.endswith("QueryHandler"), "handler")
    roles = settled(nodes.select(role.alias("role"), folder.alias("folder")).where("role is not null"), "roles")
    n = {r["role"]: r["count"] for r in roles.groupBy("role").count().collect()}  # three rows
    meet = roles.where("role = 'command'").join(roles.where("role = 'query'"), "folder", "left_semi")
    if n.get("command", 0) >= 2 and n.get("query", 0) >= 2 and n.get("handler", 0) >= 1 and not meet.isEmpty():
        found.append(("PR-05", 0.8))
    events, total = edges.agg(F.count_if(F.col("type").isin(EVENTS)), F.count_if(F.col("type").isin(STRUCTURAL))).first()
    if total and events >= 5 and events / total * 100 >= event_share:
        found.append(("PR-06", min(0.95, 0.6 + 0.35 * events / total)))
    stores = nodes.where("kind in ('STRUCT', 'CLASS')").where(F.col("name").endswith("Repository") | F.col("name").endswith("Repo")).select(F.col("id").alias("source_id"))
    if not stores.isEmpty():
        used = edges.join(stores, "source_id", "left_semi")
        data = nodes.where("primitive = 'DATABASE'").select(F.col("id").alias("target_id"))
        direct = not used.where("type = 'QUERIES_DB'").isEmpty() or not used.where("type = 'DEPENDS_ON'").join(data, "target_id", "left_semi").isEmpty()
        found.append(("PR-07", 0.9 if direct else 0.7))
    return spark.createDataFrame(found, "pattern string, confidence double")


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, k): nodes of each kind, names of external dependencies, names of nodes with outgoing edges alone."""
    kinds = nodes.groupBy("kind").agg(F.count("*").alias("k")).select(F.lit("kind").alias("part"), F.col("kind").alias("key"), "k")
    external = nodes.where("primitive in ('EXTERNAL', 'NETWORK_IO')").select(F.lit("external").alias("part"), F.col("name").alias("key"), F.lit(1).cast("long").alias("k"))
    out = nodes.join(edges.select(F.col("target_id").alias("id")), "id", "left_anti").join(edges.select(F.col("source_id").alias("id")), "id", "left_semi")
    return kinds.unionByName(external).unionByName(out.select(F.lit("entry").alias("part"), F.col("name").alias("key"), F.lit(1).cast("long").alias("k")))


def graph_rules(nodes: DataFrame, edges: DataFrame, blast: int = 50, core: float = 5.0, hub: float = 100.0) -> DataFrame:
    """(rule, id) of the rules over the whole graph: 29 unreachable, 30 on a cycle, 31 cut vertex, 32 more than `blast` dependents, 33 PageRank over core / n, 34 on an island without
    entry points, 35 god object, 36 betweenness over `hub`, 37 package of low cohesion. nodes have `entrypoint`."""
    from graphweft.operators.graphs import betweenness, islands, pagerank, reaching_more
    from graphweft.operators.relational import cohesion, god_objects, orphans
    from graphweft.operators.structure import articulation_points

    nodes, edges = settled(nodes, "nodes"), settled(edges, "edges")
    big = nodes.where("kind in ('MODULE', 'FILE', 'STRUCT', 'CLASS', 'PACKAGE')").select("id")
    row = lambda n, df: df.join(nodes.select("id"), "id", "left_semi").select(F.lit(f"rule_{n}").alias("rule"), "id")
    only = lambda df: df.join(big, "id", "left_semi")
    dead = orphans(nodes, edges, nodes.where("entrypoint")).where("kind in ('MODULE', 'FILE', 'STRUCT', 'CLASS', 'FUNCTION')")
    comp = settled(strong_components(nodes, edges), "strong")
    cyclic = comp.join(comp.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi")
    weak = settled(weak_components(nodes, edges), "weak")
    lone = weak.join(islands(nodes, edges).select("component"), "component", "left_semi")
    n = nodes.count()
    packages = nodes.where("kind in ('MODULE', 'PACKAGE')").select("id")
    loose = cohesion(nodes, edges, packages).where("cohesion > 0 and cohesion < 1").select(F.col("package").alias("id"))
    parts = [
        (29, dead), (30, only(cyclic)), (31, only(articulation_points(nodes, edges))), (32, only(reaching_more(edges, big, blast))), (33, only(pagerank(nodes, edges, 20).where(F.col("rank") > core / max(1, n)))),
        (34, lone), (35, god_objects(nodes, edges)), (36, only(betweenness(nodes, edges).where(F.col("betweenness") > hub))), (37, loose),
    ]
    out = None
    for k, df in parts:
        out = row(k, df) if out is None else out.unionByName(row(k, df))
    return out
