"""Fixed values of the graph model: edge types by meaning, path and id markers, language and type names."""

from __future__ import annotations

# They must equal those that graphs are written with.
STRUCTURAL = ["DEPENDS_ON", "CALLS", "IMPLEMENTS", "EXTENDS", "CONTAINS", "COMPOSES", "REFERENCES", "NETWORK_RPC_CALL", "QUERIES_DB", "CALLS_CLOUD_API", "PUBLISHES_EVENT", "SUBSCRIBES_EVENT", "SENDS_MSG", "RECEIVES_MSG", "DISPATCHES_EVENT"]
DEPENDENCY = ["DEPENDS_ON", "CALLS", "1CFA_CALL", "IMPLEMENTS", "EXTENDS", "COMPOSES", "REFERENCES", "QUERIES_DB", "SENDS_MSG", "INSTANTIATES_GENERIC"]
BRANCHES = ["CFG_IF", "CFG_LOOP", "CFG_SWITCH"]
EVENTS = ["PUBLISHES_EVENT", "SUBSCRIBES_EVENT", "DISPATCHES_EVENT", "SENDS_MSG", "RECEIVES_MSG"]
OWN_RESOURCES = ["QUERIES_DB", "EXPOSES_ENDPOINT"]
TYPE_LIKE = ["STRUCT", "CLASS", "MODULE", "FILE"]
CODE_UNITS = ["FUNCTION", "METHOD", "STRUCT", "CLASS", "INTERFACE", "MODULE"]
TEST_SUFFIXES = ["_test.go", ".test.ts", ".test.js", ".spec.ts", "_spec.rb", "test.java"]
TEST_PREFIX = "test_"
EXCLUDED_MARKERS = ["/mock", "mock/", "mocks/", "/generated", "generated/"]
DOMAIN_WORDS = ["domain", "core", "entities", "usecases", "use-cases"]
INFRA_WORDS = ["infra", "infrastructure", "repository", "repositories", "db", "database", "persistence"]
VIRTUAL_PREFIXES = ["VIRTUAL_", "thread_or_coroutine", "TAINT:", "QUEUE::", "topic::", "event:", "endpoint:", "sink:", "resource:", "global:", "memory::", "alloc::", "ext:", "DATABASE::", "CLOUD_API::"]
EVIDENCE_PROPERTIES = ["role", "macro_rules", "pagerank", "blast_radius", "instability", "doc", "signature", "package", "purpose"]
IGNORED_SEGMENTS = [".git", "node_modules", "vendor", "dist", "build", "target"]
ROOT_FOLDERS = [
    "cmd", "internal", "tests", "pkg", "main", "main.go", "tools", "scripts", "vendor", "external", "build", "testdata", "docs", "assets", "config", "deploy", "migrations", "examples", "hack",
    "src", "lib", "app", "api", "web", "server", "client", "core", "bin", "data",
]
PREDICATE_GROUPS = {
    "call_graph": ["CALLS", "SPAWNS_CONCURRENT", "DISPATCHES_EVENT", "1CFA_CALL", "FFI_CALL"],
    "type_hierarchy": ["EXTENDS", "IMPLEMENTS", "MIXES"],
    "composition": ["COMPOSES", "HAS_FIELD", "CONTAINS"],
    "data_flow": ["DATA_FLOW", "POINTS_TO", "HEAP_ALIAS", "ALIASES", "VULNERABLE_TAINT"],
    "control_flow": ["CFG_FLOW", "CFG_IF", "CFG_LOOP", "CFG_CATCHES", "CFG_DEFERS", "BRANCH_CONSTRAINT"],
    "structural": ["BELONGS_TO", "DEPENDS_ON", "REFERENCES"],
    "messaging": ["SENDS_MSG", "RECEIVES_MSG", "PUBLISHES_EVENT", "SUBSCRIBES_EVENT", "DISPATCHES_EVENT"],
    "infrastructure": ["NETWORK_RPC_CALL", "QUERIES_DB", "CALLS_CLOUD_API", "CONSUMES_RESOURCE", "MUTATES_GLOBAL", "SECURITY_SINK", "EXPOSES_ENDPOINT"],
    "security": ["VULNERABLE_TAINT", "SECURITY_SINK", "CONSUMES_RESOURCE"],
    "binding": ["INSTANTIATES_GENERIC", "DI_INJECTS", "ESCAPES_TO_HEAP", "ALIASES_TYPE"],
}
