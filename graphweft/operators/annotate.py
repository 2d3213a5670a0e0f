"""Behaviour of code from its text: primitives, and what follows from a node's primitives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Primitives and the words that show them, in the order in which they are listed.
PRIMITIVES = {
    "DISK_IO": ["os.writefile", "os.readfile", "ioutil", "fstream", "open(", "writefile", "readfile", "filewriter", "filereader", "file.open", "os.create", "bufio", "stderr", "stdout", "fs.", "file.", "appendalltext", "fopen", "fwrite", "fread", "std::fs", "file.write", "file_put_contents", "filepath"],
    "NETWORK_IO": ["http.get", "http.post", "http.put", "http.delete", "http.patch", "fetch(", "axios", "socket", "net.dial", "curl", "urlconnection", "httpclient", "express()", "router.", "httprequest", "webclient", "requests.", "http:", "https:", "urllib", "httpx", "reqwest", "spring-web", "fastapi", "ktor"],
    "DATABASE_SQL": ["db.query", "db.exec", "db.queryrow", "sql.open", "executereader", "select ", "insert into", "insert ", "update ", "delete from", "gorm", "prisma", "sqlalchemy", "repository", "sqlite3", "pg.", "postgres", "mysql", "oracle", "mssql", "efcore", "dapper", "diesel", "active_record", "pdo"],
    "DATABASE_NOSQL": ["mongoclient", "cassandra", "dynamodb", "neo4j", "firestore", "couchbase", "rethinkdb", "collection.find", "bson", "key-value", "documentstore"],
    "CACHE": ["redis", "memcached", "hazelcast", "guava", "lru-cache", "lru.", "cache.get", "cache.set", "valkey", "dragonfly", "inmemorycache", "ristretto"],
    "MESSAGE_QUEUE": ["kafka", "rabbitmq", "nats.", "nats:", "sqs", "sns", "eventhub", "amqp", "celery", "sidekiq", "pubsub", "messagebroker", "consumer.subscribe", "producer.send"],
    "CLOUD_SDK": ["aws-sdk", "boto3", "azure-sdk", "google-cloud", "s3.", "blobstorage", "gcs.", "aws_s3", "cloudformation", "google.cloud"],
    "CONTAINER_DEVOPS": ["docker", "k8s.io", "kubernetes", "helm", "terraform", "vault", "consul", "containerd", "kubeclient"],
    "CONCURRENCY": ["go func", "goroutine", "thread", "async", "await", "promise", "task.run", "executor", "spawn", "fork", "tokio::spawn", "pthreads", "rayon"],
    "SYNCHRONIZATION": ["sync.waitgroup", "sync.mutex", "sync.rwmutex", "atomic.", "chan ", "channel", "lock()", "unlock()", "semaphore", "reentrantlock", "conditionvariable"],
    "ALLOCATION": ["make([]", "malloc", "calloc", "bytebuffer.allocate", "sync.pool", "mempool", "allocator", "arena"],
    "COMPUTE_MATH": ["numpy", "pytorch", "tensorflow", "linalg", "simd", "cuda", "opencl", "matrix", "tensor", "ndarray", "onnx", "tensorrt"],
    "SECURITY_AUTH": ["jwt.", "oauth", "oauth2", "passport.", "spring-security", "saml", "oidc", "authenticate", "authorize", "tokenvalidation"],
    "CRYPTO": ["bcrypt", "argon2", "aes.", "rsa.", "tls.config", "crypto/sha256", "sha256", "cipher", "hmac", "secp256k1", "x509"],
    "LOGGING": ["zap.logger", "logrus", "winston", "logback", "slf4j", "log4j", "zerolog", "tracing::info", "logger.info", "log.printf"],
    "TELEMETRY": ["opentelemetry", "prometheus", "datadog", "newrelic", "statsd", "jaeger", "zipkin", "otel.", "metrics.counter", "tracer.start"],
    "AI_LLM": ["openai", "anthropic", "langchain", "pinecone", "qdrant", "weaviate", "ollama", "huggingface", "chromadb", "llm", "embedding"],
    "IPC": ["shm_open", "named_pipe", "unix_socket", "zeromq", "dbus", "ipc.", "mmap", "sharedmemory"],
    "RPC": ["grpc", "protobuf", "thrift", "json-rpc", "trpc", "proto."],
    "UI_EVENT": ["onclick", "addeventlistener", "electron", "flutter", "swiftui", "qt.", "react-native", "componentdidmount"],
}
# Points of risk, names that tell of personal data.
RISK = {30: ["CRYPTO", "SECURITY_AUTH"], 20: ["DATABASE_SQL", "DATABASE_NOSQL", "NETWORK_IO", "RPC", "IPC", "DISK_IO"], 15: ["CONTAINER_DEVOPS", "CLOUD_SDK", "MESSAGE_QUEUE"], 10: ["CONCURRENCY", "SYNCHRONIZATION", "ALLOCATION", "COMPUTE_MATH"]}
OTHER_RISK = 5
PERSONAL = ["password", "ssn", "credit_card", "token"]
#: What goes before words are looked for: strings, comments to the line's end with that end, block comments. A hash after a word
#: character, `.`, `$` or `:`, or before a hex digit, stays, as does what is in the group.
NOT_CODE = r"""([a-zA-Z0-9_.$:]#|#[0-9a-fA-F]#?)|//[^\n]*(?:\n|\z)|#[^\n]*(?:\n|\z)|/\*(?s:.*?)(?:\*/|\z)|"[^"]*(?:"|\z)|'[^']*(?:'|\z)|`[^`]*(?:`|\z)"""


def bare_code(text: Column) -> Column:
    return F.regexp_replace(text, NOT_CODE, "$1")


def primitives_of(text: Column, name: Column) -> Column:
    """The primitives that a text (less comments and strings) or name shows, in their order. Plain searches for one word each: a pattern of all tries each at every place."""
    low = F.lower(F.concat_ws(" ", bare_code(text), name))
    return F.get(F.transform(F.array(low), lambda t: F.array_compact(F.array(*[F.when(_any(t, words), p) for p, words in PRIMITIVES.items()]))), 0)


def annotate(df: DataFrame, primitives: str = "primitives", name: str = "name", parts: str | None = None, text: str = "text") -> DataFrame:
    """df with risk, level, tier, violations (array), personal (data in logs or on the net), hot_path, resilience and blind_spot, from an array of primitives.

    `parts` is an array of the names of a node's children, which count for personal data as its own name does. A text that recovers is hardened.
    """
    p = F.col(primitives)
    has = lambda *xs: F.arrays_overlap(p, F.array(*map(F.lit, xs)))
    score = risk_score(p)
    low = F.lower(F.concat_ws(" ", F.col(name), F.col(parts)) if parts else F.col(name))
    personal = F.lit(False)
    for w in PERSONAL:
        personal = personal | low.contains(w)
    data = has("DATABASE_SQL", "DATABASE_NOSQL")
    tier = F.when(data, "DataLayer").when(has("NETWORK_IO", "UI_EVENT", "RPC"), "InterfaceLayer").when(has("CACHE", "MESSAGE_QUEUE", "CONTAINER_DEVOPS", "CLOUD_SDK"), "InfrastructureLayer").otherwise("DomainLayer")
    bad = F.array_compact(F.array(
        F.when(has("UI_EVENT") & data, "Anti-Pattern: UI-to-DB Direct Access"), F.when(has("DISK_IO") & has("NETWORK_IO"), "Anti-Pattern: High I/O Coupling"), F.when(has("CRYPTO") & ~has("SECURITY_AUTH"), "Anti-Pattern: Crypto without Auth"),
    ))
    return df.withColumns({
        "risk": score, "level": risk_level(score), "tier": tier, "violations": bad,
        "personal": has("LOGGING", "NETWORK_IO") & ~has("CRYPTO") & personal, "hot_path": has("COMPUTE_MATH") & has("ALLOCATION"),
        "resilience": F.when(has("NETWORK_IO", "RPC"), F.when(F.col(text).contains("recover("), "Hardened").otherwise("Fragile")),
        "blind_spot": has("NETWORK_IO", "IPC") & ~has("TELEMETRY", "LOGGING"),
    })


def risk_score(primitives: Column) -> Column:
    """Sum of the points of an array of primitives."""
    return F.aggregate(F.transform(primitives, _points), F.lit(0), lambda a, x: a + x)


def risk_level(score: Column) -> Column:
    return F.when(score >= 60, "CRITICAL").when(score >= 40, "HIGH").when(score >= 20, "MEDIUM").otherwise("LOW")


def _points(x: Column) -> Column:
    out = F.lit(OTHER_RISK)
    for points, names in RISK.items():
        out = F.when(x.isin(names), points).otherwise(out)
    return out


def archetype(kind: Column, name: Column, primitive: Column, entry: Column, god: Column, hotspot: Column) -> Column:
    """The role of a node: god object and hotspot first, then by what it is, then by its name; a service if nothing tells."""
    low, part = F.lower(name), lambda *xs: _any(primitive, xs)
    named = name.endswith("Command") | name.endswith("Cmd") | name.isin("main", "Execute", "ExecuteContext")
    return (
        F.when(god, "GOD_OBJECT").when(hotspot, "HOTSPOT").when((kind == "USER") | entry | named, "ENTRYPOINT").when(kind.isin("DATABASE", "VIRTUAL_DATABASE") | part("DATABASE", "CACHE", "STORE"), "DATASTORE")
        .when(part("MESSAGE_QUEUE", "EVENT_BUS", "CHANNEL"), "EVENT_BUS").when(kind.isin("EXTERNAL", "EXTERNAL_API", "EXTERNAL_SDK", "EXTERNAL_FFI"), "EXTERNAL_API").when(kind == "INTERFACE", "INTERFACE")
        .when(kind.isin("STRUCT", "CLASS", "TYPE_DECL"), "MODEL").when(_any(low, ["parse", "ingest", "normaliz"]), "PARSER").when(_any(low, ["render", "format", "project"]), "RENDERER")
        .when(_any(low, ["route", "gateway", "dispatch", "filter"]), "GATEWAY").otherwise("SERVICE")
    )


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def entry_kind(name: Column, kind: Column, primitive: Column) -> Column:
    """`main` for functions of that name or init, `handler` for what faces the net, else null."""
    main = F.lower(name).isin("main", "init")
    return F.when(main, F.when((kind == "") | F.lower(kind).isin("function", "func"), "main")).when(primitive.isin("NETWORK_IO", "EXPOSES_ENDPOINT", "ROUTER", "RPC_HANDLER"), "handler")


def zones(files: DataFrame) -> DataFrame:
    """(folder, zone) from files (path, primitives): counts of all that lies below a folder; crypto makes it a security zone, else a database a database zone,
    else the most frequent primitive, least by name on ties. Each file counts for every folder above it, so no tree is walked."""
    from graphweft.functions.paths import directory

    parts = F.split(directory(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    n = files.select(F.explode(above).alias("folder"), "primitives").select("folder", F.explode("primitives").alias("p")).groupBy("folder", "p").agg(F.count("*").alias("n"))
    got = n.groupBy("folder").agg(F.max(F.col("p").isin("CRYPTO_OPS", "CRYPTO")).alias("c"), F.max(F.col("p").isin("DATABASE_SQL", "DATABASE_NOSQL")).alias("d"), F.min_by("p", F.struct(-F.col("n"), F.col("p"))).alias("top"))
    return got.select("folder", F.when(F.col("c"), "SECURITY_ZONE").when(F.col("d"), "DATABASE_ZONE").otherwise(F.concat("top", F.lit("_ZONE"))).alias("zone"))


def line_context(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Of asked (path, line), the innermost node (path, id, line_start, line_end) that holds the line: the one that starts last, least id on ties."""
    met = asked.join(nodes.select("path", "id", "line_start", "line_end"), "path").where((F.col("line_start") <= F.col("line")) & (F.col("line") <= F.col("line_end")))
    return met.groupBy("path", "line").agg(F.min_by("id", F.struct(-F.col("line_start"), F.col("id"))).alias("id"))


#: Routes that one automaton holds.
ROUTES = 200_000


def route_links(endpoints: DataFrame, clients: DataFrame, block: int = ROUTES) -> DataFrame:
    """(client, endpoint): clients (id, text) whose text holds an endpoint's route (id, route) in any case, annotation syntax around the route left out.

    Each text is read once by an automaton of up to `block` routes, in place of a join of all texts and routes; more routes take more automata.
    """
    import pyarrow as pa

    low = F.lower("route")
    inner = F.regexp_extract(low, r'\("(.*)"\)', 1)
    routes = endpoints.select(F.col("id").alias("endpoint"), F.when(inner != "", inner).otherwise(low).alias("route")).where(F.col("route") != "")
    own = clients.where(F.coalesce("text", F.lit("")) != "").select(F.col("id").alias("client"), F.lower("text").alias("text"))
    blocks = max(1, -(-routes.select("route").distinct().count() // block))
    kind = own.schema["client"].dataType.simpleString()
    out = None
    for k in range(blocks):
        part = routes.select("route").distinct().where(F.pmod(F.xxhash64("route"), F.lit(blocks)) == k)
        sent = clients.sparkSession.sparkContext.broadcast([r["route"] for r in part.toLocalIterator()])  # about `block` routes

        def batches(it, sent=sent):
            import ahocorasick

            found = ahocorasick.Automaton()
            for r in sent.value:
                found.add_word(r, r)
            if len(found):
                found.make_automaton()
            for b in it:
                ids, hits = [], []
                for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for r in sorted({r for _, r in found.iter(t)}) if len(found) else ():
                        ids.append(c)
                        hits.append(r)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(hits, pa.string())], ["client", "route"])

        got = own.mapInArrow(batches, f"client {kind}, route string")
        out = got if out is None else out.unionByName(got)
    return out.join(routes, "route").select("client", "endpoint").distinct()
