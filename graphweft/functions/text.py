"""Scalar functions over text, paths and ids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that a question's terms leave out.
STOP = [
    "the", "and", "was", "were", "why", "what", "when", "how", "where", "who", "which", "does", "did", "do", "is", "are", "for", "from", "with", "this", "that", "have", "has", "had", "been", "being", "not",
    "can", "could", "would", "should", "will", "about", "into", "than", "then", "there", "their", "they", "you", "your", "its", "it", "of", "on", "in", "at", "to", "by", "as", "or", "if", "but", "so", "up",
    "out", "get", "use", "used", "using", "know", "tell", "explain", "introduce", "introduced", "added", "remove", "removed", "change", "changed", "happen", "happened", "still", "ever", "since",
]
# Words of a commit subject that say nothing of its cluster.
GLUE = ["with", "from", "into", "when", "this", "that", "then", "they", "them", "have", "will", "make", "makeit", "maked", "more", "also", "only", "just", "some", "very"]


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at least two bytes, stop words left out."""
    stop = F.array(*[F.lit(s) for s in STOP])
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: (F.octet_length(t) >= 2) & ~F.array_contains(stop, t))


def significant(text: Column) -> Column:
    """[a-z0-9] runs of at least four characters that aren't glue words, sorted, repeats included."""
    glue = F.array(*map(F.lit, GLUE))
    return F.array_sort(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 4) & ~F.array_contains(glue, t)))


def content_tokens(text: Column) -> Column:
    """Distinct [a-z0-9] runs of at least four characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) >= 4))


def name_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, else the Jaccard similarity of their token sets, 0 where one has none."""
    x, y = F.array_distinct(name_tokens(a)), F.array_distinct(name_tokens(b))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, frequencies taken over the byte length."""
    chars = F.sort_array(F.split(text, ""))
    n = F.octet_length(text).cast("double")
    kinds = F.array_distinct(chars)
    share = F.transform(kinds, lambda k: (F.array_position(F.reverse(chars), k) * -1 + F.size(chars) + 1 - F.array_position(chars, k) + 1).cast("double") / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


# Name, pattern and replacement of secrets, applied in turn.
SECRETS = [
    ("api_key_assignment", r"""(?i)((?:api[_-]?key|secret|token|client[_-]?secret|auth[_-]?token|credentials?|bearer|password|passwd|private[_-]?key)[A-Za-z0-9_-]*)\s*[:=]\s*["']?([A-Za-z0-9_\-\.\/\+]{8,})["']?""", "$1=[REDACTED:api_key_assignment]"),
    ("bearer_header", r"(?i)\bbearer\s+[A-Za-z0-9\-_\.]{10,}", "[REDACTED:bearer_header]"),
    ("aws_access_key", r"\b(AKIA|ABIA|ACCA|ASIA)[0-9A-Z]{16}\b", "[REDACTED:aws_access_key]"),
    ("github_token", r"\b(ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|ghu_[A-Za-z0-9]{36}|ghs_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})\b", "[REDACTED:github_token]"),
    ("slack_token", r"\bxox[baprs]-[0-9]{10,13}-[0-9]{10,13}[a-zA-Z0-9-]*\b", "[REDACTED:slack_token]"),
    ("private_key_pem", r"-----BEGIN (?:RSA|EC|OPENSSH|PGP|DSA)? ?PRIVATE KEY-----[^-]+-----END (?:RSA|EC|OPENSSH|PGP|DSA)? ?PRIVATE KEY-----", "[REDACTED:private_key]"),
    ("connection_string_credentials", r"(?i)((?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|mssql))://([^:@/\s]+):([^@\s]+)@", "$1://$2:[REDACTED]@"),
    ("jwt_token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED:jwt_token]"),
]


#: What a text must hold, in any case, for a secret's pattern to occur in it: plain searches spare most texts the pattern.
SECRET_MARKS = {
    "api_key_assignment": ["api", "secret", "token", "credential", "bearer", "passw", "private"], "bearer_header": ["bearer"], "aws_access_key": ["akia", "abia", "acca", "asia"], "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "github_pat_"],
    "slack_token": ["xox"], "private_key_pem": ["-----begin "], "connection_string_credentials": ["://"], "jwt_token": ["eyj"],
}


def _marked(name: str, low: Column) -> Column:
    out = low.contains(SECRET_MARKS[name][0])
    for x in SECRET_MARKS[name][1:]:
        out = out | low.contains(x)
    return out


def _bound(value: Column, f) -> Column:
    """f of a value that is made once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def redacted(text: Column) -> Column:
    """The text with the patterns of secrets replaced."""

    def step(name, pattern, to):
        marked = lambda t: _bound(F.lower(t), lambda low: _marked(name, low))
        return lambda t: F.when(marked(t), F.regexp_replace(t, ascii_bounds(pattern), to)).otherwise(t)

    for secret in SECRETS:
        text = _bound(text, step(*secret))
    return text


def sanitize(df: DataFrame, column: str = "text") -> DataFrame:
    """df with secrets in the column replaced: those of the patterns, then words that look random."""
    df = df.withColumn(column, redacted(F.col(column)))
    return df.withColumn(column, F.aggregate(random_tokens(F.col(column)), F.col(column), lambda t, w: F.replace(t, w, F.lit("[REDACTED:high_entropy_secret]"))))


def has_secret(text: Column) -> Column:
    """Whether a pattern occurs (credentials that are redacted already don't count) or a word looks random."""

    def by_pattern(low):
        out = F.lit(False)
        for name, pattern, _ in SECRETS:
            found = ascii_bounds(pattern).replace("([^@\\s]+)@", "(?!\\[REDACTED)([^@\\s]+)@") if name == "connection_string_credentials" else ascii_bounds(pattern)
            out = out | (_marked(name, low) & text.rlike(found))
        return out

    return _bound(F.lower(text), by_pattern) | (F.size(random_tokens(text)) > 0)


def chunk_id(text: Column) -> Column:
    """c and twelve digits of the hash, line ends and trailing blanks made alike."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \\t]+(\n|$)", "$1")
    return F.concat(F.lit("c"), F.substring(F.sha2(clean.cast("binary"), 256), 1, 12))


def freshness(age_hours: Column, half_life_days: Column) -> Column:
    """0.5 ^ (age / half-life); 1 for what is not yet valid."""
    return F.when(age_hours <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age_hours / (24.0 * half_life_days)))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_")


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


# Languages by extension, by extension of headers, by file name.
LANGUAGES = {
    "rust": ["rs"], "go": ["go"], "python": ["py", "pyi"], "java": ["java"], "javascript": ["js", "mjs", "cjs", "jsx"], "typescript": ["ts", "tsx", "cts", "mts"], "cpp": ["cpp", "cc", "cxx"], "c": ["c"],
    "csharp": ["cs"], "ruby": ["rb"], "php": ["php"], "css": ["css", "scss", "less"], "html": ["html", "htm", "xhtml"], "kotlin": ["kt", "kts"], "swift": ["swift"], "scala": ["scala", "sc"], "json": ["json", "jsonc"],
}
HEADERS = {"cpp": ["hpp", "hh", "hxx", "h"]}
LANGUAGE_FILES = {"ruby": ["rakefile", "gemfile", "config.ru"]}


def language_of(path: Column) -> Column:
    """By file name, else by extension, else by header extension (`h` is the first language's that claims it); `unknown` for the rest."""
    base = F.lower(F.substring_index(path, "/", -1))
    ext = F.when(base.contains("."), F.substring_index(base, ".", -1)).otherwise(F.lit(""))
    out = F.lit("unknown")
    for known, value in ((HEADERS, ext), (LANGUAGES, ext), (LANGUAGE_FILES, base)):
        for lang, names in known.items():
            out = F.when(value.isin(names), lang).otherwise(out)
    return out


# Buckets of data types, in the order of their tests: (bucket, prefixes, parts, whole names, suffixes), all lower-case but for `[]`.
TYPES = [
    ("async_handle", ["promise", "task", "future", "completablefuture", "chan ", "channel"], [], [], []),
    ("optional", ["option", "optional", "nullable"], [], [], ["?"]),
    ("array", ["[]", "list", "array", "vector", "slice", "set", "hashset"], [], [], []),
    ("map", ["map", "dict", "hash", "btree", "concurrenthashmap"], [], [], []),
    ("string", [], ["string"], ["str", "char*", "std::string", "text", "stringbuilder"], []),
    ("integer", [], ["int"], ["i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "size_t", "ssize_t", "long", "short", "byte"], []),
    ("number", [], ["float", "double"], ["f32", "f64", "number", "decimal", "bigdecimal"], []),
    ("boolean", [], [], ["bool", "boolean"], []),
    ("void", [], [], ["void", "nil", "null", "none", "()", "std::nullptr_t"], []),
]


def type_bucket(raw: Column) -> Column:
    """The bucket of a declared type; an empty one is void, an unknown one stays as it is."""
    raw = F.btrim(raw, F.lit(" \t\r\n"))
    low, out = F.lower(raw), raw
    for bucket, prefixes, parts, names, suffixes in reversed(TYPES):
        hit = low.isin(names) if names else F.lit(False)
        for test, xs in ((low.startswith, prefixes), (low.contains, parts), (raw.endswith, suffixes)):
            for x in xs:
                hit = hit | test(x)
        out = F.when(hit, bucket).otherwise(out)
    return F.when(raw == "", "void").otherwise(out)


def merged_set(a: Column, b: Column) -> Column:
    """Two comma lists as one, sorted, each entry once; an empty list leaves the other as it is."""
    parts = F.filter(F.concat(F.split(a, ","), F.split(b, ",")), lambda x: x != "")
    return F.when(a == "", b).when(b == "", a).otherwise(F.array_join(F.array_sort(F.array_distinct(parts)), ","))


#: Patterns of instants, tried in turn.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd"]


def parse_instant(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def percent_decoded(text: Column) -> Column:
    """%XX escapes as the bytes that they stand for; what isn't an escape (a plus sign too) stays."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)


def state_of_tags(tags: Column) -> Column:
    """What follows `state=` in the first tag that says more than that; empty without one."""
    found = F.filter(tags, lambda t: t.startswith("state=") & (F.length(t) > 6))
    return F.coalesce(F.substr(F.get(found, 0), F.lit(7)), F.lit(""))


def match_score(name: Column, terms: list[str]) -> Column:
    """Best over terms: equal 1.0, prefix 0.9, substring either way 0.8, else 0."""
    low = F.lower(name)
    each = [F.when(low == t, 1.0).when(low.startswith(t), 0.9).when(low.contains(t) | F.lit(t).contains(low), 0.8).otherwise(0.0) for t in (x.lower() for x in terms)]
    return F.greatest(*each) if len(each) > 1 else each[0]


# Intents by touched file, by conventional type, by keyword; in the order of their tests.
FILE_INTENTS = [
    ("DEPENDENCY_UPDATE", r"(?i)^.*(go\.mod|go\.sum|package\.json|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|pom\.xml|build\.gradle|requirements.*\.txt|Cargo\.(toml|lock)|Gemfile(\.lock)?|composer\.(json|lock))$"),
    ("INFRASTRUCTURE", r"(?i)^.*(\.github/workflows/|\.gitlab-ci\.yml|Jenkinsfile|Dockerfile|docker-compose(\.yml|\.yaml)?|Makefile|\.goreleaser\.yml|\.terraform/|terraform\.tf|k8s/|helm/|infra/|\.github/actions/)"),
    ("DOCS", r"(?i)(^|/)(docs?/|adr/|\.md$|\.mdx$|\.rst$|\.adoc$|\.txt$|CHANGELOG|README|CONTRIBUTING|LICENSE|NOTICE|AUTHORS|CODEOWNERS)"),
]
TYPE_INTENTS = {
    "docs": "DOCS", "test": "TEST", "tests": "TEST", "fix": "FIX_BUG", "bugfix": "FIX_BUG", "hotfix": "FIX_BUG", "feat": "ADD_FEATURE", "feature": "ADD_FEATURE", "perf": "PERFORMANCE", "refactor": "REFACTOR", "style": "REFACTOR",
    "security": "SECURITY", "sec": "SECURITY", "build": "INFRASTRUCTURE", "ci": "INFRASTRUCTURE", "infra": "INFRASTRUCTURE", "chore": "INFRASTRUCTURE", "deps": "DEPENDENCY_UPDATE", "dep": "DEPENDENCY_UPDATE",
}
KEYWORD_INTENTS = [
    ("FIX_BUG", r"(?i)\b(fix(es|ed)?|bug( ?fix)?|correct(?:s|ed)?|resolve(?:s|d)?|hotfix)\b"),
    ("TEST", r"(?i)\b(test(?:s|ing)?|spec(?:s)?|coverage|unit ?test|integration ?test|e2e)\b"),
    ("PERFORMANCE", r"(?i)\b(perf(?:ormance)?|optimiz(?:e|es|ed|ing)?|accelerat(?:e|es|ed)?|speed ?up|latency|throughput|slowdown)\b"),
    ("SECURITY", r"(?i)\b(secur(?:e|ity)|authentication|oauth|jwt|csrf|xss|vuln(?:erabilit)?|injection|sanitiz(?:e|es|ed)?|encrypt(?:s|ed|ion)?|decrypt(?:s|ed)?)\b"),
    ("REFACTOR", r"(?i)\b(refactor(?:s|ed|ing)?|restructur(?:e|es|ed|ing)?|clean(?:up|s)?|reorgani[sz](?:e|es|ed|ing)?|simplif(?:y|ies|ied|ying)?|extract(?:s|ed|ing)?|consolidat(?:e|es|ed)?)\b"),
    ("ADD_FEATURE", r"(?i)\b(add(?:s|ed)?|feat(?:ure)?|new |introduce(?:s|d)?|implement(?:s|ed)?|support(?:s|ed)? for|extend(?:s|ed)?)\b"),
    ("DOCS", r"(?i)\b(doc(?:s|ument(?:s|ation)?)?\b|readme|changelog|comment(?:s|ing)?|wiki|adr )\b"),
    ("INFRASTRUCTURE", r"(?i)\b(ci|cd|build|deploy(?:s|ed)?|release|infra(?:structure)?|pipeline|bump|upgrade|depend(?:enc|en)ies|tooling)\b"),
]
CONVENTIONAL = r"^\s*([a-zA-Z]+)(?:\(([^)]*)\))?(!)?:\s"
MERGED = r"(?i)^merge\s+(pull\s+request|pull-?request|branch)\b"


def ascii_bounds(pattern: str) -> str:
    """The pattern with word boundaries between ASCII word characters and all others, whatever letters other scripts have."""
    return pattern.replace(r"\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(ascii_bounds(pattern)), name).otherwise(out)
    return out


def intent(subject: Column, body: Column, files: Column) -> Column:
    """What a commit is for: if each touched file (array) has a rule, that of the first; else its conventional type; else the first
    keyword rule that fits the body of a merged request, or subject and body; else UNKNOWN."""
    each = F.transform(files, lambda f: _first(f, FILE_INTENTS))
    by_file = F.when((F.size(files) > 0) & F.forall(each, lambda x: x.isNotNull()), F.get(each, 0))
    kind = F.lower(F.regexp_extract(subject, CONVENTIONAL, 1))
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_INTENTS.items() for x in kv]), kind)
    rest = F.btrim(body, F.lit(" \t\r\n"))
    by_body = F.when(subject.rlike(ascii_bounds(MERGED)) & (rest != ""), _first(rest, KEYWORD_INTENTS))
    return F.coalesce(by_file, by_type, by_body, _first(F.concat_ws("\n", subject, body), KEYWORD_INTENTS), F.lit("UNKNOWN"))


def looks_random(token: Column) -> Column:
    """True for keys and digests: 32 or more base64 characters, no UUID, and enough entropy for the alphabet and length."""
    bits, n = entropy(token), F.length(token)
    uuid = (n == 36) & (n - F.length(F.replace(token, F.lit("-"), F.lit(""))) == 4)
    enough = F.when(token.rlike("^[0-9A-Fa-f]+$"), bits >= 3.2).otherwise(((n >= 40) & (bits >= 4.0)) | (bits >= 4.3))
    return token.rlike("^[A-Za-z0-9_+/=-]{32,}$") & ~uuid & enough


def random_tokens(text: Column) -> Column:
    """Words that look random, quotes, brackets and stops at their ends left out; the pattern goes first, entropy is dear. A text without 32 such characters in a row isn't cut."""
    words = F.transform(F.split(text, r"[\s]+"), lambda w: F.btrim(w, F.lit("\"'` ,;()[]{}")))
    found = F.filter(F.filter(words, lambda w: w.rlike("^[A-Za-z0-9_+/=-]{32,}$")), looks_random)
    return F.when(text.rlike("[A-Za-z0-9_+/=-]{32}"), found).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))
