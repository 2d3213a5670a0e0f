"""Each operator against a plain version of it, on the small tables and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweft.llm import chat, decontam, lines, near, pieces, pii, quality, queries, rules, simhash, suffix_tree, urls
from graphweft.llm.markov import END, SuffixTree

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, None, "s1", 7), (2, "", "s1", None), (3, " \t\n ", None, 3), (4, "one", "s2", 4), (5, "Two words", "s2", 5), (6, LONG, "s3", 6), (6, LONG, "s3", 6),
    (7, LONG, "s4", 8), (None, "no id at all, +1 (743) 555-3824 and a@b.co", "s5", 1), (8, "🙂 é ß İ Ⅷ ▁ \x00 a▁b  c\u00a0d\r\n\ttab", "s6", 2), (9, "x" * 5000, "s7", 9),
]
CLASH = "doc_id long, text string, source string, n_words long"


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, CLASH)
    for c in ("row", "_row", "kept", "fp", "hits", "score", "key", "dkey", "word", "n_lines"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_pii_base_is_the_plain_patterns(spark):
    texts = [t or "" for _, t in docs(spark, SF)] + [
        "a@b a@b.c@d.e x@@y.z a.b@c.d.e, @q.r", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 12..3.4.5 1.2.3 1.1.1.1.1", "4111 1111 1111 1111-4111111111111111", "+1 (2 +12345678901 +1+2 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "a" * 3000 + "@" + "b" * 10, "1" * 5000, "1." * 2000,
        "x 00000000000000000000001.2.3.4 y", *(f"z {'0' * n}255.{'0' * n}.{'0' * n}1.4 {'0' * n}256.1.1.1 {'9' * n}.1.1.1" for n in (17, 18, 19, 20, 21, 300, 4000)),
    ]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t[:80]


def test_pii_adds_spans_and_keeps_base(spark, odd, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    tagger = pii.train(d, 300)
    got = pii.find_pii(odd, tagger).collect()
    assert len(got) == len(ODD) and pii.find_pii(empty, tagger).count() == 0
    text = "call me at (743) 555-3824 today or at 10.20.30.40 please"
    base, added = pii.find_spans([text, "nothing here at all"], tagger)[0]
    at = text.index("10.20")
    assert base == [(at, 1, at + 11)] and all(b <= at or a >= at + 11 for a, _, b in added)
    tail = "x " * 40_000 + "write to a.b@c.example.org today"
    assert any("a.b@c.example.org" in w for w, _ in pii.labelled_windows(tail))
    rng = np.random.default_rng(1)
    held = [pii.written(rng, 3) for _ in range(60)]
    found = sum(bool(b or a) for b, a in pii.find_spans([f"some words {s} and more words" for s in held], tagger))
    assert found >= 50, found
    clean = [re.sub(r"[0-9@]", "", t or "") for _, t in docs(spark, SMALL)]
    assert all(not b and not a for b, a in pii.find_spans(clean, tagger))
    for r in pii.find_pii(d, tagger).collect():
        told = [s for s in r["spans"].split(",") if s]
        assert len(told) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"]


def test_pii_added_spans_by_kind(spark):
    """Held-out written variants that the patterns miss, also longer than a window's half and than a window: recall and precision of each kind."""
    tagger = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rng = np.random.default_rng(99)
    plain = "the of and in to thanedble attion that onea reed".split()
    say = lambda n: " ".join(plain[int(k)] for k in rng.integers(0, len(plain), n))
    for kind in range(4):
        hit = n = wrong = long_hit = long_n = 0
        for i in range(150):
            s = pii.written(rng, kind)
            if kind == 0 and i % 3 == 0:
                s = ".".join(["surname"] * 2) + " @ " + ".".join("department" for _ in range(2 + i % 5)) + ".org"
            text = f"{say(int(rng.integers(1, 40)))} {s} {say(20)}"
            a = text.index(s)
            base, added = pii.find_spans([text], tagger)[0]
            if (a, kind, a + len(s)) in base:
                continue
            ok = (a, kind, a + len(s)) in added
            n, hit, wrong = n + 1, hit + ok, wrong + len(added) - ok
            if len(s) > 31:
                long_n, long_hit = long_n + 1, long_hit + ok
        assert n > 30 and hit >= 0.8 * n and wrong <= 0.1 * n, (kind, n, hit, wrong)
        assert kind or (long_n > 40 and long_hit >= 0.9 * long_n), (long_n, long_hit)


def test_pii_digests_of_the_query(spark):
    table = dict(docs(spark, SMALL))
    names = ["email", "ip", "card", "phone"]
    told = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    for r in queries.op1_pii(spark, SMALL).collect():
        base = plain_base(table[r["doc_id"]] or "")
        assert [r[f"n_{n}"] for n in names] == [sum(k == i for _, k, _ in base) for i in range(4)] and r["base_sha256"] == sha(told(base))
        spans = [s for s in r["spans"].split(",") if s]
        assert set(told(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]


def test_pii_decoding_against_all_paths():
    rng = np.random.default_rng(3)
    t = pii.Tagger(hidden=3)
    for k in t.p:
        t.p[k] = rng.normal(0, 1, t.p[k].shape)
    x = rng.integers(0, pii.CLASSES, (3, 4))
    path, _ = t.decode(x)
    e = t.emissions(x.T)
    for r in range(3):
        total = t.p["start"][:, None, None, None] + e[0, r][:, None, None, None] + t.p["trans"][:, :, None, None] + e[1, r][None, :, None, None]
        total = total + t.p["trans"][None, :, :, None] + e[2, r][None, None, :, None] + t.p["trans"][None, None, :, :] + e[3, r][None, None, None, :]
        assert tuple(path[r]) == np.unravel_index(total.argmax(), total.shape)


def test_reconcile_against_all_subsets(monkeypatch):
    monkeypatch.setattr(pii, "_plausible", lambda *a: True)
    rng = np.random.default_rng(8)
    for _ in range(200):
        spans = [(int(a), int(a + n), int(k), float(m)) for a, n, k, m in zip(rng.integers(0, 30, 7), rng.integers(1, 12, 7), rng.integers(0, 4, 7), rng.random(7) * 5)]
        base = [(4, 1, 7)]
        best = 0.0
        free = [s for s in spans if not (s[0] < 7 and s[1] > 4)]
        for mask in range(1 << len(free)):
            own = sorted(s for i, s in enumerate(free) if mask >> i & 1)
            if all(x[1] <= y[0] for x, y in zip(own, own[1:])):
                best = max(best, sum(s[3] for s in own))
        got = pii.reconcile("x" * 50, spans, base)
        margin = {(a, k, b): max(s[3] for s in spans if (s[0], s[2], s[1]) == (a, k, b)) for a, k, b in got}
        assert abs(sum(margin.values()) - best) < 1e-9


def test_pii_gradients_are_right():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (5, 3)), rng.integers(0, pii.TAGS, (5, 3))
    t = pii.Tagger(hidden=3)
    _, g = t.gradients(x, y)
    for k in t.p:
        at = tuple(rng.integers(0, n) for n in t.p[k].shape) if k[0] != "x" else (int(x[0, 0]), 1)
        old, e = t.p[k][at], 1e-5
        t.p[k][at] = old + e
        up, _ = t.gradients(x, y)
        t.p[k][at] = old - e
        down, _ = t.gradients(x, y)
        t.p[k][at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-6, k


def test_reconcile_takes_the_best_set():
    text = "x (743) 555-3824 y 743-555-3824 z"
    a, b = text.index("("), text.index("3824") + 4
    got = pii.reconcile(text, [(a, b, 3, 2.0), (a + 1, b, 3, 5.0), (a, b, 3, 3.0), (19, 31, 3, 1.0)], [])
    assert sorted(got) == [(a + 1, 3, b), (19, 3, 31)] and pii.reconcile(text, [(a, b, 3, 2.0)], [(a, 1, a + 3)]) == []


def test_scoring_base_and_held_out(spark, odd, empty):
    rows = docs(spark, SF)
    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            train.update((t or "").encode().lower().split())
            train[b"\n"] += 1
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in suffix_tree.score_texts(spark.read.parquet(f"{SF}/documents.parquet"), head_share=1e-4).collect()}
    assert len(got) == len(rows)
    base = mine = 0.0
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        want = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = got[i]
        assert r["train_tokens"] == n and r["n_tokens"] == len(w) and r["n_known"] == sum(train[x] > 0 for x in w)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and abs(r["base_score"] - want) < 1e-6 * max(1, abs(want))
        if r["held_out"]:
            base, mine = base + r["base_score"], mine + r["score"]
    assert mine > 0.99 * base, (mine, base)
    assert suffix_tree.score_texts(odd).count() == len(ODD) and suffix_tree.score_texts(odd.where("doc_id is null")).first()["train_tokens"] == 0 and suffix_tree.score_texts(empty).count() == 0


def test_suffix_tree_against_plain_look_up():
    from graphweft.llm.markov import DEPTH, GramCounts

    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(np.frombuffer(b"abcab ", np.uint8), rng.integers(0, 400))) + END for _ in range(50)]
    counts = GramCounts()
    counts.add(texts)
    keys, n = counts.result()
    want = Counter()
    for t in texts:
        p = END * DEPTH + t
        want.update(int.from_bytes(p[i - DEPTH : i + 1], "big") for i in range(DEPTH, len(p)))
    assert dict(zip(keys.tolist(), n.tolist())) == dict(want)
    levels = []
    for k in range(DEPTH + 1):
        c = Counter()
        for g, m in want.items():
            c[g & ((1 << 8 * (k + 1)) - 1)] += m
        gs = sorted(c)
        levels.append((np.array([g >> 8 for g in gs]), np.array([g & 255 for g in gs]), np.array([c[g] for g in gs], float)))
    tree = SuffixTree(levels)
    assert tree.nodes >= 4

    def plain(t):
        p, total = END * DEPTH + t, 0.0
        for i in range(DEPTH, len(p)):
            node = 1
            for k in range(1, DEPTH + 1):
                nxt = tree.child[node * tree.width + tree.symbol[p[i - k]]]
                if not nxt:
                    break
                node = nxt
            total += tree.log[node * tree.width + tree.symbol[p[i]]]
        return total

    more = [*texts, b"zzz" + END, END, b"ab" * 700_000 + END]
    got = tree.score(more)
    for t, s in list(zip(more, got))[:-1]:
        assert abs(plain(t) - s) < 1e-3
    for node in range(1, tree.nodes + 1):
        row = 10.0 ** tree.log[node * tree.width : (node + 1) * tree.width].astype(float)
        assert abs(row[1:].sum() + row[0] * (256 - tree.width + 1) - 1) < 1e-4


def test_chat_round_trip(spark, empty):
    nasty = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "\\", "\\\\<text>", "<<turn>>", "<\\\\turn>", "", None, "é🙂\n"]
    turns = [(1, k, "user" if k % 3 else "assistant", t) for k, t in enumerate(nasty)] + [(2, 0, None, "a"), (2, 0, "", "b"), (2, 0, "", "b"), (2, None, "<s>", "x"), (None, 1, "assistant", "y")]
    turns += [(3, k, "assistant" if k % 300 < 290 else "user", f"t{k}<turn>") for k in range(1500)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("_turns", F.lit(1))
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in made.withColumn("t", chat.parse_chats(F.col("formatted"))).collect()}
    for c in (1, 2, 3, None):
        want = sorted(((-1 if k is None else k, r or "", t or "") for i, k, r, t in turns if i == c))
        assert [(t["role"], t["text"]) for t in got[c]["t"]] == [x[1:] for x in want]
        assert got[c]["n_runs"] == sum(i == 0 or want[i - 1][1] != x[1] for i, x in enumerate(want))
    d = {r["conv_id"]: r for r in chat.digest(made).collect()}
    want = sorted((k, r, t or "") for i, k, r, t in turns if i == 1)
    assert d[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in want)) and d[1]["loss_sha256"] == sha("".join(t for _, r, t in want if r == "assistant"))
    assert chat.digest(chat.format_chats(df.limit(0))).count() == 0


def test_pieces_are_the_library(spark, odd, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.model_bytes())
    table = {i: t for i, t in docs(spark, SF)}
    got = queries.op4_sentencepiece(spark, SF).collect()
    assert len(got) == len(table)
    strange = ["  two  spaces ", "\n\n a\n b", "▁", " ", "\t", "<s>", "<0x0A>", "\x00", "a" * 9000, "日本語 テキスト 🙂🙂", " ▁ ▁", "é" * 50, "\r\n", "a\u2581b", "x\n", "\n"]
    mine = pieces.Pieces(queries.model_bytes())
    for t, (ids, told) in zip(strange, mine.look_up(strange)):
        assert ids == lib.encode(t), t
        assert told == ",".join(map(str, lib.encode(t)))
    for r in got:
        ids = lib.encode(table[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    out = pieces.decode_ids(pieces.encode_texts(odd.select("doc_id", "text", "source"), queries.model_bytes()), queries.model_bytes()).collect()
    assert Counter(r["text"] for r in out) == Counter((t or "").replace("▁", " ") for _, t, *_ in ODD)
    assert pieces.round_trip(empty, queries.model_bytes()).count() == 0


def test_pieces_forget_and_go_on():
    """Ids stay the library's when a worker remembers next to nothing, and frequent stretches are kept."""
    mine = pieces.Pieces(queries.model_bytes())
    mine.remembered = 20_000
    for k in range(30):
        texts = ["", "often met words", f"rare{k} words{k * k} often  met", "▁x\n" * k, " ".join(f"w{k}{j}" for j in range(40))]
        for t, (ids, _) in zip(texts, mine.look_up(texts)):
            assert ids == mine.library.encode(t), t
        assert len(mine.numbers) < 200
    assert "▁often" in mine.numbers and len(mine.numbers) <= len(mine.start) == len(mine.met)


def test_url_rules_and_models(spark):
    rows = [(1, "http://A.Example.ORG/en/12?x"), (2, "https://example.org/es/1"), (3, "https://org/"), (4, "https://xorg/"), (5, None), (6, "no scheme"), (7, "http://m.com/de/1"), (8, "http://com/fr/"), (9, "http://x.net#a://b/"), (9, "http://x.net#a://b/"), (None, "http://x.org?q"), (10, "ht\ntp://a.com/fr/\n1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df).collect()}
    assert got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block") and got[2] == ("example.org", "/es/1", "example.org/es/", "block") and got[3] == ("org", "/", "org/", "allow")
    assert got[4][:3] == ("xorg", "/", None) and got[5][:3] == got[6][:3] == ("", "", None) and got[7][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[9][:2] == ("x.net", "") and got[None][:3] == ("x.org", "", None) and got[10][:2] == ("a.com", "/fr/\n1")
    assert urls.filter_urls(df).count() == len(rows) and urls.filter_urls(df.limit(0)).count() == 0
    full = queries.op5_url_filter(spark, "/root/testdata/sf0.1").where("rule is not null").collect()
    right = sum((r["margin"] >= 0) == (r["verdict"] == "allow") for r in full)
    assert right > 0.85 * len(full), (right, len(full))


def test_url_verdicts_against_plain(spark):
    """Rules, models, held-out calibration and verdicts from plain counts over all pages."""
    from graphweft.llm.markov import DEPTH

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rows = [(r["page_id"], r["url"], r["held"]) for r in pages.withColumn("held", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(urls.HELD)) == 0).collect()]

    def ruled(u):
        if u is None or "://" not in u:
            return "", "", None, None
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    def tree(texts):
        grams = [Counter() for _ in range(DEPTH + 1)]
        for t in texts:
            p = END * DEPTH + t
            for i in range(DEPTH, len(p)):
                for k in range(DEPTH + 1):
                    grams[k][int.from_bytes(p[i - k : i], "big"), p[i]] += 1
        total, levels = sum(grams[0].values()), []
        for g in grams:
            size = Counter()
            for (x, _), n in g.items():
                size[x] += n
            kept = sorted((x, s, n) for (x, s), n in g.items() if size[x] >= urls.P_MIN * total)
            levels.append(tuple(np.array([r[j] for r in kept], t) for j, t in enumerate((np.int64, np.int64, float))))
        return SuffixTree(levels)

    data = lambda u: (u or "").encode().replace(END, b" ") + END
    told = {i: ruled(u) for i, u, _ in rows}
    good, bad = (tree([data(u) for i, u, h in rows if told[i][3] == v and not h]) for v in ("allow", "block"))
    margin = {i: float((good.score([data(u)]) - bad.score([data(u)]))[0] / len(data(u))) for i, u, _ in rows}
    step = {i: min(urls.STEPS, max(0, math.floor((m + urls.SPAN) / (2 * urls.SPAN) * urls.STEPS))) for i, m in margin.items()}
    held = [(step[i], told[i][3]) for i, _, h in rows if h and told[i][3]]
    n = Counter(v for _, v in held)
    assert n["allow"] and n["block"]
    gap = [sum(v == "block" for s, v in held if s <= e) / n["block"] - sum(v == "allow" for s, v in held if s <= e) / n["allow"] for e in range(urls.STEPS + 1)]
    best = [e for e, g in enumerate(gap) if g >= max(gap) - 1e-12]
    edge = -urls.SPAN + 2 * urls.SPAN * (best[0] + best[-1] + 2) / 2 / urls.STEPS
    for r in queries.op5_url_filter(spark, SF).collect():
        i = r["page_id"]
        assert (r["host"], r["path"], r["rule"]) == told[i][:3] and abs(r["margin"] - margin[i]) < 1e-4
        if abs(margin[i] - edge) > 1e-3:
            assert r["verdict"] == (told[i][3] or ("allow" if margin[i] >= edge else "block"))


def test_url_models_read_the_whole_url(spark):
    pages = [(i, f"http://a{i}.org/x{i}?good=one") for i in range(60)] + [(i + 100, f"http://a{i}.com/de/x{i}?zzz#qqq") for i in range(60)]
    other = [(500, "http://m.net/a?good=one"), (501, "http://m.net/a?zzz#qqq"), (502, "?good=one"), (503, "?zzz#qqq")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(pages + other, "page_id long, url string")).collect()}
    assert got[500]["margin"] > got[501]["margin"] and got[502]["margin"] > got[503]["margin"]
    assert (got[500]["verdict"], got[501]["verdict"]) == ("allow", "block") and got[502]["host"] == got[503]["path"] == ""


def plain_lines(rows, sites=5):
    at = {}
    for i, t, s in rows:
        for k, x in enumerate((t or "").split("\n")):
            if x.strip(" \t\r\x0b\x0c"):
                at.setdefault(x.strip(" \t\r\x0b\x0c"), []).append((-(1 << 63) if i is None else i, k, s))
    wide = {x: min(p)[:2] for x, p in at.items() if len({s for _, _, s in p} - {None}) >= sites}
    out = []
    for i, t, _ in rows:
        keep = [x for k, x in enumerate((t or "").split("\n")) if (y := x.strip(" \t\r\x0b\x0c")) not in wide or wide[y] == (-(1 << 63) if i is None else i, k)]
        out.append((i, None if t is None else "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("told", [500_000, 2])
def test_line_dedup_keeps_one(spark, odd, empty, told):
    shared = "this very line stands on many sites"
    rows = [(i, f"own words of text {i} here\n {shared} \nshort line\nok\n", f"s{i % 6}") for i in range(12)] + [(20, f"{shared}\n{shared}", "s0"), (20, f"{shared}\n{shared}", "s0"), (None, "x", None), (None, "ok\nx", "s9"), (21, None, "s1"), (22, "", "s2")]
    rows += [(30 + i, "four sites only\n" + "\n".join(f"line {k % 7}" for k in range(9000 * (i == 3))), f"t{i}") for i in range(4)] + [(40 + i, f"own {i}\nline 3", f"u{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lines.dedup_lines(df.withColumn("n_lines", F.lit("clash")), counts=True, told=told).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == plain_lines(rows)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in got if r["doc_id"] in (0, 1, 20, 21, 22)} == {0: (5, 1), 1: (5, 3), 20: (2, 2), 21: (0, 0), 22: (1, 0)}
    d = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    assert Counter(tuple(r) for r in lines.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"), told=told).select("doc_id", "text").collect()) == plain_lines(d)
    assert lines.dedup_lines(odd).columns == odd.columns and lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty).count() == 0


def test_pipeline_drops_short_boilerplate(spark):
    import corpus_pipeline as p

    rows = [(i, f"own words of text {i} here\n\nAll rights reserved.\nok", f"s{i % 6}") for i in range(12)] + [(20, "on two sites\nok", "s0"), (21, "on two sites", "s1")]
    got = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SMALL).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own words of text {i} here\n" for i in range(1, 12)) and got[20] == got[21] == "on two sites"


@pytest.mark.parametrize("most", [1_000_000, 300])
def test_quality_against_plain(spark, most):
    """Vectors, pooled features and scores from plain dictionaries; with `most`, most words meet their vectors by a join."""
    d, lab = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(d, lab, most=most)
    tokens = {i: re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n", t or "") for i, t in docs(spark, SMALL)}
    n = Counter(w for t in tokens.values() for w in t)
    name = {w: w if k >= quality.LEAST else quality.SHAPES[quality.shape(w)] for w, k in n.items()}
    index = {w: quality.index_vectors(np.array([quality.word_hash(w)], np.uint64))[0].astype(int) for w in n}
    own = {w: np.zeros(quality.DIM, int) for w in name.values()}
    for t in tokens.values():
        for i, w in enumerate(t):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if j != i:
                    own[name[w]] += index[t[j]]
    vec = {w: quality.quantised(v[None])[0].astype(float) for w, v in own.items()}
    texts = dict(docs(spark, SMALL))
    network = model[1]
    for r in quality.score_quality(d, model).collect():
        t, tk = texts[r["doc_id"]] or "", tokens[r["doc_id"]]
        x = np.zeros(quality.DIM + 3)
        if tk:
            ls = [s for s in t.split("\n") if s.strip()]
            x[: quality.DIM] = 8 / 127 * sum(vec[name[w]] for w in tk) / len(tk)
            x[quality.DIM :] = np.log1p(len(tk)) / 4 - 1, len(set(tk)) / len(tk), 1 - len(set(ls)) / max(1, len(ls))
        h = np.tanh((x - network.mean) / network.scale @ network.p[0] + network.p[1])
        want = 1 / (1 + np.exp(-(h @ network.p[2] + network.p[3]) / network.temperature))
        assert abs(r["score"] - float(want[0])) < 1e-4 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    twice = lab.unionByName(lab.select("doc_id", F.lit(0).alias("quality"), "toxic"))
    again = quality.fit(d.unionByName(d), twice, most=most)  # repeated rows and labels: one of each
    assert again[1].p[0].shape == network.p[0].shape


def test_quality_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r["score"], labels[r["doc_id"]]) for r in queries.op7_quality(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good = np.array([s for s, q in got if q])
    bad = np.array([s for s, q in got if not q])
    auc = (good[:, None] > bad[None, :]).mean() + 0.5 * (good[:, None] == bad[None, :]).mean()
    assert auc > 0.9, auc
    d, lab = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(d, lab, sample=100)
    assert quality.score_quality(odd, model).count() == len(ODD) and quality.score_quality(empty, model).count() == 0
    assert {r["score"] for r in quality.score_quality(odd, quality.fit(odd, lab.limit(0))).collect()} == {0.5}


def plain_facts(t):
    w = SPLIT.findall(t or "")
    ls = [x for x in (t or "").split("\n") if SPLIT.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def test_rules_facts_and_verdicts(spark, odd, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    table = dict(docs(spark, SF))
    good = bad = 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in queries.op8_quality_rules(spark, SF).collect():
        assert tuple(r[n] for n in names) == plain_facts(table[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
        if r["doc_id"] in labels and not r["base_failed"]:
            good += labels[r["doc_id"]] == r["kept"]
            bad += labels[r["doc_id"]] != r["kept"]
    assert good > 12 * bad, (good, bad)
    for limit in (1 << rules.POSITION_BITS, 4):  # the second way, for very long texts
        got = rules.measure(odd.select("doc_id", "text"), window_limit=limit).collect()
        assert Counter(tuple(r[n] for n in names) for r in got) == Counter(plain_facts(t) for _, t, *_ in ODD)
    lab = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = rules.keep_good(odd, lab.limit(0))
    assert kept.columns == odd.columns and kept.count() == sum(not plain_facts(t)[-1] for _, t, *_ in ODD) and rules.keep_good(empty, lab).count() == 0


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    found = rules.learn_list(x, (x[:, 0] > 0.7) & (x[:, 1] <= 0.5))
    hit = np.any([rules._fires(r, x) for r in found], axis=0)
    assert (hit == ((x[:, 0] > 0.7) & (x[:, 1] <= 0.5))).mean() > 0.97 and rules.learn_list(x, np.zeros(600, bool)) == []


BENCH = [(1, "a b c"), (2, " ".join(f"k{i}" for i in range(12))), (3, None), (None, "one"), (4, "k0 k1 k2 k3 k4 k5 k6 k7"), (4, "a b c"), (5, "Ünï cödé")]
TEXTS = [(1, "x A-b, c y", 0), (2, "k0 k1 k2 k3 k4 k5 k6 k7 k8 z a b c a b c", 0), (3, None, 0), (4, "...", 0), (5, "one " + " ".join(f"K{i}" for i in range(12)) + " ünï cödé end", 0), (2, "a b", 0), (None, "a b c", 0), (6, "(Ünï) Cödé", 0)]


def plain_scan(t, bench):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda s: (s or "").translate({c: c + 32 for c in range(65, 91)})
    w, hit, items, at = cut.findall(low(t)), set(), set(), {}
    for m in range(1, 9):
        for p in range(len(w) - m + 1):
            at.setdefault(tuple(w[p : p + m]), []).append(p)
    for i, b in bench:
        g = cut.findall(low(b))
        if i is None or not g:
            continue
        m = min(8, len(g))
        for k in range(len(g) - m + 1):
            for p in at.get(tuple(g[k : k + m]), []):
                hit |= set(range(p, p + m))
                items.add(str(i))
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), len(items) >= 2


@pytest.mark.parametrize("how", [{}, {"max_literals": 1}, {"max_literals": 1, "block": 3}])
def test_decontamination_against_plain(spark, odd, empty, how):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, n_words long")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.scan(df, bench, **how).collect())
    assert got == Counter((i, *plain_scan(t, BENCH)) for i, t, _ in TEXTS)
    for told in (1_000_000, 0):
        left = {r["doc_id"]: r["text"] for r in decontam.clean(df, bench, told=told, **how).collect()}
        assert left[3] is None and left[4] == "..." and left[6] == "(" and left[2] == "a b" and 5 not in left
    out = decontam.clean(odd, bench, **how)
    assert out.columns == odd.columns and out.count() == len(ODD) and decontam.scan(empty, bench, **how).count() == 0 and decontam.scan(odd, bench.limit(0), **how).count() == len(ODD)


def test_decontamination_beyond_the_literals(spark):
    """A benchmark of more windows than the expression holds: the streamed way with its own bounds."""
    rng = np.random.default_rng(5)
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null")
    own = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bench = own + [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 50_000, 80))) for i in range(900)]
    assert 900 * 73 > decontam.MAX_LITERALS
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.scan(d, b).collect()}
    left = {r["doc_id"]: r["text"] for r in decontam.clean(d, b).collect()}
    hit = 0
    for i, t in docs(spark, SMALL):
        want = plain_scan(t, own)
        assert got[i] == want
        hit += want[1] > 0
        assert (i in left) == (want[2] < 2) and (want[2] or left[i] == t) and (want[2] != 1 or plain_scan(left[i], own)[1] == 0)
    assert hit >= 3


def plain_fingerprint(t):
    w = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = SPLIT.findall(w)
    g = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def plain_components(pairs, radius=3):
    ids, up = [i for i, _ in pairs], list(range(len(pairs)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    f = np.array([p for _, p in pairs], np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= radius) + i + 1:
            a, b = top(i), top(int(j))
            up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(ids))]


def test_simhash_against_plain(spark, odd, empty):
    rows = docs(spark, SF)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {i: (p, c) for (i, p), c in zip(prints, plain_components(prints))}
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(empty).count() == 0
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}[7] == 6
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("how", [{}, {"small": 2}, {"small": 2, "largest": 4}])
def test_covering_links_lose_nothing(spark, how):
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["least"]["doc_id"] for r in simhash.assign(df, ["doc_id"], **how).collect()}
    assert [got[i] for i in range(len(fps))] == plain_components(list(enumerate(fps)))


def test_masks_cover():
    masks = simhash.covering_masks()
    rng = np.random.default_rng(0)
    assert len(masks) == 15
    for _ in range(2000):
        diff = sum(1 << int(b) for b in set(rng.integers(0, 64, 3)))
        assert any(not m & diff for m in masks)


def plain_near(rows):
    """doc_ids of (doc_id, text) rows that near-dedup keeps: of close fingerprints, then of alike shingle sets, the least of each component."""
    kept = set(plain_components([(i, plain_fingerprint(t)) for i, t in rows]))
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w and i in kept:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root, ids = {i: i for i in kept}, sorted(sets)
    while True:  # the least of a component, by brute force
        before = dict(root)
        for n, i in enumerate(ids):
            for j in ids[n + 1 :]:
                if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if before == root:
            return kept, {i for i in kept if root[i] == i}


def plain_clean(t, bench):
    """The text less its hit words, each with what follows up to the next word."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    w = list(cut.finditer(low))
    words, gone = [m.group() for m in w], set()
    for i, b in bench:
        g = cut.findall((b or "").translate({c: c + 32 for c in range(65, 91)}))
        m = min(8, len(g))
        grams = {tuple(g[k : k + m]) for k in range(len(g) - m + 1)} if g and i is not None else set()
        gone |= {p + k for p in range(len(words) - m + 1) if m and tuple(words[p : p + m]) in grams for k in range(m)}
    if not gone:
        return t
    ends = [m.start() for m in w[1:]] + [len(t)]
    return t[: w[0].start()] + "".join(t[m.start() : e] for k, (m, e) in enumerate(zip(w, ends)) if k not in gone)


def test_pipeline_drops_near_copies(spark, odd, empty):
    import corpus_pipeline as p

    stage = dict(p.STAGES)["SimHash near-dedup"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept, want = plain_near(sorted(docs(spark, SF)))
    got = {r["doc_id"] for r in stage(spark, d, SF).collect()}
    assert got == want and len(want) < len(kept), (len(kept), len(want), got ^ want)
    assert stage(spark, odd, SF).columns == odd.columns and stage(spark, empty, SF).count() == 0


def test_whole_pipeline_against_plain(spark, odd, tmp_path):
    import corpus_pipeline as p
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.model_bytes())
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in queries.op8_quality_rules(spark, SMALL).where("kept").collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect() if r["doc_id"] in good]
    rows = list(plain_lines(rows))
    rows = [r for r in rows if r[0] in plain_near(sorted(rows))[1]]
    rows = [(i, plain_clean(t, bench)) for i, t in rows if plain_scan(t, bench)[2] < 2]
    got = p.run(spark, SMALL)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == {i for i, _ in rows} and len(rows) > 50
    for i, t in rows:
        ids = lib.encode(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids) and got[i]["decoded_sha256"] == sha(lib.decode(ids))
    for name, d in (("odd", odd), ("empty", odd.limit(0))):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SMALL}/{other}.parquet").limit(0 if name == "empty" else 1000).write.parquet(f"{tmp_path}/{name}/{other}.parquet")
        out = p.run(spark, f"{tmp_path}/{name}")
        last = [c for c in odd.columns if c != "text"] + ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
        assert out.columns == last and out.count() == 0 and all(plain_facts(t)[-1] for _, t, *_ in ODD)  # the base rule rejects every odd row
    now = odd
    for stage, (name, f) in enumerate(p.STAGES[1:]):  # so the later stages get them all
        now = p.written(f(spark, now, SMALL), name.replace(" ", "-"), p.tables_stored())
        assert now.columns == (last if stage == 3 else odd.columns)
    assert now.count() >= 5


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{SF}/documents.parquet").cache()
    one = p.quality_rules(spark, d, SF)
    kept = {r["doc_id"] for r in queries.op8_quality_rules(spark, SF).where("kept").collect()}
    assert one.columns == d.columns and {r["doc_id"] for r in one.collect()} == kept
    one = spark.createDataFrame(one.collect(), one.schema)
    two = p.line_dedup(spark, one, SF)
    assert two.columns == d.columns and two.count() == len(kept)
    rows = [(r["doc_id"], r["text"]) for r in two.collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    three = p.near_dedup(spark, spark.createDataFrame(two.collect(), two.schema), SF)
    assert {r["doc_id"] for r in three.collect()} == set(plain_components(prints))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    four = {r["doc_id"]: r["text"] for r in p.decontamination(spark, small, SMALL).collect()}
    for i, t in docs(spark, SMALL):
        n = plain_scan(t, bench)[2]
        assert (i in four) == (n < 2)
        if n == 0:
            assert four[i] == t
        elif n == 1:
            assert plain_scan(four[i], bench)[1] == 0


def test_quality_tokens_and_facts_of_odd_texts(spark):
    texts = ["".join(map(chr, range(128))), "a_b__c1 2\x1c\x1d\x0b..\n\n-", "é1ª²\u2028x\x85y_", "", None, "Aa aA 12a\x00\x7f!"]
    assert [quality.tokens_of(t) for t in texts] == [quality._TOKENS(t or "") for t in texts]
    rows = [(k, t) for k, t in enumerate(texts + ["rare1 rare1 rare2 known known", "known " * 9])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["x"] for r in quality.pool(d, quality.learn_vectors(d)).collect()}
    for k, t in rows:
        ts = quality._TOKENS(t or "")
        assert abs(got[k][quality.DIM + 1] - (len(set(ts)) / len(ts) if ts else 0)) < 1e-6, (k, got[k][quality.DIM + 1])


def test_quality_cuts_many_texts_at_once(spark):
    """Words, their counts and their neighbours' sums from whole lists of texts, as of one text after the other; sums too long for one packed addition too."""
    some = [t or "" for _, t in docs(spark, SMALL)][:60]
    texts = ["", "a b a", "\n\n", "é é1", "", "no " * 9000 + "yes", "🙂🙂 x퟿_", *some, ""]
    got = quality.cut(texts)
    want = [quality._TOKENS(t) for t in texts]
    assert got.lens.tolist() == [len(w) for w in want] and [got.names[k] for k in got.number.tolist()] == [x for w in want for x in w]
    assert dict(zip(got.names, got.n.tolist())) == Counter(x for w in want for x in w) and len(set(got.names)) == len(got.names)
    sums = quality.Sums(np.full(1, ~np.uint64(0)))  # lets all through
    sums.add(got)
    sums.add(quality.cut(texts[:3]))
    assert not len(quality.cut([]).number) and not len(quality.cut(["", " "]).number)
    index = {w: quality.index_vectors(np.array([quality.word_hash(w)], np.uint64))[0].astype(int) for w in got.names}
    own = {w: np.zeros(quality.DIM, int) for w in got.names}
    for w in want + want[:3]:
        for i, x in enumerate(w):
            for j in range(max(0, i - quality.REACH), min(len(w), i + quality.REACH + 1)):
                if j != i:
                    own[x] += index[w[j]]
    assert len(sums.at) == len(own)
    for w, k in sums.at.items():
        assert sums.own[k].tolist() == own[w].tolist(), w
