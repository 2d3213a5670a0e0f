"""Decision events and superseded records against plain versions."""

import random
import re
import time

from graphweft.operators import decisions as Q

R = "path string, title string, type string, status string"


def plain(records, least):
    own = {}
    for path, title, kind, status in records:
        if path is not None:
            row = (title or "", (kind or "").strip().lower(), status or "")
            own[path] = min(own.get(path, row), row)
    first = lambda s: (re.findall("[a-z]+", s.lower()) or [""])[0]
    words = {p: {t for t in re.findall("[a-z0-9]+", r[0].lower()) if len(t) >= 4 and t not in Q.PLAIN} for p, r in own.items()}
    out = {}
    for p, (_, kind, _) in own.items():
        met = [(-len(words[p] & words[q]), q) for q, (_, k, s) in own.items() if q != p and first(s) == "accepted" and (not kind or not k or k == kind) and len(words[p] & words[q]) >= least]
        if met:
            out[p] = (min(met)[1], -min(met)[0])
    return out


def test_candidates_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["service", "component", *(f"word{i}" for i in range(12)), "the", "with", "über"]
    made = []
    for i in range(160):
        title = " ".join(rng.choices(vocabulary[:2] if rng.random() < 0.3 else vocabulary, k=rng.choice([0, 1, 2, 3, 5, 9, 14])))
        made.append((f"docs/{rng.randrange(140):03d}.md", title, rng.choice(["", "A", " a", "B", None]), rng.choice(["Accepted", "accepted (auto)", "Superseded", "", None])))
    made += [(None, "service component", "", "Accepted"), ("docs/x.md", None, None, None), ("docs/y.md", "Word1! WORD2?", "c", "**Accepted**"), ("docs/z.md", "word1-word2", "C", "accepted")]
    df = spark.createDataFrame([(*r, "kept out") for r in made], R + ", candidate string")
    for least, most in ((2, 8), (2, 3), (1, 2), (3, 20)):
        got = {r["path"]: (r["candidate"], r["overlap"]) for r in Q.superseded_candidates(df, least, most if most < 20 else 10).collect()}
        assert got == plain(made, least), (least, most)
    assert Q.superseded_candidates(df.limit(0)).count() == 0


def test_events_take_the_first_kind_in_the_whole_log(spark):
    long = "x " * 50_000
    logs = [(1, long + "Split the MODULE"), (2, "split"), (3, None), (4, ""), (5, "fix a cycle in the schema"), (6, "fix a cycle"), (7, "add a cycle"), (8, "boundary violation"), (9, "layers violated"), (10, "new package"), (11, "API removed"), (12, "jwt auth"), (12, "jwt auth")]
    got = Q.decision_events(spark.createDataFrame([(i, t, "old") for i, t in logs], "id int, log string, title string"))
    assert got.columns == ["id", "log", "title", "type", "context"]
    kinds = sorted((r["id"], r["type"]) for r in got.collect())
    assert kinds == [(1, "COMPONENT_SPLIT"), (5, "NEW_DATABASE_LAYER"), (6, "CYCLE_RESOLVED"), (7, "CYCLE_INTRODUCED"), (8, "LAYER_VIOLATION"), (9, "LAYER_VIOLATION"), (10, "NEW_SUBSYSTEM"), (11, "INTERFACE_CHANGED"), (12, "AUTH_ARCHITECTURE"), (12, "AUTH_ARCHITECTURE")]
    assert Q.decision_events(got.drop("type", "context").limit(0)).count() == 0


def test_long_titles_that_share_words_make_no_pairs(spark):
    """4,000 titles of twelve words, nine of them common to all, ten to each pair: as pairs on a prefix these would be 128 million rows."""
    common = " ".join(f"common{c}" for c in "abcdefghi")
    made = [(f"docs/{i:04d}.md", f"{common} both{i // 2} own{i:04d} self{i:04d}", "", "Accepted") for i in range(4000)]
    began = time.time()
    got = {(r["path"], r["candidate"], r["overlap"]) for r in Q.superseded_candidates(spark.createDataFrame(made, R)).collect()}
    assert time.time() - began < 100
    assert got == {(f"docs/{i:04d}.md", f"docs/{i ^ 1:04d}.md", 10 if len(f"both{i // 2}") >= 4 else 9) for i in range(4000)}


def test_no_table_of_titles_passes_the_driver(spark, monkeypatch):
    """Joins are left to no estimate: without the few sets that may be broadcast, no plan has a broadcast, and candidates are the same."""
    rng = random.Random(5)
    made = [(f"docs/{i:03d}.md", " ".join(f"word{rng.randrange(12)}" for _ in range(rng.choice([2, 5, 18, 40]))), rng.choice(["", "A"]), "Accepted") for i in range(60)]
    plans, store = [], Q.settled

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label)

    monkeypatch.setattr(Q, "settled", seen)
    monkeypatch.setattr(Q, "FEW_SETS", 0, raising=False)
    told = Q.superseded_candidates(spark.createDataFrame(made, R), 2, 8)
    plans.append(told._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]
    assert {r["path"]: (r["candidate"], r["overlap"]) for r in told.collect()} == plain(made, 2)
