"""Parts of one JSON document cut by many tasks, against json.loads."""

import json
import random

import pytest

from graphweft.sources import documents as D
from graphweft.sources import scan

NODES = [{"id": f"n{i}", "name": ['plain', 'a "quoted} , {" one', "back\\slash\\\\", "ünï[code]:", "}\n{"][i % 5] + str(i), "properties": {"k}": "v" * (i % 7), "nodes": "x", "list": "[1,{}]"}} for i in range(120)]
EDGES = [{"source_id": f"n{i}", "target_id": f"n{i * 7 % 120}", "type": "CALLS"} for i in range(120)]


def put(folder, name, value, indent=None):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=indent, ensure_ascii=False), encoding="utf-8")
    return f"file://{path}"


@pytest.fixture
def small_blocks(spark):
    """Set how many bytes a block has."""
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def tasks_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    out = action()
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, sum(tracker.getStageInfo(s).numTasks for s in stages)


@pytest.mark.parametrize("size,indent", [(1 << 20, None), (2500, None), (61, 1)])
def test_parts_equal_the_document(spark, tmp_path, small_blocks, size, indent):
    n = 120 if size > 100 else 3
    doc = {"schema_version": 3, "other": {"nodes": [{"id": "no"}]}, "entrypoints": ["n1", "n}2", 'n"3,'], "nodes": NODES[:n], "skipped": [[{"id": 1}], []], "edges": EDGES[:n], "empty": []}
    path = put(tmp_path, "doc.json", doc, indent)
    small_blocks(size)
    for part in ("nodes", "edges", "skipped", "entrypoints", "empty", "missing"):
        got = [json.loads(r["element"]) for r in scan.elements(spark, path, part).collect()]
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted(map(key, got)) == sorted(map(key, doc.get(part, []))), part
    ids = {r["id"] for r in D.read_part(spark, path, "nodes", {"id": "string", "name": "string"}).collect()}
    assert ids == {x["id"] for x in doc["nodes"]}


def test_random_documents_and_cuts(spark, tmp_path, small_blocks):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return "".join(rng.choice('ab"\\{}[],: é\n') for _ in range(rng.randrange(9))) if kind else rng.choice([None, True, -1.5e3])
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {"".join(rng.choice('p"\\}:') for _ in range(3)) + str(i): value(depth - 1) for i in range(rng.randrange(4))}

    for k in range(3):
        doc = {f"k{j}": value(3) for j in range(3)} | {"nodes": [value(3) for _ in range(6)], "z": value(2)}
        small_blocks(rng.randrange(20, 90))
        path = put(tmp_path, f"{k}.json", doc, rng.choice([None, 2]))
        got = [json.loads(r["element"]) for r in scan.elements(spark, path, "nodes").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, doc["nodes"]))


def test_early_stops(spark, tmp_path, small_blocks):
    """Header and first part are told without the rest, which doesn't even parse; the number of tasks shows how far blocks were read."""
    text = json.dumps({"schema_version": 3, "commit_hash": "c", "version": 9, "entrypoints": ["a"], "nodes": NODES})[:-1] + ', "edges": [' + "{]]" * 20_000
    path = put(tmp_path, "doc.json", text)
    small_blocks(4000)
    blocks = -(-len(text.encode()) // 4000)
    got, tasks = tasks_of(spark, "header", lambda: D.read_header(spark, path))
    assert tuple(got.first()) == (3, "c", 9) and tasks == 1 and blocks > 10
    states, tasks = tasks_of(spark, "entries", lambda: scan.block_states(spark, path, "entrypoints"))
    assert list(states) == [0] and tasks == 1
    assert D.read_part(spark, path, "nodes", {"id": "string"}).count() == 120


def test_odd_documents(spark, tmp_path, small_blocks):
    assert scan.elements(spark, put(tmp_path, "empty.json", ""), "nodes").count() == 0
    assert scan.elements(spark, put(tmp_path, "none.json", "{}"), "nodes").count() == 0
    nodes = [{"id": "a"}, {"id": ""}, {"name": "no id"}, None, {"id": "b", "name": None}]
    assert [tuple(r) for r in D.read_part(spark, put(tmp_path, "ids.json", {"nodes": nodes}), "nodes", {"name": "string", "id": "string"}).collect()] == [(None, "a"), (None, "b")]
    twice = put(tmp_path, "twice.json", '{"nodes":[{"id":"a"}],"edges":[],"x":[' + '{"p":"' + "y" * 300 + '"},' * 1 + '{}],"nodes":[{"id":"b"}]}')
    small_blocks(50)
    assert {r["id"] for r in D.read_part(spark, twice, "nodes", {"id": "string"}, to_end=True).collect()} == {"a", "b"}
    late = put(tmp_path, "late.json", {"nodes": [{"id": "a"}], "version": 4, "schema_version": 3})
    assert tuple(D.read_header(spark, late).first()) == (3, None, 4)
    for bad in ("[1]", '{"nodes": {"a": {"id": "x"}}}', '{"nodes": [{"id": tru}]}'):
        with pytest.raises(Exception):
            D.read_part(spark, put(tmp_path, "bad.json", bad), "nodes", {"id": "string"}).collect()
