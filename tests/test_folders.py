"""Digests of folders against a plain recursion; delta planning against whole plans."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.workspaces import node, table
from tracewright.operators import folders, graph, incremental
from tracewright.sources.files import contents

FILES = "root string, path string, kind string, digest string, size long, executable boolean, target string"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def plain(rows):
    """{folder: (digest, files, bytes)} of one tree, by recursion over nested dicts."""
    top = {}
    for _, path, kind, digest, size, executable, target in set(rows):
        at = top
        steps = path.split("/") if path else []
        for step in steps if kind == "dir" else steps[:-1]:
            at = at.setdefault(step, {})
        if kind != "dir":
            at[steps[-1]] = (kind, digest, size, executable, target)
    out = {}

    def walk(folder, here):
        texts, n, total = {}, 0, 0
        for name, x in here.items():
            if isinstance(x, dict):
                d, k, b = walk(f"{folder}/{name}".lstrip("/"), x)
                text, n, total = f"dir {d} {name}", n + k, total + b
            elif x[0] == "link":
                text = f"link {sha(x[4] or '')} {name}"
            else:
                text, n, total = f"file {x[1]} {x[2] or 0} {'x' if x[3] else '-'} {name}", n + 1, total + (x[2] or 0)
            texts.setdefault(sha(name)[:2], []).append(text)
        out[folder] = (sha("\n".join(sha("\n".join(sorted(t))) for _, t in sorted(texts.items()))), n, total)
        return out[folder]

    walk("", top)
    return out


def tree(seed, n=300):
    r = random.Random(seed)
    rows = {}
    for k in range(n):
        folder = "/".join(f"d{r.randrange(3)}" for _ in range(r.randrange(6)))
        path = f"{folder}/f{k}ä b".lstrip("/")
        kind = r.choice(["file"] * 6 + ["link", "dir"])
        rows[path] = ("t", path, kind, sha(str(k)) if kind == "file" else None, r.choice([None, r.randrange(99)]), r.choice([None, True, False]), "../x" if kind == "link" else None)
    return list(rows.values())


def got(spark, rows):
    return {(r.root, r.folder): (r.digest, r.files, r.bytes) for r in folders.folder_digests(spark.createDataFrame(rows, FILES)).collect()}


def test_folders_against_recursion(spark):
    one, two = tree(1), [("u", *r[1:]) for r in tree(2)]
    want = {("t", k): v for k, v in plain(one).items()} | {("u", k): v for k, v in plain(two).items()}
    assert got(spark, one + two + one[:50]) == want  # repeated rows count once


def test_a_changed_file_changes_what_holds_it(spark):
    rows = tree(3)
    at = next(k for k, r in enumerate(rows) if r[2] == "file" and r[1].count("/") == 4)
    other = [*rows[:at], (*rows[at][:3], sha("changed"), *rows[at][4:]), *rows[at + 1 :]]
    before, after = (folders.folder_digests(spark.createDataFrame(x, FILES)) for x in (rows, other))
    steps = rows[at][1].split("/")[:-1]
    above = {"/".join(steps[:k]) for k in range(len(steps) + 1)}
    assert {(r.folder, r.change) for r in folders.changed_folders(before, after).collect()} == {(f, "changed") for f in above}
    fewer = folders.folder_digests(spark.createDataFrame([r for r in rows if not r[1].startswith("d0/")], FILES))
    assert {r.folder.split("/")[0] for r in folders.changed_folders(before, fewer).where("change = 'removed'").collect()} == {"d0"}


def test_folders_of_edge_cases(spark):
    empty = spark.createDataFrame([], FILES)
    assert folders.folder_digests(empty).count() == 0
    assert got(spark, [("t", None, "dir", None, None, None, None)]) == {("t", ""): (sha(""), 0, 0)}
    assert got(spark, [("t", "./a//b", "file", "d", 1, False, None)]) == {("t", k): v for k, v in plain([("t", "a/b", "file", "d", 1, False, None)]).items()}
    with pytest.raises(Exception, match="two unlike entries"):
        got(spark, [("t", "a", "file", "d", 1, False, None), ("t", "a", "file", "e", 1, False, None)])
    with pytest.raises(Exception, match="no digest for a"):
        got(spark, [("t", "a", "file", None, 1, False, None)])


def test_written_folders(spark, tmp_path):
    rows = []
    for path in ("out/a.txt", "out/sub/b.txt", "out/sub/c.txt", "bin.sh"):
        os.makedirs(tmp_path / os.path.dirname(path), exist_ok=True)
        (tmp_path / path).write_text(path * 3)
        rows.append(("", path, "file", sha(path * 3), len(path) * 3, False, None))
    files = folders.files_of(contents(spark, str(tmp_path)), F.lit("t"))
    inner = [(r[0], r[1].removeprefix("out/"), *r[2:]) for r in rows if r[1].startswith("out/")]
    tree_of, whole = plain(inner)[""][0], plain(rows)[""][0]
    outs = [("dir", "out"), ("file", "bin.sh")]
    nodes = [
        node("//:t", tags=["no-cache"], outputs=[{"type": t, "identifier": i} for t, i in outs]), node("//out:u", tags=["no-cache"], outputs=[{"type": "dir", "identifier": ".."}]),
        node("//out:b", tags=["no-cache"], bin_output={"type": "file", "identifier": "a.txt"}), node("//:c", outputs=[{"type": "dir", "identifier": "nowhere"}]), node("//:n", tags=["no-cache"]),
    ]
    hashes = {r.label: r.output_hash for r in folders.no_cache_hashes(table(spark, nodes), files).collect()}
    assert hashes == {"//:t": sha(",".join(sorted([tree_of, sha("bin.sh" * 3)]))), "//out:u": sha(whole), "//out:b": sha(sha("out/a.txt" * 3))}
    lost = table(spark, [node("//:t", tags=["no-cache"], outputs=[{"type": "dir", "identifier": "gone"}])])
    with pytest.raises(Exception, match="output gone of //:t is not there"):
        folders.no_cache_hashes(lost, files).collect()


def test_delta_equals_a_whole_plan(spark):
    r = random.Random(5)
    names = [f"//:t{k:02d}" for k in range(24)]
    nodes = table(spark, [node(x, inputs=["f"], dependencies=r.sample(names[:k], min(k, r.randrange(3))), tags=["no-cache"] if k % 11 == 5 else []) for k, x in enumerate(names)])
    edges = graph.edges_of(nodes)
    pairs = lambda d, column: spark.createDataFrame(list(d.items()), f"label string, {column} string")
    content, made = {x: "c" for x in names}, {x: sha(x) for x in names if r.random() < 0.8}
    none = spark.createDataFrame([], "change_hash string, output_hash string")
    before = incremental.plan_builds(nodes, edges, pairs(content, "content_hash"), none, pairs(made, "output_hash"))
    touched = r.sample(names, 4)
    content |= dict.fromkeys(touched, "d")
    made |= {x: sha(x + "2") for x in touched[:2]}
    cache = before.select("change_hash", "output_hash")
    whole = incremental.plan_builds(nodes, edges, pairs(content, "content_hash"), cache, pairs(made, "output_hash"))
    changed = spark.createDataFrame([(x,) for x in touched], "label string")
    delta = incremental.plan_delta(nodes, edges, before, changed, pairs(content, "content_hash"), cache, pairs(made, "output_hash"))
    columns = ["label", "level", "change_hash", "output_hash"]
    want = sorted(map(tuple, whole.select(*columns).collect()))
    assert sorted(map(tuple, incremental.merged_plan(before, delta).select(*columns).collect())) == want
    hits = {x.label: x.hit for x in whole.collect()}
    visited = {x.label: x for x in delta.collect()}
    assert all(hits[x] == v.hit for x, v in visited.items())
    moved = {x for x, v in visited.items() if v.output_hash != v.was}
    reached = {e.dst for e in edges.collect() if e.src in moved}
    assert set(visited) == set(touched) | reached  # nobody else is visited
    assert incremental.plan_delta(nodes, edges, before, changed.limit(0), pairs(content, "content_hash"), cache, pairs(made, "output_hash")).count() == 0
