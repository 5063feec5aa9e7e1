"""Ordered walks and reachability labels on chains and random graphs against plain versions."""

import random

import pytest

from tracewright.operators import checks, graph


def tables(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "label string"), spark.createDataFrame(edges, "src string, dst string")


def chains_and_branches(rng, n):
    """Mostly chains, some nodes with several dependencies."""
    names = [f"n{k:04d}" for k in range(n)]
    edges = set()
    for k in range(1, n):
        if rng.random() < 0.1:
            edges |= {(names[rng.randrange(k)], names[k]) for _ in range(rng.randrange(2, 4))}
        elif rng.random() < 0.95:
            edges.add((names[k - 1 if rng.random() < 0.8 else rng.randrange(k)], names[k]))
    return names, sorted(edges)


def above(names, edges):
    """label -> all that it depends on; names are in order."""
    out = {n: set() for n in names}
    for n in names:
        for a, b in edges:
            if b == n:
                out[n] |= out[a] | {a}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_accumulated_values_and_pairs_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    names, edges = chains_and_branches(rng, 120)
    nodes, table = tables(spark, names, edges)
    weight = {n: rng.randrange(9) for n in names}
    most, ways = {}, {}
    for n in names:
        into = [a for a, b in edges if b == n]
        most[n] = weight[n] + max((most[a] for a in into), default=0)
        ways[n] = weight[n] + sum(ways[a] for a in into)
    weighed = spark.createDataFrame(list(weight.items()), "label string, w long")
    found = {r.label: r for r in graph.accumulate(weighed, table).collect()}
    assert {n: r.value for n, r in found.items()} == most
    assert all(r.previous == min((a for a, b in edges if b == n), key=lambda a: (-most[a], a), default=None) for n, r in found.items())
    assert {r.label: r.value for r in graph.accumulate(weighed, table, "sum").collect()} == ways
    reach = above(names, edges)
    asked = [tuple(rng.sample(names, 2)) for _ in range(400)]
    got = checks.ancestors(nodes, table, spark.createDataFrame(asked, "a string, b string")).collect()
    assert {tuple(r) for r in got} == {(a, b) for x, y in asked for a, b in ((x, y), (y, x)) if a in reach[b]}


def test_a_long_chain(spark, monkeypatch):
    rounds, real = [], graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, label: (rounds.append(label), real(df, label))[1])
    names = [f"n{k:04d}" for k in range(2_000)]
    nodes, edges = tables(spark, names, list(zip(names, names[1:], strict=False)))
    assert {r.label: r.level for r in graph.levels(nodes, edges).collect()} == {n: k for k, n in enumerate(names)}
    assert len(rounds) < 25
    rng = random.Random(3)
    asked = [tuple(rng.sample(names, 2)) for _ in range(10_000)]
    got = {tuple(r) for r in checks.ancestors(nodes, edges, spark.createDataFrame(asked, "a string, b string")).collect()}
    assert got == {(min(p), max(p)) for p in asked}


def test_pairs_in_a_graph_with_a_cycle(spark):
    nodes, edges = tables(spark, "abcd", [("a", "b"), ("b", "a"), ("b", "c")])
    got = checks.ancestors(nodes, edges, spark.createDataFrame([("a", "c"), ("c", "d"), ("a", "b")], "a string, b string")).collect()
    assert {tuple(r) for r in got} == {("a", "c"), ("a", "b"), ("b", "a")}
    with pytest.raises(graph.GraphError):
        graph.levels(nodes, edges)


@pytest.mark.parametrize("turned", [False, True])
def test_loose_ends_get_no_labels(spark, monkeypatch, turned):
    """Node k needs k div 2 and k div 3, or the other way round; only pairs of small numbers depend on each other."""
    labelled, real = [], checks.stage

    def watched(df, label):
        out = real(df, label)
        if label == "order-labels":
            labelled.append(out.count())
        return out

    monkeypatch.setattr(checks, "stage", watched)
    monkeypatch.setattr(checks, "FEW_BETWEEN", 0, raising=False)
    n = 600
    names = [f"n{k:04d}" for k in range(n)]
    edges = sorted({(names[d], names[k]) for k in range(2, n) for d in (k // 2, k // 3)})
    asked = [(names[k], names[k + d]) for k in range(n - 30) for d in (1, 7, 30)]
    reach = {}
    for k, name in enumerate(names):
        reach[name] = set().union(*({names[d]} | reach[names[d]] for d in ({k // 2, k // 3} if k > 1 else ())))
    ordered = {(a, b) for a, b in asked if a in reach[b]}
    assert len(ordered) > 10
    if turned:
        edges, ordered = [(b, a) for a, b in edges], {(b, a) for a, b in ordered}
    nodes, table = tables(spark, names, edges)
    got = checks.ancestors(nodes, table, spark.createDataFrame(asked, "a string, b string")).collect()
    assert {tuple(r) for r in got} == ordered
    assert len(got) == len(ordered)
    assert labelled[0] < 200


@pytest.mark.parametrize("seed", [5])
def test_pairs_after_many_cuts_on_random_graphs(spark, monkeypatch, seed):
    monkeypatch.setattr(checks, "FEW_BETWEEN", 0)
    rng = random.Random(seed)
    names, edges = chains_and_branches(rng, 100)
    reach = above(names, edges)
    asked = [tuple(rng.sample(names, 2)) for _ in range(8)] + [(names[3], "lost")]
    nodes, table = tables(spark, names, edges)
    pairs = spark.createDataFrame(asked, "a string, b string")
    expected = {(a, b) for x, y in asked for a, b in ((x, y), (y, x)) if a in reach.get(b, ())}
    assert {tuple(r) for r in checks.ancestors(nodes, table, pairs).collect()} == expected
    # A ring off all ways between the pairs goes with the loose ends or is walked; the answer is the same.
    nodes, table = tables(spark, [*names, "r1", "r2"], [*edges, ("r1", "r2"), ("r2", "r1"), (names[-1], "r1")])
    assert {tuple(r) for r in checks.ancestors(nodes, table, pairs).collect()} == expected


def test_pairs_of_which_none_can_be_ordered(spark):
    nodes, edges = tables(spark, "abcd", [("a", "b"), ("a", "c")])
    assert checks.ancestors(nodes, edges, spark.createDataFrame([("b", "c"), ("c", "d")], "a string, b string")).collect() == []
