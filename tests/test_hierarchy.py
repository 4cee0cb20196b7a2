import random

import pytest
from pyspark.sql import functions as F

from wakegraph.operators.hierarchy import Hierarchy, cycles, links
from wakegraph.session import Workspace

SCHEMA = "c string, p string, node string, level int, child string"


def frame(spark, pairs):
    return links(spark.createDataFrame([(a, b, "n", 0, "x") for a, b in pairs], SCHEMA), "c", "p")


def reach(pairs):
    """node -> all it reaches over links from child to parent"""
    up = {}
    for a, b in pairs:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
            up.setdefault(b, set())
    out = {}
    for n in up:
        seen, todo = set(), [n]
        while todo:
            for m in up[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[n] = seen
    return out


def random_graph(seed):
    random.seed(seed)
    nodes = [f"n{i:02}" for i in range(26)]
    pairs = [(random.choice(nodes), random.choice(nodes)) for _ in range(24)]
    pairs += [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(9)] + [("chain09", nodes[0]), ("self", "self"), (None, "a"), ("a", None), ("chain00", "chain01")]
    return pairs + [(f"leaf{i}", "hub") for i in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_descendants(spark, seed):
    pairs = random_graph(seed)
    up = reach(pairs)
    want = {n: min([m for m in up[n] if n in up[m]]) for n in up if n in up[n]}
    assert {r.node: r.cycle for r in cycles(frame(spark, pairs)).collect()} == want
    h = Hierarchy(frame(spark, pairs))
    got = {(r.ancestor, r.descendant) for r in h.descendants().collect()}
    assert got == {(a, n) for n in up for a in up[n]}
    rows = {r.node: r for r in h.summary().collect()}
    assert set(rows) == set(up)
    for n, r in rows.items():
        assert r.n_descendants == sum(n in up[m] for m in up)
        assert r.on_cycle == (n in want)
        parts = r.path.split("/")
        assert r.depth == len(parts) - 1 and parts[0] == r.root and parts[-1] == want.get(n, n)
        for low, high in zip(parts[1:], parts):
            assert high in up[low]
        top = want.get(r.root)
        assert all(m in up and up[m] and want.get(m) == top for m in up[r.root]) if top else not up[r.root]


def test_no_links_and_single_links(spark):
    assert cycles(frame(spark, [])).count() == 0
    h = Hierarchy(frame(spark, []))
    assert h.descendants().count() == 0 and h.summary().count() == 0
    h = Hierarchy(frame(spark, [("a/b", "b"), ("a/b", "b")]))
    assert [tuple(r) for r in h.descendants().collect()] == [("b", "a/b")]
    assert {(r.node, r.root, r.depth) for r in h.paths().collect()} == {("a/b", "b", 1), ("b", "b", 0)}


def test_between_cycles(spark):
    """A node of least name on the way from one cycle to another is on none."""
    pairs = [("m", "n"), ("n", "m"), ("n", "a"), ("a", "x"), ("x", "y"), ("y", "x"), ("y", "b"), ("b", "b"), ("b", "c"), ("c", "p"), ("p", "c")]
    assert {r.node: r.cycle for r in cycles(frame(spark, pairs)).collect()} == {"m": "m", "n": "m", "x": "x", "y": "x", "b": "b", "c": "c", "p": "c"}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_of_random_graphs(spark, seed):
    random.seed(100 + seed)
    pairs = [(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(36)]
    up = reach(pairs)
    assert {r.node: r.cycle for r in cycles(frame(spark, pairs)).collect()} == {n: min(m for m in up[n] if n in up[m]) for n in up if n in up[n]}


def test_only_a_cycle(spark):
    h = Hierarchy(frame(spark, [("a", "b"), ("b", "c"), ("c", "a")]))
    assert {r.node: r.cycle for r in h.cycles.collect()} == dict.fromkeys("abc", "a")
    assert h.descendants().count() == 9
    assert {r.n_descendants for r in h.summary().collect()} == {3}


def test_a_star_on_a_cycle(spark):
    """A million children of one node that is on a cycle, one of them with a child of its own."""
    star = spark.range(1_000_000).select(F.concat(F.lit("leaf"), "id").alias("child"), F.lit("hub").alias("parent"))
    edges = star.unionByName(spark.createDataFrame([("hub", "x"), ("x", "y"), ("y", "hub"), ("below", "leaf7"), ("x", "top")], "child string, parent string"))
    assert {r.node: r.cycle for r in cycles(edges).collect()} == dict.fromkeys(["hub", "x", "y"], "hub")


def test_long_runs_take_few_rounds(spark):
    """A ring of 500, with a tail of 500 below and above, and a second ring at its end."""
    n = 500
    pairs = [(f"r{i:03}", f"r{(i + 1) % n:03}") for i in range(n)] + [(f"t{i:03}", f"t{i + 1:03}") for i in range(n)] + [(f"t{n:03}", "r007"), ("r100", "u000")]
    pairs += [(f"u{i:03}", f"u{i + 1:03}") for i in range(n)] + [(f"u{n:03}", "s0"), ("s0", "s1"), ("s1", "s0")]
    edges = frame(spark, pairs)
    space = Workspace(spark)
    written = []
    put = space.put
    space.put = lambda df, *by: written.append(1) or put(df, *by)
    found = {r.node: r.cycle for r in cycles(edges, space).collect()}
    assert found == {f"r{i:03}": "r000" for i in range(n)} | {"s0": "s0", "s1": "s0"}
    assert len(written) < 150


def test_levels_of_a_deep_tree(spark):
    pairs = [(f"a{i:02}", f"a{i + 1:02}") for i in range(30)] + [("b", "a20"), ("b", "c"), ("c", "a20"), ("d", "a30")]
    h = Hierarchy(frame(spark, pairs))
    levels = {r.vertex: r.level for r in h.levels.collect()}
    assert levels == {f"a{i:02}": i for i in range(31)} | {"b": 0, "c": 1, "d": 0}
