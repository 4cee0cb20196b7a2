import random

from wakegraph.operators.traverse import bfs, closure, shortest_chains

EDGES = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "c"), ("a", "d"), ("d", "c"), ("c", "e"), (None, "x")] + [(f"x{i}", f"x{i + 1}") for i in range(12)]


def frames(spark, seeds, edges=EDGES):
    return spark.createDataFrame([(s,) for s in seeds], "seed string"), spark.createDataFrame(edges, "src string, dst string")


def as_dict(df):
    return {(r.seed, r.node): r.dist for r in df.collect()}


def test_seed_inclusion_and_cycles(spark):
    s, e = frames(spark, ["a", "e", "zz", None, "a"])
    with_seed = as_dict(bfs(s, e, 6))
    assert with_seed == {("a", "a"): 0, ("a", "b"): 1, ("a", "d"): 1, ("a", "c"): 2, ("a", "e"): 3, ("e", "e"): 0, ("zz", "zz"): 0}
    trails = as_dict(bfs(s, e, 6, with_seed=False))
    assert trails == {("a", "b"): 1, ("a", "d"): 1, ("a", "a"): 2, ("a", "c"): 2, ("a", "e"): 3}


def test_self_loop_and_depth_clamp(spark):
    s, e = frames(spark, ["c", "x0"])
    assert as_dict(bfs(s, e, 1, with_seed=False)) == {("c", "c"): 1, ("c", "e"): 1, ("x0", "x1"): 1}
    assert max(d for (q, _), d in as_dict(bfs(s, e, 50)).items() if q == "x0") == 10


def test_backward(spark):
    s, e = frames(spark, ["c"])
    assert as_dict(bfs(s, e, 6, backward=True)) == {("c", "c"): 0, ("c", "b"): 1, ("c", "d"): 1, ("c", "a"): 2}


def test_empty(spark):
    s, e = frames(spark, [], [])
    assert bfs(s, e, 3).count() == 0


def test_shortest_chains(spark):
    random.seed(4)
    edges = [(str(random.randrange(30)), str(random.randrange(30))) for _ in range(60)]
    pairs = [(str(i), str(j)) for i in range(6) for j in range(30)]
    p = spark.createDataFrame(pairs, "src string, dst string")
    e = spark.createDataFrame(edges, "src string, dst string")
    got = {(r.src, r.dst): (r.length, r.chain) for r in shortest_chains(p, e, 8).collect()}
    links = set(edges)
    for i in range(6):
        dist, todo = {str(i): 0}, [str(i)]
        for n in todo:
            for a, b in links:
                if a == n and b not in dist:
                    dist[b] = dist[n] + 1
                    todo.append(b)
        want = {j: d for j, d in dist.items() if 0 < d <= 8}
        assert {j: v[0] for (s, j), v in got.items() if s == str(i)} == want
    for (s, d), (n, chain) in got.items():
        assert chain[0] == s and chain[-1] == d and len(chain) == n + 1 and all(x in links for x in zip(chain, chain[1:]))


def test_closure_takes_least_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in closure(links).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "a"): 2, ("b", "a"): 2, ("c", "b"): 2, ("c", "c"): 2, ("b", "b"): 3}
