"""Bounded traversals over edge tables: breadth first, one distinct (seed, node) a hop, never a path too many.

Work is bounded by nodes: each hop joins the frontier with the edges and drops what has been visited. The hops are
written to the shared folder, so that plans stay short and a lost executor costs one hop at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakegraph.session import Workspace

MAX_DEPTH = 10


def clamp_depth(depth: int) -> int:
    return max(1, min(MAX_DEPTH, depth))


def edges_of(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Distinct (src, dst) without null ends."""
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def bfs(seeds: DataFrame, edges: DataFrame, depth: int, backward: bool = False, with_seed: bool = True) -> DataFrame:
    """(seed, node, dist) of what is reached in at most `depth` hops, with the least distance.

    seeds: seed (nulls dropped, repeats count once); edges: src, dst. with_seed=True starts at distance 0 with the seed
    itself; False asks for trails of at least one edge, so that a seed is reached only over a cycle. A seed without
    edges is reached by itself or by nothing. Empty seeds or edges give no hops.
    """
    space = Workspace(seeds.sparkSession)
    hop_edges = edges.select(F.col("dst").alias("at"), F.col("src").alias("to")) if backward else edges.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    hop_edges = space.put(hop_edges)
    start = seeds.select("seed").where("seed is not null").distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist"))
    frontier = space.put(start)
    visited = frontier if with_seed else frontier.limit(0)
    for hop in range(1, clamp_depth(depth) + 1):
        reached = frontier.select("seed", F.col("node").alias("at")).join(hop_edges, "at").select("seed", F.col("to").alias("node")).distinct()
        frontier, seen = space.put_seen(reached.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("dist", F.lit(hop)), any=F.lit(True))
        if not seen["any"]:
            break
        visited = visited.unionByName(frontier)
    return visited


def shortest_chains(pairs: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(src, dst, length, chain) of the pairs that hang together over at most max_hops edges.

    pairs: src, dst (equal ends dropped); edges: src, dst. chain has all nodes from src to dst, the least by node names
    from the end among equally short ones. Only the predecessor of each (source, node) is kept on the way; chains are
    read back from the ends.
    """
    space = Workspace(pairs.sparkSession)
    wanted = space.put(pairs.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    hop_edges = space.put(edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    frontier = space.put(wanted.select(F.col("src").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(None).cast("string").alias("before"), F.lit(0).alias("dist")))
    visited = frontier
    open_ = wanted
    for hop in range(1, max_hops + 1):
        live = frontier.join(open_.select(F.col("src").alias("seed")).distinct(), "seed", "left_semi")
        reached = live.select("seed", F.col("node").alias("at")).join(hop_edges, "at").groupBy("seed", F.col("to").alias("node")).agg(F.min("at").alias("before"))
        frontier = space.put(reached.join(visited.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("dist", F.lit(hop)).select("seed", "node", "before", "dist"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        open_ = space.put(open_.join(frontier.select(F.col("seed").alias("src"), F.col("node").alias("dst")), ["src", "dst"], "left_anti"))
        if open_.isEmpty():
            break
    tree = space.put(visited)
    ends = wanted.join(tree.select(F.col("seed").alias("src"), F.col("node").alias("dst"), "before", "dist"), ["src", "dst"])
    chains = space.put(ends.select("src", "dst", F.col("dist").alias("length"), "before", F.array("dst").alias("chain")))
    while not chains.where("before is not null").isEmpty():
        step = tree.select(F.col("seed").alias("src"), F.col("node").alias("before"), F.col("before").alias("further"))
        chains = space.put(
            chains.join(step, ["src", "before"], "left")
            .select("src", "dst", "length", F.col("further").alias("before"), F.when(F.col("before").isNull(), F.col("chain")).otherwise(F.concat(F.array("before"), "chain")).alias("chain"))
        )
    return chains.select("src", "dst", "length", "chain")


def chain_types(chains: DataFrame, edges: DataFrame) -> DataFrame:
    """chains(src, dst, chain) with `types`, the types of the edges between neighbours; edges: src, dst, etype."""
    steps = chains.select("src", "dst", F.posexplode(F.arrays_zip(F.slice("chain", F.lit(1), F.size("chain") - 1).alias("a"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("b"))).alias("n", "e"))
    typed = steps.select("src", "dst", "n", F.col("e.a").alias("a"), F.col("e.b").alias("b")).join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "etype"), ["a", "b"])
    # a chain is no longer than the hops it was looked for
    listed = typed.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "etype"))), lambda x: x["etype"]).alias("types"))
    return chains.join(listed, ["src", "dst"])


def closure(links: DataFrame) -> DataFrame:
    """(child, ancestor, depth) over (child, parent) links, cycle-safe, each pair with its least depth.

    Depths double: a shortest way of k + r steps leads in k steps to a node at exactly that depth, and on from there in
    r <= k, so each round joins the pairs at depth k with all that are known. The rounds end when one adds nothing.
    """
    space = Workspace(links.sparkSession)
    known = space.put(links.select("child", F.col("parent").alias("ancestor")).where("child is not null and ancestor is not null").distinct().withColumn("depth", F.lit(1)))
    k = 1
    while True:
        half = known.where(F.col("depth") == k).select("child", F.col("ancestor").alias("mid"))
        rest = known.select(F.col("child").alias("mid"), "ancestor", F.col("depth").alias("r"))
        reached = half.join(rest, "mid").groupBy("child", "ancestor").agg((F.min("r") + k).alias("depth"))
        new, seen = space.put_seen(reached.join(known.select("child", "ancestor"), ["child", "ancestor"], "left_anti"), any=F.lit(True))
        if not seen["any"]:
            break
        known, k = known.unionByName(new), 2 * k
    return known


def collected(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Distinct values of a key as one text, sorted, `,` between."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))


def instantiators(types: DataFrame, calls: DataFrame, sent: DataFrame, urls: DataFrame) -> DataFrame:
    """(class_fqn, maker, n_notifications, n_urls, n_callers): methods that call a constructor of the types.

    types: class_fqn; calls: src, dst, distinct; sent: src, dst (notifications); urls: src, url. Each count is grouped
    by method before it is joined.
    """
    from wakegraph.functions.names import method_owner, method_simple

    made = calls.select(F.col("src").alias("maker"), method_owner(F.col("dst")).alias("class_fqn"), method_simple(F.col("dst")).alias("called")).where("called = '<init>'")
    made = made.join(types.select("class_fqn").distinct(), "class_fqn", "left_semi").select("class_fqn", "maker").distinct()
    counts = {
        "n_notifications": sent.groupBy(F.col("src").alias("maker")).agg(F.count_distinct("dst").alias("n_notifications")),
        "n_urls": urls.groupBy(F.col("src").alias("maker")).agg(F.count_distinct("url").alias("n_urls")),
        "n_callers": calls.groupBy(F.col("dst").alias("maker")).agg(F.count(F.lit(1)).alias("n_callers")),
    }
    for name, df in counts.items():
        made = made.join(df, "maker", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return made.select("class_fqn", "maker", *counts)
