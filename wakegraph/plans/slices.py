"""Slices around changed methods: entry points, schedules, tables, risk, coverage and their summary.

Each takes a reach (seed, node, dist) of traverse.bfs and the edge tables it needs, and gives rows per seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entry_points(reach: DataFrame, methods: DataFrame, method_urls: DataFrame, class_urls: DataFrame) -> DataFrame:
    """(seed, entry, owner, urls): nodes that expose a URL themselves; class URLs before method URLs, each sorted.

    A method is an entry point by its own URLs only; those of its class are listed with it. Seeds without entry points
    don't come out here; a left join brings them back.
    """
    own = method_urls.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("url")).alias("__own"))
    of_class = class_urls.groupBy(F.col("class_fqn").alias("owner")).agg(F.array_sort(F.collect_set("url")).alias("__class"))
    none = F.array().cast("array<string>")
    return (
        reach.select("seed", "node").join(own, "node").join(methods.select(F.col("fqn").alias("node"), "owner"), "node", "left").join(of_class, "owner", "left")
        .select("seed", F.col("node").alias("entry"), "owner", F.array_join(F.concat(F.coalesce("__class", none), "__own"), " ").alias("urls"))
    )


def schedule_points(reach: DataFrame, method_tasks: DataFrame) -> DataFrame:
    """(seed, entry, task): methods among the reached that a task runs."""
    return reach.select("seed", "node").join(method_tasks.withColumnRenamed("src", "node"), "node").select("seed", F.col("node").alias("entry"), "task").distinct()


def tables_reached(reach: DataFrame, access: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, reads, writes): sorted table names, `,` between; every seed comes out."""
    hits = reach.select("seed", "node").join(access.withColumnRenamed("src", "node"), "node")
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("access") == kind, F.col("name")))), ",")
    grouped = hits.groupBy("seed").agg(names("READS_TABLE").alias("reads"), names("WRITES_TABLE").alias("writes"))
    return seeds.join(grouped, "seed", "left").select("seed", F.coalesce("reads", F.lit("")).alias("reads"), F.coalesce("writes", F.lit("")).alias("writes"))


def risk(reach: DataFrame, method_urls: DataFrame, method_tasks: DataFrame, methods: DataFrame, sensitive: tuple[str, ...]) -> DataFrame:
    """(fqn, entry_count, sensitive, risk) of every seed that is a method.

    reach is backward over trails of at least one edge. HIGH for more than 5 entry points or a sensitive owner, MEDIUM
    for more than 1, else LOW. A null owner makes sensitive null, which isn't HIGH.
    """
    roots = method_urls.select(F.col("src").alias("node")).union(method_tasks.select(F.col("src").alias("node"))).distinct()
    counts = reach.select("seed", "node").join(roots, "node", "left_semi").groupBy("seed").agg(F.count_distinct("node").alias("n"))
    seeds = methods.select(F.col("fqn").alias("seed"), "owner")
    marked = F.lit(False)
    for part in sensitive:
        marked = marked | F.col("owner").contains(part)
    graded = seeds.join(counts, "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("entry_count"), marked.alias("sensitive"))
    level = F.when((F.col("entry_count") > 5) | F.col("sensitive"), "HIGH").when(F.col("entry_count") > 1, "MEDIUM").otherwise("LOW")
    return graded.select(F.col("seed").alias("fqn"), "entry_count", "sensitive", level.alias("risk"))


def covering_tests(reach: DataFrame, covers: DataFrame) -> DataFrame:
    """(seed, test_id, confidence, hits): tests of the reached methods, greatest confidence, distinct methods hit."""
    hits = reach.select("seed", "node").join(covers.select(F.col("key").alias("node"), "test_id", "confidence"), "node")
    return hits.groupBy("seed", "test_id").agg(F.max("confidence").alias("confidence"), F.count_distinct("node").alias("hits"))


def coverage_gaps(reach: DataFrame, covers: DataFrame, roots: DataFrame) -> DataFrame:
    """(uncovered, n_changed): roots that changed methods reach and no test covers."""
    hit = reach.select("seed", "node").join(roots.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return hit.join(covers.select(F.col("key").alias("node")).distinct(), "node", "left_anti").groupBy(F.col("node").alias("uncovered")).agg(F.count_distinct("seed").alias("n_changed"))
