"""Queries that take the whole of their tables, and operators without a bound of their own."""

import os

import pytest
from pyspark.sql import functions as F

from tests.harness import DATA
from wakegraph.operators import merge
from wakegraph.operators.traverse import closure
from wakegraph.plans import tagging
from wakegraph.queries import all_queries

BASE = f"{DATA}/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables here")


@tables
def test_rekeying_takes_every_part_and_meets_both_branches(spark):
    moved = all_queries()["rekey_constants"](spark, BASE).join(spark.read.parquet(f"{BASE}/orders.parquet").select(F.col("o_orderkey").alias("src"), "o_custkey"), "src")
    unique = moved.where(F.col("dst").contains("Constants."))
    assert unique.where("o_custkey % 7 >= 2").count() > 0
    sizes = spark.read.parquet(f"{BASE}/part.parquet").select(F.col("p_size").alias("o_custkey")).distinct()
    assert moved.where("dst = cast(o_custkey as string)").join(sizes, "o_custkey").count() > 0


def test_urls_are_found_anywhere_in_a_text(spark):
    texts = {1: "open p.Shop now", 2: "go to user-list", 3: "press Save.do", 4: "the renamedOrders", 5: "at /x/do it", 6: None, 7: "x.do /x/d o", 8: "p.$hop"}
    t = spark.createDataFrame(list(texts.items()), "test_id int, text string")
    u = spark.createDataFrame([(x,) for x in ("servlet:p.Shop", "/a/user-list", "/a/save.do", "/m/orders", "/x/do", "/b/shop/", "servlet:p.$hop", "servlet:a.b", None)], "url string")
    got = {(r.test_id, r.key) for r in tagging.url_substring_tags(t, u).collect()}
    assert got == {(1, "servlet:p.Shop"), (1, "/b/shop/"), (2, "/a/user-list"), (3, "/a/save.do"), (4, "/m/orders"), (5, "/x/do"), (8, "servlet:p.$hop")}


def test_closure_has_no_bound(spark):
    n = 300
    links = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)], "child string, parent string")
    got = {(r.child, r.ancestor): r.depth for r in closure(links).collect()}
    assert got == {(f"c{i}", f"c{j}"): j - i for i in range(n) for j in range(i + 1, n + 1)}
    ring = links.unionByName(spark.createDataFrame([(f"c{n}", "c0")], links.schema))
    assert closure(ring).groupBy().agg(F.count("*").alias("n"), F.max("depth").alias("d")).first() == ((n + 1) ** 2, n + 1)


def test_rules_on_bare_methods_reach_all_overloads(spark):
    covers = spark.createDataFrame([("t", "METHOD", "a.B.c()", 0.8), ("t", "METHOD", "a.B.c(int)", 0.8), ("t", "METHOD", "a.B.cc()", 0.8), ("t", "FILE", "a.B.c()", 0.6)], "test_id string, kind string, key string, confidence double")
    rules = [(1, "t", "remove", "METHOD", "a.B.c"), (2, "t", "add", "METHOD", "a.B.c(int)"), (3, "u", "add", "METHOD", "a.B.c()"), (4, "u", "remove", "METHOD", "a.B.c"), (5, "u", "add", "METHOD", "a.B.gone"), (6, "t", "add", "FILE", "a.B.c")]
    r = spark.createDataFrame(rules, "ord int, test_id string, op string, kind string, key string")
    m = spark.createDataFrame([("a.B.c()",), ("a.B.c(int)",), ("a.B.cc()",), (None,)], "fqn string")
    assert {tuple(x) for x in merge.apply_rules(covers, r, m).collect()} == {
        ("t", "METHOD", "a.B.c(int)", 1.0), ("t", "METHOD", "a.B.cc()", 0.8), ("t", "FILE", "a.B.c()", 0.6), ("t", "FILE", "a.B.c", 1.0), ("u", "METHOD", "a.B.gone", 1.0),
    }
