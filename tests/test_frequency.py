import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wakegraph.operators.frequency import heavy_hitters, percentiles, profile

SCHEMA = "k string, v string, n long, `__value` string, `__weight` int"


def rows(spark, data):
    return spark.createDataFrame([(k, v, n, "x", 1) for k, v, n in data], SCHEMA)


def test_profile_against_counting(spark):
    random.seed(1)
    data = [(random.choice(["hot"] * 6 + ["a", "b", None]), random.choice(["x", "y", "z", None]), random.randrange(9)) for _ in range(500)]
    got = {r.k: tuple(r)[1:] for r in profile(rows(spark, data), ["k"], F.col("v")).collect()}
    by = defaultdict(list)
    for k, v, _ in data:
        by[k].append(v)
    assert len(got) == len(by)
    for k, vs in by.items():
        c = Counter(v for v in vs if v is not None)
        top = min(c, key=lambda v: (-c[v], v)) if c else None
        assert got[k] == (len(vs), len(c), top, c[top] if c else None)


def test_profile_of_nulls_ties_and_nothing(spark):
    got = profile(rows(spark, [("a", None, 1), ("b", "y", 1), ("b", "x", 1)]), ["k"], F.col("v")).orderBy("k").collect()
    assert [tuple(r) for r in got] == [("a", 1, 0, None, None), ("b", 2, 2, "x", 1)]
    assert profile(rows(spark, []), ["k"], F.col("v")).count() == 0


def test_percentiles_are_exact(spark):
    random.seed(2)
    data = [(random.choice("ab"), None, random.choice([None, random.randrange(-(1 << 40), 1 << 40), 5, -5, 0])) for _ in range(300)]
    data += [("one", None, 7), ("none", None, None)]
    probs = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: tuple(r)[1:] for r in percentiles(rows(spark, data), ["k"], F.col("n"), probs).collect()}
    for k in ("a", "b", "one"):
        values = sorted(n for x, _, n in data if x == k and n is not None)
        want = tuple(values[max(1, -(-len(values) * int(p * 100) // 100)) - 1] for p in probs.values())
        assert got[k] == want
    assert "none" not in got


def test_heavy_hitters_count_all_rows(spark):
    data = [("a", "x", 1)] * 2 + [(None, "x", 1)] * 8
    assert [tuple(r) for r in heavy_hitters(rows(spark, data), ["k"], F.col("v"), 0.2).collect()] == [("a", 2)]
    assert heavy_hitters(rows(spark, data), ["k"], F.col("v"), 0.21).count() == 0
    assert heavy_hitters(rows(spark, []), ["k"], F.col("v"), 0.01).count() == 0
