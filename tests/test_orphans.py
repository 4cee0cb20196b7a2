import random
from datetime import datetime as D
from datetime import timedelta

import pytest

from wakegraph.operators import orphans

REFS = "ref_id long, endpoint string, key string, at timestamp_ntz, month string, slices string"
PARENTS = "key string, since timestamp_ntz, until timestamp_ntz, month int, at int"


def found(spark, refs, parents):
    r = spark.createDataFrame([(*x, "m", "s") for x in refs], REFS)
    p = spark.createDataFrame([(*x, 1, 1) for x in parents], PARENTS)
    return sorted((x.ref_id, x.endpoint) for x in orphans.orphan_references(r, p).collect())


def brute(refs, parents):
    holds = lambda k, t: any(a == k and s is not None and t is not None and s <= t and (u is None or t < u) for a, s, u in parents)
    return sorted((i, e) for i, e, k, t in refs if k is not None and not holds(k, t))


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(orphans, "REFS_PER_SLICE", 3)  # several slices for the hot key
    random.seed(seed)
    day = lambda: D(2024, 1, 1) + timedelta(hours=random.randrange(24 * 200))
    keys = ["hot"] * 5 + list("abcdef") + [None]
    parents = [(random.choice(keys), random.choice([day(), day(), None]), random.choice([None, day()])) for _ in range(25)]
    parents += parents[:5]
    refs = [(i, random.choice(["from", "to"]), random.choice(keys + ["missing"]), random.choice([day()] * 9 + [None])) for i in range(150)]
    refs += [(1000 + i, "to", k, s) for i, (k, s, _) in enumerate(parents) if s] + [(2000 + i, "to", k, u) for i, (k, _, u) in enumerate(parents) if u]
    assert found(spark, refs, parents) == brute(refs, parents)


def test_month_boundaries(spark):
    first, second = D(2024, 2, 1), D(2024, 3, 1)
    parents = [("k", first, second)]
    refs = [(1, "to", "k", first), (2, "to", "k", second), (3, "to", "k", second - timedelta(microseconds=1)), (4, "to", "k", first - timedelta(microseconds=1))]
    assert found(spark, refs, parents) == [(2, "to"), (4, "to")]


def test_empty_tables(spark):
    t = D(2024, 1, 5)
    assert found(spark, [], []) == []
    assert found(spark, [(1, "to", "k", t)], []) == [(1, "to")]
    assert found(spark, [], [("k", t, None)]) == []
    assert found(spark, [(1, "to", None, t), (2, "to", "k", None)], [("k", t, None)]) == [(2, "to")]
