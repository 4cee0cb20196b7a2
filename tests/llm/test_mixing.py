import collections
import itertools
import math
import os
import random

import numpy as np
import pytest

from tests.harness import DATA
from wakegraph.llm import mixing, tokens

DOCS = "doc_id long, source string, n_tokens long, mix_id int, draw int"
TARGETS = "mix_id string, source string, target_share double, max_repeats int, tokens int"


def frames(spark, docs, targets):
    return spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS), spark.createDataFrame([(*t, 1) for t in targets], TARGETS)


def test_exponent_is_the_largest_that_fits():
    tokens, target = np.array([1000.0, 100.0, 10.0]), np.array([0.2, 0.4, 0.4])
    assert mixing.bisect_exponent(tokens, target, np.array([9.0, 99.0, 99.0])) == 1.0
    limit = np.array([2.0, 3.0, 4.0])
    a = mixing.bisect_exponent(tokens, target, limit)
    assert 0 < a < 1
    assert np.all(mixing.weights_at(tokens, target, a) * 1110 <= tokens * limit * 1.000001)
    assert not np.all(mixing.weights_at(tokens, target, a + 1e-6) * 1110 <= tokens * limit)
    assert np.allclose(mixing.weights_at(tokens, target, 0.0), tokens / 1110)


def test_plan_flags_short_sources(spark):
    docs = [(i, " Big " if i % 2 else "BIG", 100) for i in range(50)] + [(100, "small", 60), (101, None, 999), (102, "other", 7)]
    targets = [("m", "big\t", 0.5, 1), ("m", "Small", 0.4, 3), ("m", "absent", 0.1, 9), ("empty", "absent", 1.0, 1), ("m2", "small", 1.0, 1)]
    rows = {(r.mix_id, r.source): r for r in mixing.mixture_plan(*frames(spark, docs, targets)).collect()}
    assert rows["m", "big"].total == 5060 and rows["m", "big"].tokens == 5000
    assert {k for k, r in rows.items() if r.short} == {("m", "small"), ("m", "absent")}
    assert rows["empty", "absent"].total == 0 and rows["empty", "absent"].budget == 0
    assert rows["m2", "small"].exponent == 1.0


@pytest.mark.parametrize("per_block", [3, 1000])
def test_budgets_are_met_within_a_document(spark, per_block, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_BLOCK", per_block)
    docs = [(i, "a", 10 + i % 7) for i in range(100)] + [(1000 + i, "b", 5) for i in range(20)] + [(2000, "b", 0)]
    targets = [("m", "a", 0.6, 1), ("m", "b", 0.4, 4)]
    chosen, report = mixing.mixture(*frames(spark, docs, targets))
    rows = {r.source: r for r in report.collect()}
    got = {r.doc_id: r.copies for r in chosen.collect()}
    for s, limit in (("a", 1), ("b", 4)):
        r = rows[s]
        assert r.budget - 17 <= r.actual_tokens <= r.budget
        assert all(n <= limit for d, n in got.items() if (d < 1000) == (s == "a"))
        assert r.actual_tokens == sum(n * t for d, src, t in docs if src == s for n in [got.get(d, 0)])
    assert math.isclose(sum(r.actual_share for r in rows.values()), 1.0)
    assert {r.doc_id: r.copies for r in mixing.mixture(*frames(spark, docs, targets))[0].collect()} == got


def test_a_feasible_mix_reaches_its_targets(spark):
    docs = [(i, "a" if i < 300 else "b", 10) for i in range(400)]
    report = mixing.mixture(*frames(spark, docs, [("m", "a", 0.5, 2), ("m", "b", 0.5, 2)]))[1]
    assert all(abs(r.actual_share - 0.5) < 0.01 for r in report.collect())


def test_nothing(spark):
    chosen, report = mixing.mixture(*frames(spark, [], [("m", "a", None, None)]))
    assert chosen.count() == 0
    assert [(r.actual_tokens, r.actual_share, r.short) for r in report.collect()] == [(0, None, False)]
    assert mixing.mixture(*frames(spark, [(1, "a", 5)], []))[0].count() == 0


def levels_by_search(tokens, target, limit):
    """Water-filling by trying every set of sources that give all they may: the others share what is left."""
    n, size, found = len(tokens), sum(tokens), []
    for capped in itertools.product([False, True], repeat=n):
        plan = [t * m if c else 0.0 for t, m, c in zip(tokens, limit, capped)]
        left, rest = size - sum(plan), sum(q for q, c in zip(target, capped) if not c)
        if rest:
            plan = [p if c else left * q / rest for p, q, c in zip(plan, target, capped)]
        full = all(p <= t * m + 1e-6 for p, t, m in zip(plan, tokens, limit))
        needed = all(not c or (not rest or left * q / rest >= t * m - 1e-6) for t, m, q, c in zip(tokens, limit, target, capped))
        if full and needed:
            found.append(plan)
    return found


def test_sources_that_cannot_reach_their_target_do_not_move_the_others():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randrange(1, 6)
        tokens, limit = [float(draw.randrange(0, 4000)) for _ in range(n)], [float(draw.randrange(0, 5)) for _ in range(n)]
        target = [draw.random() for _ in range(n)]
        target = [q / sum(target) for q in target]
        exponent, planned = mixing.fill(np.array(tokens), np.array(target), np.array(limit))
        assert any(np.allclose(planned, want, atol=1e-3) for want in levels_by_search(tokens, target, limit))
        free = [i for i in range(n) if exponent[i] == 1.0]
        assert all(math.isclose(planned[i] * target[j], planned[j] * target[i], rel_tol=1e-9, abs_tol=1e-6) for i in free for j in free)
        if free:
            assert math.isclose(planned.sum(), sum(tokens), rel_tol=1e-9)
        assert all(math.isclose(planned[i], tokens[i] * limit[i], rel_tol=1e-9) for i in range(n) if exponent[i] < 1.0)


def test_one_row_without_repeats_concerns_itself_only(spark):
    docs = [(i, "abc"[i % 3], 10) for i in range(300)]
    targets = [("m", "a", 0.5, 3), ("m", "b", 0.25, 3), ("m", "c", 0.25, None), ("n", "a", 0.5, 3), ("n", "b", 0.4, 3), ("n", "c", 0.1, 0), ("n", "a", 0.1, 1)]
    rows = {(r.mix_id, r.source, r.target_share): r for r in mixing.mixture(*frames(spark, docs, targets))[1].collect()}
    assert rows["m", "c", 0.25].actual_tokens == 0 and rows["n", "c", 0.1].actual_tokens == 0 and rows["n", "a", 0.1].budget == 0
    assert [round(rows[k].actual_share, 2) for k in (("m", "a", 0.5), ("m", "b", 0.25), ("n", "a", 0.5), ("n", "b", 0.4))] == [0.67, 0.33, 0.56, 0.44]


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.01"), reason="no test tables here")
def test_mixes_of_the_tables_reach_their_targets(spark):
    base = f"{DATA}/sf0.01"
    docs, targets = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/mix_targets.parquet")
    counted = tokens.token_counts(docs)
    own = {r.doc_id: (r.source, r.n_tokens) for r in counted.withColumn("source", mixing.clean_source()).collect()}
    longest, owned = collections.Counter(), collections.Counter()
    for s, n in own.values():
        longest[s] = max(longest[s], n)
        owned[s] += n
    chosen, report = mixing.mixture(counted, targets)
    got = collections.defaultdict(collections.Counter)
    limits = {(r.mix_id, r.source): r.max_repeats for r in report.collect()}
    for r in chosen.collect():
        assert own[r.doc_id] == (r.source, r.n_tokens) and r.copies <= limits[r.mix_id, r.source]
        got[r.mix_id][r.source] += r.n_tokens * r.copies
    mixes = collections.defaultdict(list)
    for r in report.collect():
        mixes[r.mix_id].append(r)
        assert r.actual_tokens == got[r.mix_id][r.source]
    for rows in mixes.values():
        size = sum(owned[r.source] for r in rows)
        free = [r for r in rows if r.actual_tokens + longest[r.source] < owned[r.source] * r.max_repeats]
        left = size - sum(owned[r.source] * r.max_repeats for r in rows if r not in free)
        for r in free:  # its target's part of what the exhausted sources leave, within one document
            want = left * r.target_share / sum(x.target_share for x in free)
            assert want - longest[r.source] - 1 <= r.actual_tokens <= want + 1, r
