from datetime import datetime as D

from wakegraph.operators.snapshots import except_all_both, snapshot_changes

FILES = "path string, pkg string, repo_id string, commit_sha string, content_hash string, recorded_at timestamp_ntz, `__n` int, committed_at int"
COMMITS = "commit_sha string, repo_id string, committed_at timestamp_ntz, path string"


def changes(spark, files, commits):
    f = spark.createDataFrame([(p, None, r, c, h, at, 1, 2) for r, c, p, h, at in files], FILES)
    k = spark.createDataFrame([(c, r, at, "x") for r, c, at in commits], COMMITS)
    return sorted(tuple(x) for x in snapshot_changes(f, k).select("repo_id", "commit_sha", "path", "change").collect())


T = [D(2024, m, 1) for m in range(1, 13)]


def test_labels_and_normal_forms(spark):
    files = [
        ("r", "c1", "./a/x", "AA", T[0]), ("r", "c1", "b", "b1", T[0]), ("r", "c1", "gone", "g", T[0]), ("r", "c1", "n", None, T[0]),
        ("r", "c2", "a\\x", "aa", T[1]), ("r", "c2", "b", "b2", T[1]), ("r", "c2", "new", "w", T[1]), ("r", "c2", "n", "n2", T[1]), ("r", "c2", None, "q", T[1]),
        ("r", "c3", "b", "old", T[1]), ("r", "c3", "b", "b2", T[2]), ("r", "c3", "b", "b2", T[2]), ("r", "c3", "n", "n2", None),
    ]
    commits = [("r", "c3", T[8]), ("r", "c1", T[0]), ("r", "c2", T[7]), ("r", "c2", T[7]), ("r", "empty", T[7])]
    assert changes(spark, files, commits) == [
        ("r", "c2", "b", "changed"), ("r", "c2", "gone", "removed"), ("r", "c2", "new", "added"),
        ("r", "c3", "a/x", "removed"), ("r", "c3", "new", "removed"),
    ]


def test_first_snapshots_unknown_commits_and_nothing(spark):
    assert changes(spark, [("r", "c1", "a", "h", T[0]), ("s", "c2", "a", "h", T[1]), ("r", "zz", "b", "h", T[1]), (None, "c1", "a", "h", T[0])], [("r", "c1", T[0]), ("s", "c2", T[1])]) == []
    assert changes(spark, [], []) == []


def test_commits_close_together_and_far_apart(spark):
    commits = [("r", f"c{i}", D(2020 + i // 3, 1 + 4 * (i % 3), 1 + i)) for i in range(9)]
    files = [("r", f"c{i}", "a", str(i // 2), T[0]) for i in range(9)]
    assert changes(spark, files, commits) == [("r", f"c{i}", "a", "changed") for i in range(2, 9, 2)]


def test_except_all_counts_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "i int, s string")
    b = spark.createDataFrame([(1, None), (3, "y"), (3, "y")], "i int, s string")
    got = sorted((r.i, r["__side"], r["__n"]) for r in except_all_both(a, b).collect())
    assert got == [(1, 1, 2), (2, 1, 1), (3, -1, 2)]
