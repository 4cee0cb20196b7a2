"""Queries of the general data problems: hierarchies, orphans, snapshots, skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.operators import frequency, hierarchy, orphans, snapshots
from wakegraph.session import table


def _class_links(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.class_links(table(spark, base, "extends_edges"), table(spark, base, "implements_edges"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.cycles(_class_links(spark, base)).select(F.col("node").alias("class_fqn"), F.col("cycle").alias("cycle_fqn"))


def p1_hierarchy(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.Hierarchy(_class_links(spark, base)).summary().select(
        F.col("node").alias("class_fqn"), F.col("root").alias("root_fqn"), "depth", "path", "on_cycle", "level", "n_descendants"
    )


def p1_descendants(spark: SparkSession, base: str) -> DataFrame:
    return hierarchy.Hierarchy(_class_links(spark, base)).descendants()


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    found = orphans.call_orphans(table(spark, base, "call_edges"), table(spark, base, "method_nodes"))
    return found.select(F.col("ref_id").alias("edge_id"), "endpoint")


def p3_report(spark: SparkSession, base: str) -> DataFrame:
    return orphans.orphan_report(table(spark, base, "call_edges"), table(spark, base, "method_nodes"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, base, "file_nodes"), table(spark, base, "commit_nodes"))


def p4_counts(spark: SparkSession, base: str) -> DataFrame:
    return p4_found(spark, base).groupBy("repo_id", "change").agg(
        F.count(F.lit(1)).alias("n_changes"), F.countDistinct("path").alias("n_paths")
    )


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "call_edges")
    return frequency.heavy_hitters(edges, ["to_method_fqn", "kind"], F.col("from_method_fqn"), 0.01).select("to_method_fqn", "kind")


def p6_profile(spark: SparkSession, base: str) -> DataFrame:
    edges = table(spark, base, "call_edges")
    return frequency.profile(edges, ["to_method_fqn", "kind"], F.col("from_method_fqn"), "caller")


def p6_hours(spark: SparkSession, base: str) -> DataFrame:
    """Median and 90th percentile of the minute of the day at which the edges of a key were recorded."""
    edges = table(spark, base, "call_edges")
    minute = F.hour("recorded_at") * 60 + F.minute("recorded_at")
    return frequency.percentiles(edges, ["to_method_fqn", "kind"], minute, {"median_minute": 0.5, "p90_minute": 0.9}, bits=16)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_hierarchy, p1_descendants, p3_found, p3_report, p4_found, p4_counts, p6_found, p6_profile, p6_hours)
}

_LINKS = """
links AS (
  SELECT from_class_fqn AS child, to_class_fqn AS parent FROM extends_edges WHERE from_class_fqn IS NOT NULL AND to_class_fqn IS NOT NULL
  UNION SELECT from_class_fqn, to_interface_fqn FROM implements_edges WHERE from_class_fqn IS NOT NULL AND to_interface_fqn IS NOT NULL
),
reach AS (
  SELECT child, parent FROM links
  UNION SELECT r.child, l.parent FROM reach r JOIN links l ON r.parent = l.child
)"""

_ENDS = """
ends AS (
  SELECT edge_id, 'from' AS endpoint, from_method_fqn AS fqn, recorded_at AS seen FROM call_edges WHERE from_method_fqn IS NOT NULL
  UNION ALL SELECT edge_id, 'to', to_method_fqn, recorded_at FROM call_edges WHERE to_method_fqn IS NOT NULL
),
orphans AS (
  SELECT e.* FROM ends e WHERE NOT EXISTS (
    SELECT 1 FROM method_nodes m WHERE m.fqn = e.fqn AND m.recorded_at <= e.seen AND (m.removed_at IS NULL OR e.seen < m.removed_at))
)"""

_CHANGES = r"""
files AS (
  SELECT repo_id, commit_sha, regexp_replace(replace(path, chr(92), '/'), '^\./', '') AS path, lower(content_hash) AS hash, recorded_at
  FROM file_nodes WHERE path IS NOT NULL AND repo_id IS NOT NULL AND commit_sha IS NOT NULL
),
latest AS (
  SELECT repo_id, commit_sha, path, hash FROM files
  QUALIFY row_number() OVER (PARTITION BY repo_id, commit_sha, path ORDER BY recorded_at DESC NULLS LAST, hash DESC NULLS LAST) = 1
),
commits AS (
  SELECT repo_id, commit_sha, max(committed_at) AS committed_at FROM commit_nodes
  WHERE (repo_id, commit_sha) IN (SELECT repo_id, commit_sha FROM latest) GROUP BY ALL
),
ordered AS (
  SELECT repo_id, commit_sha, lag(commit_sha) OVER (PARTITION BY repo_id ORDER BY committed_at) AS previous FROM commits
),
now_ AS (SELECT l.* FROM latest l JOIN ordered o USING (repo_id, commit_sha) WHERE previous IS NOT NULL),
before_ AS (SELECT l.repo_id, o.commit_sha, l.path, l.hash FROM latest l JOIN ordered o ON l.repo_id = o.repo_id AND l.commit_sha = o.previous),
changes AS (
  SELECT coalesce(n.repo_id, b.repo_id) AS repo_id, coalesce(n.commit_sha, b.commit_sha) AS commit_sha, coalesce(n.path, b.path) AS path,
    CASE WHEN b.repo_id IS NULL THEN 'added' WHEN n.repo_id IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM now_ n FULL JOIN before_ b ON n.repo_id = b.repo_id AND n.commit_sha = b.commit_sha AND n.path = b.path
  WHERE b.repo_id IS NULL OR n.repo_id IS NULL OR n.hash <> b.hash
)"""

SQL = {
    "p1_found": f"""WITH RECURSIVE {_LINKS}
SELECT a.child AS class_fqn, min(a.parent) AS cycle_fqn
FROM reach a JOIN reach b ON a.child = b.parent AND a.parent = b.child
GROUP BY a.child""",
    "p1_descendants": f"WITH RECURSIVE {_LINKS} SELECT parent AS ancestor, child AS descendant FROM reach",
    "p1_hierarchy": f"""WITH RECURSIVE {_LINKS},
cyc AS (SELECT a.child AS node, min(a.parent) AS vertex FROM reach a JOIN reach b ON a.child = b.parent AND a.parent = b.child GROUP BY a.child),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
members AS (SELECT node, coalesce(vertex, node) AS vertex, vertex IS NOT NULL AS on_cycle FROM nodes LEFT JOIN cyc USING (node)),
arcs AS (SELECT DISTINCT c.vertex AS child, p.vertex AS parent FROM links l JOIN members c ON c.node = l.child JOIN members p ON p.node = l.parent WHERE c.vertex <> p.vertex),
climbs AS (SELECT DISTINCT vertex, 0 AS level FROM members UNION SELECT parent, level + 1 FROM climbs JOIN arcs ON child = vertex),
levels AS (SELECT vertex, max(level) AS level FROM climbs GROUP BY vertex),
chosen AS (SELECT child, first(parent ORDER BY level DESC, parent) AS parent FROM arcs JOIN levels ON vertex = parent GROUP BY child),
paths AS (
  SELECT vertex, vertex AS root, 0 AS depth, vertex AS path FROM levels WHERE vertex NOT IN (SELECT child FROM arcs)
  UNION ALL SELECT c.child, root, depth + 1, path || '/' || c.child FROM paths JOIN chosen c ON c.parent = paths.vertex
),
below AS (SELECT parent AS node, count(*) AS n FROM reach GROUP BY parent)
SELECT m.node AS class_fqn, root AS root_fqn, depth, path, on_cycle, level, coalesce(n, 0) AS n_descendants
FROM members m JOIN paths USING (vertex) JOIN levels USING (vertex) LEFT JOIN below b ON b.node = m.node""",
    "p3_found": f"WITH {_ENDS} SELECT edge_id, endpoint FROM orphans",
    "p3_report": f"""WITH {_ENDS},
born AS (SELECT fqn, min(recorded_at) AS born FROM method_nodes GROUP BY fqn),
counted AS (
  SELECT endpoint, strftime(seen, '%Y-%m') AS month, count(*) AS n_orphans, count(*) FILTER (WHERE born IS NULL) AS n_unknown,
    count(*) FILTER (WHERE born > seen) AS n_later, count(*) FILTER (WHERE born <= seen) AS n_removed
  FROM orphans LEFT JOIN born USING (fqn) GROUP BY 1, 2
),
refs AS (SELECT endpoint, strftime(seen, '%Y-%m') AS month, count(*) AS n_refs FROM ends GROUP BY 1, 2)
SELECT r.endpoint, r.month, n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_unknown, 0) AS n_unknown,
  coalesce(n_later, 0) AS n_later, coalesce(n_removed, 0) AS n_removed
FROM refs r LEFT JOIN counted c ON r.endpoint = c.endpoint AND r.month IS NOT DISTINCT FROM c.month""",
    "p4_found": f"WITH {_CHANGES} SELECT * FROM changes",
    "p4_counts": f"WITH {_CHANGES} SELECT repo_id, change, count(*) AS n_changes, count(DISTINCT path) AS n_paths FROM changes GROUP BY 1, 2",
    "p6_found": """SELECT to_method_fqn, kind FROM call_edges WHERE to_method_fqn IS NOT NULL AND kind IS NOT NULL
GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM call_edges)""",
    "p6_profile": """WITH v AS (SELECT to_method_fqn, kind, from_method_fqn AS caller, count(*) AS n FROM call_edges GROUP BY ALL)
SELECT to_method_fqn, kind, CAST(sum(n) AS BIGINT) AS n_rows, count(caller) AS n_callers,
  first(caller ORDER BY (caller IS NULL), n DESC, caller) AS top_caller,
  max(n) FILTER (WHERE caller IS NOT NULL) AS top_caller_rows
FROM v GROUP BY 1, 2""",
    "p6_hours": """SELECT to_method_fqn, kind, CAST(quantile_disc(m, 0.5) AS BIGINT) AS median_minute, CAST(quantile_disc(m, 0.9) AS BIGINT) AS p90_minute
FROM (SELECT to_method_fqn, kind, hour(recorded_at) * 60 + minute(recorded_at) AS m FROM call_edges) WHERE m IS NOT NULL GROUP BY 1, 2""",
}
