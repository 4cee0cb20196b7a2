"""Queries that assemble the report: rich interfaces, schedules and tables, test cases with what they cover, instantiators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import merge, traverse
from wakegraph.plans import report, tagging
from wakegraph.plans.graph import Graph
from wakegraph.queries.impact import _RISK, ACCESS, BACK1, CALLS, DEPTH, FORE0, INPUTS, LINKS, METHODS, TABLE_DEPTH, URLS, _risks, _with, impact_summary
from wakegraph.queries.impact import _SUMMARY as SUMMARY
from wakegraph.sources import config

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, base: f(Graph(spark, base))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BELOW = ", below AS (SELECT seed, node, min(dist) AS dist FROM (SELECT seed, node, dist FROM walk UNION ALL SELECT seed, seed, 0 FROM seeds) GROUP BY seed, node)"


def _below(g: Graph) -> DataFrame:
    """(seed, node, dist) of what reaches a changed method, itself at 0."""
    walk = g.space.put(g.backward(DEPTH, with_seed=False)).unionByName(g.seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("dist")))
    return walk.groupBy("seed", "node").agg(F.min("dist").alias("dist"))


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + _BELOW
    + """, ends AS (SELECT b.seed, b.node, b.dist, u.url, m.owner, ['LOW','MEDIUM','HIGH'][coalesce(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END, 1)] AS risk
  FROM below b JOIN method_urls u ON u.src = b.node LEFT JOIN methods m ON m.fqn = b.node LEFT JOIN risks r ON r.fqn = b.seed)
SELECT url, max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)::INT AS rank, count(*) AS n_paths, min(dist)::INT AS shortest, arg_min(owner, (dist, node)) AS owner, array_to_string(list_sort(list_distinct(list(seed)))[1:5], ',') AS changed FROM ends GROUP BY url"""
)
def api_paths(g: Graph) -> DataFrame:
    """Affected interfaces with the ways they were found: how many, the shortest, whose entry it is, the first five changes."""
    ends = _below(g).join(g.method_urls.withColumnRenamed("src", "node"), "node").join(g.methods.select(F.col("fqn").alias("node"), "owner"), "node", "left")
    return report.interface_paths(ends, _risks(g)).orderBy(F.desc("rank"), "url")


_TOUCH = f""", touch AS (SELECT name, access, src FROM table_access),
risky AS (SELECT fqn, CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS r FROM risks),
fore AS (SELECT seed, seed AS node, 0 AS dist FROM seeds UNION SELECT f.seed, c.dst, f.dist + 1 FROM fore f JOIN calls c ON c.src = f.node WHERE f.dist < {TABLE_DEPTH})"""


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS, ACCESS) + _RISK + _BELOW + _TOUCH
    + """, outs AS (SELECT DISTINCT f.seed, t.name FROM fore f JOIN touch t ON t.src = f.node WHERE access = 'WRITES_TABLE'),
evidence AS (
  SELECT task, b.seed, 1 AS prio FROM below b JOIN method_tasks t ON t.src = b.node
  UNION SELECT task, s.fqn, 2 FROM tasks t JOIN changed_symbols c ON replace(c.fqn, '$', '.') = t.class_fqn AND c.kind = 'CLASS' JOIN (SELECT NULL AS fqn) s ON true
  UNION SELECT m.task, w.seed, 3 FROM outs w JOIN touch t ON t.name = w.name AND t.access = 'READS_TABLE' JOIN method_tasks m ON m.src = t.src),
best AS (SELECT task, min(prio)::INT AS prio, count(DISTINCT seed) AS n_changed, coalesce(max(r), 1)::INT AS rank FROM evidence LEFT JOIN risky ON fqn = seed GROUP BY task),
own AS (SELECT task, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE access = 'READS_TABLE'), '') AS reads, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE access = 'WRITES_TABLE'), '') AS writes
  FROM method_tasks m JOIN touch t ON t.src = m.src GROUP BY task)
SELECT task, ['runs-changed','task-changed','reads-changed-table'][prio] AS source, prio, n_changed, rank, coalesce(reads, '') AS reads, coalesce(writes, '') AS writes FROM best LEFT JOIN own USING (task)"""
)
def schedules_rich(g: Graph) -> DataFrame:
    """Affected tasks by the strongest evidence: one of its methods leads to a change, its class is changed, or it reads what changes write."""
    below = _below(g)
    runs = below.join(g.method_tasks.withColumnRenamed("src", "node"), "node").select("task", "seed", F.lit(1).alias("prio"))
    types = g.table("changed_symbols").where("kind = 'CLASS'").select(F.regexp_replace("fqn", r"\$", ".").alias("class_fqn")).distinct()
    itself = g.tasks.join(types, "class_fqn", "left_semi").select("task", F.lit(None).cast("string").alias("seed"), F.lit(2).alias("prio"))
    access = g.space.put(g.table_access)
    written = g.forward(TABLE_DEPTH).select("seed", F.col("node").alias("src")).join(access.where("access = 'WRITES_TABLE'"), "src").select("seed", "name").distinct()
    readers = access.where("access = 'READS_TABLE'").join(g.method_tasks, "src").select("name", "task").distinct()
    reads = written.join(readers, "name").select("task", "seed", F.lit(3).alias("prio"))
    touched = g.method_tasks.join(access, "src").select("task", "access", "name")
    return report.rich_schedules(runs.unionByName(itself).unionByName(reads).distinct(), _risks(g), touched).orderBy("prio", F.desc("rank"), F.desc("n_changed"), "task")


@query(
    _with(METHODS, CALLS, INPUTS, FORE0, ACCESS)
    + r""", named AS (SELECT DISTINCT upper(unnest(regexp_extract_all(content, '(?is)<table\b[^<>]*\bname\s*=\s*["'']([^"''<>]*)["'']', 1))) AS name FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.xml'),
reached AS (SELECT DISTINCT name FROM walk JOIN table_access a ON a.src = node),
sources AS (SELECT coalesce(n.name, r.name) AS name, CASE WHEN n.name IS NULL THEN 'java-reached' WHEN r.name IS NULL THEN 'schema-changed' ELSE 'both' END AS source FROM named n FULL JOIN reached r ON n.name = r.name),
safe AS (SELECT name, source FROM sources UNION SELECT DISTINCT a.name, 'regression-safety' FROM table_access a WHERE a.name NOT IN (SELECT name FROM sources) AND split_part(a.src, '(', 1) IN (SELECT split_part(fqn, '(', 1) FROM changed_symbols WHERE fqn IS NOT NULL)),
ranked AS (SELECT name, access, src, row_number() OVER (PARTITION BY name, access ORDER BY src) AS k FROM table_access)
SELECT s.name, source, CASE source WHEN 'both' THEN 1 WHEN 'schema-changed' THEN 2 WHEN 'java-reached' THEN 3 ELSE 4 END AS prio, count(src) FILTER (WHERE access = 'READS_TABLE') AS n_readers, count(src) FILTER (WHERE access = 'WRITES_TABLE') AS n_writers,
  coalesce(string_agg(src, ',' ORDER BY src) FILTER (WHERE access = 'READS_TABLE' AND k <= 10), '') AS readers, coalesce(string_agg(src, ',' ORDER BY src) FILTER (WHERE access = 'WRITES_TABLE' AND k <= 10), '') AS writers
FROM safe s LEFT JOIN ranked r ON r.name = s.name GROUP BY s.name, source"""
)
def tables_rich(g: Graph) -> DataFrame:
    """Affected tables by how they are known, with the number and the first ten of their readers and writers."""
    xml = g.table("repo_files").where("content is not null and lower(path) like '%.xml'").select("path", "content")
    schema = config.elements(xml, "table").select(F.upper(config.attribute("name")).alias("name")).where("name is not null")
    access = g.space.put(g.table_access)
    reached = g.forward(TABLE_DEPTH).select(F.col("node").alias("src")).distinct().join(access, "src").select("name")
    bare = lambda c: F.substring_index(c, "(", 1)
    safety = access.withColumn("k", bare("src")).join(g.table("changed_symbols").where("fqn is not null").select(bare("fqn").alias("k")).distinct(), "k", "left_semi").select("name")
    return report.rich_tables(report.table_sources(schema, reached, safety), access).orderBy("prio", F.desc("n_readers"), "name")


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + SUMMARY.replace("\nSELECT x.fqn", ",\nsummary AS (SELECT x.fqn")
    + ") SELECT count(*) AS n_symbols, CAST(sum(n_entries) AS BIGINT) AS n_entries, CAST(sum(len(list_filter(string_split(urls, ' '), lambda u: u <> ''))) AS BIGINT) AS n_urls, CAST(sum(n_tasks) AS BIGINT) AS n_tasks FROM summary"
)
def list_sizes(g: Graph) -> DataFrame:
    """Sums of the sizes of the report's lists, not of distinct members."""
    return report.list_sizes(impact_summary(g))


_CASES = r"""texts AS (SELECT doc_id AS test_id, text, recorded_at FROM documents WHERE doc_kind = 'test_case' AND text IS NOT NULL),
cases AS (SELECT test_id, split_part(replace(text, chr(13), ''), chr(10), 1) AS title, regexp_extract(text, '(?m)^Area: (\w+)', 1) AS suite, recorded_at FROM texts)"""


def _cases(g: Graph) -> DataFrame:
    d = g.table("documents").where("doc_kind = 'test_case' and text is not null")
    return d.select(F.col("doc_id").alias("test_id"), F.substring_index(F.replace("text", F.lit("\r"), F.lit("")), "\n", 1).alias("title"), F.regexp_extract("text", r"(?m)^Area: (\w+)", 1).alias("suite"), "recorded_at", "text")


@query("WITH " + _CASES + " SELECT test_id, title, suite FROM cases")
def test_case_upsert(g: Graph) -> DataFrame:
    """Test cases recorded before 2024-09 updated and completed by the later ones."""
    c = _cases(g).withColumn("ord", F.unix_micros(F.col("recorded_at").cast("timestamp")))
    old = F.col("recorded_at") < F.lit("2024-09-01").cast("timestamp_ntz")
    batch = c.where(~old | F.col("recorded_at").isNull()).select("test_id", "title", "suite", "ord")
    return merge.merge_set(c.where(old).select("test_id", "title", "suite"), batch, ["test_id"], "ord")


@query(
    _with(METHODS, LINKS, URLS, _CASES)
    + r""", words AS (SELECT DISTINCT test_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM texts),
claims AS (SELECT DISTINCT test_id, 'METHOD' AS kind, m.fqn AS key FROM words JOIN methods m ON m.simple = word UNION SELECT test_id, 'TASK', word FROM words UNION SELECT test_id, 'CLASS', 'nowhere.' || word FROM words)
SELECT c.test_id, kind, key, 0.9::DOUBLE AS confidence FROM claims c WHERE (kind = 'METHOD' AND key IN (SELECT fqn FROM methods)) OR (kind = 'TASK' AND key IN (SELECT task FROM tasks)) OR (kind = 'CLASS' AND key IN (SELECT owner FROM methods WHERE owner IS NOT NULL))
UNION ALL SELECT DISTINCT test_id, 'SUITE', suite, 1.0 FROM cases WHERE suite <> ''"""
)
def test_case_covers(g: Graph) -> DataFrame:
    """What test cases claim to cover, as far as it exists, and the suites that they are in."""
    words = _cases(g).select("test_id", F.explode(F.array_distinct(names.identifiers(F.col("text")))).alias("word"))
    methods = words.join(g.methods.select(F.col("simple").alias("word"), F.col("fqn").alias("key")), "word").select("test_id", F.lit("METHOD").alias("kind"), "key")
    tasks = words.select("test_id", F.lit("TASK").alias("kind"), F.col("word").alias("key"))
    classes = words.select("test_id", F.lit("CLASS").alias("kind"), F.concat(F.lit("nowhere."), "word").alias("key"))
    claims = methods.unionByName(tasks).unionByName(classes).withColumn("confidence", F.lit(0.9)).distinct()
    nodes = {"METHOD": g.methods.select(F.col("fqn").alias("key")), "TASK": g.tasks.select(F.col("task").alias("key")), "CLASS": g.methods.where("owner is not null").select(F.col("owner").alias("key"))}
    return merge.covers_edges(_cases(g).select("test_id", "suite"), claims, nodes)


@query(
    _with(METHODS, CALLS, LINKS, URLS, ACCESS)
    + r""", tests AS (SELECT doc_id AS test_id, text FROM documents WHERE doc_kind IN ('test_case', 'impact_report') AND text IS NOT NULL),
words AS (SELECT DISTINCT test_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM tests),
cat AS (SELECT DISTINCT task AS word, 'TASK' AS kind, task AS key, 1.0::DOUBLE AS c FROM tasks UNION SELECT DISTINCT name, 'TABLE', name, 1.0 FROM table_access
  UNION SELECT DISTINCT simple, 'METHOD', fqn, 0.8 FROM methods WHERE start_line > 0 AND simple IS NOT NULL UNION SELECT DISTINCT split_part(owner, '.', -1), 'CLASS', owner, 0.8 FROM methods WHERE start_line > 0 AND owner IS NOT NULL),
pages AS (SELECT url FROM method_urls UNION SELECT url FROM class_urls),
parts AS (SELECT url, lower(regexp_replace(url, '^servlet:', '')) AS fragment FROM pages UNION SELECT url, lower(regexp_extract(split_part(url, '?', 1), '([^/:]+)[/:]*$', 1)) FROM pages)
SELECT test_id, kind, key, max(c) AS confidence FROM (
  SELECT test_id, kind, key, c FROM words JOIN cat USING (word)
  UNION ALL SELECT test_id, 'URL', url, 0.6 FROM tests JOIN parts ON length(fragment) >= 4 AND contains(lower(text), fragment)) GROUP BY ALL"""
)
def tagged_tests(g: Graph) -> DataFrame:
    """Tests with all that they name: tasks and tables for certain, methods and classes with source, URLs anywhere in the text."""
    tests = tagging.test_cases(g.table("documents"))
    m = g.methods.where("start_line > 0")
    row = lambda df, word, kind, key, c: df.select(word.alias("word"), F.lit(kind).alias("kind"), key.alias("key"), F.lit(c).alias("confidence"))
    catalogue = (
        row(g.tasks, F.col("task"), "TASK", F.col("task"), 1.0).unionByName(row(g.table_access, F.col("name"), "TABLE", F.col("name"), 1.0))
        .unionByName(row(m, F.col("simple"), "METHOD", F.col("fqn"), 0.8)).unionByName(row(m.where("owner is not null"), names.simple_name(F.col("owner")), "CLASS", F.col("owner"), 0.8))
    )
    urls = tagging.url_substring_tags(tests, g.method_urls.select("url").unionByName(g.class_urls.select("url")).distinct())
    both = tagging.token_tags(tests, catalogue).unionByName(urls)
    return both.groupBy("test_id", "kind", "key").agg(F.max("confidence").alias("confidence"))


@query(
    _with(METHODS, CALLS, LINKS, URLS)
    + r""", types AS (SELECT DISTINCT replace(fqn, '$', '.') AS class_fqn FROM changed_symbols WHERE kind IN ('CLASS', 'INTERFACE')),
made AS (SELECT DISTINCT t.class_fqn, c.src AS maker FROM calls c JOIN types t ON regexp_extract(c.dst, '^(.*)\.([^.(]+)\([^()]*\)$', 1) = t.class_fqn AND regexp_extract(c.dst, '^(.*)\.([^.(]+)\([^()]*\)$', 2) = '<init>')
SELECT m.class_fqn, m.maker, (SELECT count(DISTINCT to_method_fqn) FROM call_edges e WHERE e.from_method_fqn = m.maker AND e.kind = 'notification-macro') AS n_notifications,
  (SELECT count(DISTINCT url) FROM method_urls u WHERE u.src = m.maker) AS n_urls, (SELECT count(*) FROM calls c WHERE c.dst = m.maker) AS n_callers FROM made m"""
)
def instantiators(g: Graph) -> DataFrame:
    """Methods that make an instance of a changed type, with what they notify, where they are exposed and who calls them."""
    types = g.table("changed_symbols").where(F.col("kind").isin("CLASS", "INTERFACE")).select(F.regexp_replace("fqn", r"\$", ".").alias("class_fqn")).distinct()
    sent = g.table("call_edges").where("kind = 'notification-macro'").select(F.col("from_method_fqn").alias("src"), F.col("to_method_fqn").alias("dst"))
    return traverse.instantiators(types, g.calls, sent, g.method_urls)


@query(
    _with(METHODS, CALLS, LINKS)
    + r""", macros AS (SELECT DISTINCT simple, n_params, owner AS class_fqn, fqn FROM methods m JOIN links l ON l.child = m.owner WHERE n_params IS NOT NULL AND simple <> '<init>'),
sites AS (SELECT DISTINCT from_method_fqn AS src, regexp_extract(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 2) AS simple,
  CASE WHEN ends_with(to_method_fqn, '()') THEN 0 ELSE len(string_split(regexp_extract(to_method_fqn, '\((.*)\)$', 1), ',')) END AS n_params
  FROM call_edges WHERE kind = 'notification-macro' AND from_method_fqn IS NOT NULL AND regexp_matches(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$'))
SELECT DISTINCT src, fqn AS dst FROM sites JOIN macros USING (simple, n_params)"""
)
def macro_signatures(g: Graph) -> DataFrame:
    """Notification sites linked to the methods of the signature they call, in all classes that have a parent."""
    to = F.col("to_method_fqn")
    sites = g.table("call_edges").where((F.col("kind") == "notification-macro") & F.col("from_method_fqn").isNotNull() & to.rlike(names.METHOD_FQN)).select(
        F.col("from_method_fqn").alias("src"), names.method_simple(to).alias("simple"), names.parameter_count(to).alias("n_params")
    ).distinct()
    below = g.hierarchy.select(F.col("child").alias("owner")).distinct()
    macros = g.methods.where("n_params is not null and simple <> '<init>'").join(below, "owner", "left_semi").select("simple", "n_params", F.col("fqn").alias("dst"))
    return sites.join(macros, ["simple", "n_params"]).select("src", "dst").distinct()
