"""Queries over the call graph: reach, entry points, schedules, tables, risk, coverage, chains, hierarchies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import resolve, traverse
from wakegraph.plans import report, slices
from wakegraph.plans.graph import ACTION_BASE, QUERY_CALL, SENSITIVE, TASK_BASE, UPDATE_CALL, Graph
from wakegraph.plans.tagging import covers_of

DEPTH, TABLE_DEPTH = 6, 4

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query of the graph under its function's name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, base: f(Graph(spark, base))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


METHODS = r"""
methods AS (
  SELECT fqn, owner_fqn AS owner, simple_name AS simple, is_static, coalesce(extra_labels, []) AS labels, start_line, end_line, commit_sha,
    CASE WHEN NOT ends_with(fqn, '(?)') THEN
      CASE WHEN trim(regexp_extract(fqn, '\((.*)\)\s*$', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(fqn, '\((.*)\)\s*$', 1), ',')) END END AS n_params
  FROM method_nodes WHERE fqn IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY recorded_at DESC NULLS LAST, start_line DESC NULLS LAST, end_line DESC NULLS LAST,
    commit_sha DESC NULLS LAST, owner_fqn DESC NULLS LAST, simple_name DESC NULLS LAST) = 1
)"""
CALLS = """
calls AS (SELECT DISTINCT from_method_fqn AS src, to_method_fqn AS dst FROM call_edges WHERE from_method_fqn IS NOT NULL AND to_method_fqn IS NOT NULL)"""
INPUTS = r"""
written AS (
  SELECT DISTINCT fqn AS input, regexp_replace(fqn, '\s+', '', 'g') AS clean FROM changed_symbols WHERE kind IN ('METHOD', 'CONSTRUCTOR') AND fqn IS NOT NULL
),
parts AS (
  SELECT *, regexp_extract(clean, '^([^(]*)\.[^.(]+(?:\(.*)?$', 1) AS owner, regexp_extract(clean, '([^.(]+)(?:\(.*)?$', 1) AS simple0,
    regexp_extract(clean, '\((.*)\)\s*$', 1) AS given,
    trim(array_to_string(list_filter(string_split(given, ''), lambda ch, i: len(replace(given[1:i], '>', '')) = len(replace(given[1:i], '<', '')) AND ch <> '>'), '')) AS inner_
  FROM written
),
shaped AS (
  SELECT *, CASE WHEN simple0 = split_part(owner, '.', -1) THEN '<init>' ELSE simple0 END AS simple,
    CASE WHEN contains(clean, '(') THEN CASE WHEN inner_ = '' THEN 0 ELSE len(string_split(inner_, ',')) END END AS n_params FROM parts
),
tiers AS (
  SELECT input, m.fqn, 1 AS tier FROM written w JOIN methods m ON w.clean = m.fqn WHERE m.n_params IS NOT NULL
  UNION SELECT input, m.fqn, 2 FROM shaped s JOIN methods m ON s.owner = m.owner AND s.simple = m.simple AND s.n_params = m.n_params
),
inputs AS (SELECT input, fqn, tier FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY input)),
seeds AS (SELECT DISTINCT fqn AS seed FROM inputs)"""
_STEP = """
{name} AS (
  {start}
  UNION SELECT r.seed, c.{to}, r.dist + 1 FROM {name} r JOIN calls c ON c.{at} = r.node WHERE r.dist < {depth}
)"""
BACK = _STEP.format(name="walk", start="SELECT seed, seed AS node, 0 AS dist FROM seeds", at="dst", to="src", depth=DEPTH)
BACK1 = _STEP.format(name="walk", start="SELECT DISTINCT s.seed, c.src AS node, 1 AS dist FROM seeds s JOIN calls c ON c.dst = s.seed", at="dst", to="src", depth=DEPTH)
FORE = _STEP.format(name="walk", start="SELECT DISTINCT s.seed, c.dst AS node, 1 AS dist FROM seeds s JOIN calls c ON c.src = s.seed", at="src", to="dst", depth=DEPTH)
FORE0 = _STEP.format(name="walk", start="SELECT seed, seed AS node, 0 AS dist FROM seeds", at="src", to="dst", depth=TABLE_DEPTH)
FORE06 = _STEP.format(name="walk", start="SELECT seed, seed AS node, 0 AS dist FROM seeds", at="src", to="dst", depth=DEPTH)
REACH = "reach AS (SELECT seed, node, min(dist) AS dist FROM walk GROUP BY seed, node)"
LINKS = """
links AS (
  SELECT from_class_fqn AS child, to_class_fqn AS parent FROM extends_edges WHERE from_class_fqn IS NOT NULL AND to_class_fqn IS NOT NULL
  UNION SELECT from_class_fqn, to_interface_fqn FROM implements_edges WHERE from_class_fqn IS NOT NULL AND to_interface_fqn IS NOT NULL
)"""
ANCESTORS = """
up(child, ancestor, depth) USING KEY (child, ancestor) AS (
  SELECT child, parent, 1 FROM links
  UNION SELECT u.child, l.parent, u.depth + 1 FROM up u JOIN links l ON l.child = u.ancestor
  WHERE NOT EXISTS (SELECT 1 FROM recurring.up r WHERE r.child = u.child AND r.ancestor = l.parent)
),
ancestors AS (SELECT child, ancestor, min(depth) AS depth FROM up GROUP BY child, ancestor)"""
URLS = f"""
method_urls AS (SELECT fqn AS src, lower('/' || split_part(owner, '.', -1) || '/' || simple) AS url FROM methods WHERE list_contains(labels, 'EntryPoint')),
class_urls AS (SELECT child AS class_fqn, 'servlet:' || child AS url FROM links WHERE parent = '{ACTION_BASE}'),
tasks AS (SELECT child AS class_fqn, split_part(child, '.', -1) AS task FROM links WHERE parent = '{TASK_BASE}'),
method_tasks AS (SELECT fqn AS src, task FROM methods JOIN tasks ON owner = class_fqn)"""
ACCESS = rf"""
table_access AS (
  SELECT DISTINCT src, CASE WHEN dst = '{QUERY_CALL}' THEN 'READS_TABLE' ELSE 'WRITES_TABLE' END AS access,
    upper(split_part(regexp_extract(src, '{names.METHOD_FQN}', 1), '.', -1)) AS name
  FROM calls WHERE dst IN ('{QUERY_CALL}', '{UPDATE_CALL}') AND regexp_extract(src, '{names.METHOD_FQN}', 1) <> ''
)"""
COVERS = r"""
tests AS (SELECT doc_id AS test_id, text FROM documents WHERE doc_kind IN ('test_case', 'impact_report') AND text IS NOT NULL),
words AS (SELECT DISTINCT test_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM tests),
covers AS (SELECT DISTINCT test_id, 'METHOD' AS kind, m.fqn AS key, 0.8::DOUBLE AS confidence FROM words w JOIN methods m ON w.word = m.simple WHERE m.start_line > 0)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


@query(_with(METHODS, INPUTS) + "SELECT input, fqn, tier FROM inputs")
def fuzzy_match(g: Graph) -> DataFrame:
    changed = g.table("changed_symbols").where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).select(F.col("fqn").alias("input"))
    return resolve.fuzzy_methods(changed, g.methods.where("n_params is not null")).distinct()


@query(_with(METHODS, INPUTS) + "SELECT DISTINCT input FROM written WHERE clean IN (SELECT fqn FROM methods)")
def exact_semi(g: Graph) -> DataFrame:
    changed = g.table("changed_symbols").where(F.col("kind").isin("METHOD", "CONSTRUCTOR") & F.col("fqn").isNotNull()).select(F.col("fqn").alias("input"), F.regexp_replace("fqn", r"\s+", "").alias("fqn"))
    return changed.join(g.methods.select("fqn"), "fqn", "left_semi").select("input").distinct()


@query(_with(METHODS, CALLS, INPUTS, BACK, REACH) + "SELECT * FROM reach")
def backward_reach(g: Graph) -> DataFrame:
    return g.backward(DEPTH)


@query(_with(METHODS, CALLS, INPUTS, FORE) + "SELECT seed AS fqn, count(DISTINCT node) AS n_reachable FROM seeds LEFT JOIN walk USING (seed) GROUP BY seed")
def forward_reach(g: Graph) -> DataFrame:
    reach = g.forward(DEPTH, with_seed=False).groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    return g.seeds.join(reach, "seed", "left").select(F.col("seed").alias("fqn"), F.coalesce("n", F.lit(0)).alias("n_reachable"))


@query(
    _with(METHODS, CALLS, INPUTS, BACK, REACH, LINKS, URLS)
    + """, own AS (SELECT src, string_agg(DISTINCT url, ' ' ORDER BY url) AS own FROM method_urls GROUP BY src),
of_class AS (SELECT class_fqn, string_agg(DISTINCT url, ' ' ORDER BY url) AS cls FROM class_urls GROUP BY class_fqn)
SELECT seed, node AS entry, m.owner, concat_ws(' ', cls, own) AS urls
FROM reach JOIN own ON own.src = node LEFT JOIN methods m ON m.fqn = node LEFT JOIN of_class c ON c.class_fqn = m.owner"""
)
def entry_points_api(g: Graph) -> DataFrame:
    return slices.entry_points(g.backward(DEPTH), g.methods, g.method_urls, g.class_urls)


@query(_with(METHODS, CALLS, INPUTS, BACK, REACH, LINKS, URLS) + "SELECT DISTINCT seed, node AS entry, task FROM reach JOIN method_tasks t ON t.src = node")
def entry_points_schedule(g: Graph) -> DataFrame:
    return slices.schedule_points(g.backward(DEPTH), g.method_tasks)


@query(
    _with(METHODS, CALLS, INPUTS, FORE0, ACCESS)
    + """SELECT seed, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE access = 'READS_TABLE'), '') AS reads,
  coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE access = 'WRITES_TABLE'), '') AS writes
FROM seeds LEFT JOIN (SELECT DISTINCT seed, node FROM walk) USING (seed) LEFT JOIN table_access a ON a.src = node GROUP BY seed"""
)
def db_tables_reached(g: Graph) -> DataFrame:
    return slices.tables_reached(g.forward(TABLE_DEPTH), g.table_access, g.seeds)


_RISK = """, roots AS (SELECT src FROM method_urls UNION SELECT src FROM method_tasks),
counts AS (SELECT seed, count(DISTINCT node) AS n FROM walk WHERE node IN (SELECT src FROM roots) GROUP BY seed),
graded AS (SELECT fqn, coalesce(n, 0) AS entry_count, contains(owner, '.security.') OR contains(owner, '.audit.') AS sensitive
  FROM methods LEFT JOIN counts ON fqn = seed WHERE fqn IN (SELECT seed FROM seeds)),
risks AS (SELECT *, CASE WHEN entry_count > 5 OR sensitive THEN 'HIGH' WHEN entry_count > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM graded)"""


def _risks(g: Graph) -> DataFrame:
    changed = g.methods.join(g.seeds.withColumnRenamed("seed", "fqn"), "fqn", "left_semi")
    return slices.risk(g.backward(DEPTH, with_seed=False), g.method_urls, g.method_tasks, changed, SENSITIVE)


@query(_with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + " SELECT * FROM risks")
def risk_grade(g: Graph) -> DataFrame:
    return _risks(g)


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK
    + """ SELECT input, max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS risk_rank, CAST(sum(entry_count) AS BIGINT) AS entry_count,
  bool_or(sensitive) AS sensitive, count(*) AS n_methods FROM inputs JOIN risks USING (fqn) GROUP BY input"""
)
def risk_by_input(g: Graph) -> DataFrame:
    """Risks of the graph's methods folded into the inputs they stand for: greatest risk, summed entry counts."""
    return g.inputs.join(_risks(g), "fqn").groupBy("input").agg(
        F.max(names.rank(F.col("risk"), names.RISK_RANK)).alias("risk_rank"), F.sum("entry_count").alias("entry_count"),
        F.bool_or("sensitive").alias("sensitive"), F.count(F.lit(1)).alias("n_methods"),
    )


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK
    + " SELECT r AS risk, count(fqn) AS n_methods FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(r) LEFT JOIN risks ON risk = r GROUP BY r"
)
def risk_counts_zero_fill(g: Graph) -> DataFrame:
    levels = g.spark.createDataFrame([(k,) for k in names.RISK_RANK], "risk string")
    return levels.join(_risks(g).groupBy("risk").agg(F.count(F.lit(1)).alias("n")), "risk", "left").select("risk", F.coalesce("n", F.lit(0)).alias("n_methods"))


_SUMMARY = """, entries AS (SELECT r.seed, count(DISTINCT r.node) AS n_entries, string_agg(DISTINCT u.url, ' ' ORDER BY u.url) AS urls
  FROM (SELECT DISTINCT seed, node FROM walk UNION SELECT seed, seed FROM seeds) r JOIN method_urls u ON u.src = r.node GROUP BY r.seed),
runs AS (SELECT r.seed, count(DISTINCT t.task) AS n_tasks
  FROM (SELECT DISTINCT seed, node FROM walk UNION SELECT seed, seed FROM seeds) r JOIN method_tasks t ON t.src = r.node GROUP BY r.seed)
SELECT x.fqn, x.risk, x.entry_count, coalesce(n_entries, 0) AS n_entries, coalesce(urls, '') AS urls, coalesce(n_tasks, 0) AS n_tasks
FROM risks x LEFT JOIN entries e ON e.seed = x.fqn LEFT JOIN runs t ON t.seed = x.fqn"""


@query(_with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + _SUMMARY)
def impact_summary(g: Graph) -> DataFrame:
    """The flagship: risk, entry points with their URLs, and tasks behind every changed method, from one walk."""
    walk = g.space.put(g.backward(DEPTH, with_seed=False))
    changed = g.methods.join(g.seeds.withColumnRenamed("seed", "fqn"), "fqn", "left_semi")
    risks = slices.risk(walk, g.method_urls, g.method_tasks, changed, SENSITIVE)
    reach = walk.select("seed", "node").unionByName(g.seeds.select("seed", F.col("seed").alias("node"))).distinct()
    entries = reach.join(g.method_urls.withColumnRenamed("src", "node"), "node").groupBy("seed").agg(
        F.count_distinct("node").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("url")), " ").alias("urls")
    )
    runs = reach.join(g.method_tasks.withColumnRenamed("src", "node"), "node").groupBy("seed").agg(F.count_distinct("task").alias("n_tasks"))
    return risks.withColumnRenamed("fqn", "seed").join(entries, "seed", "left").join(runs, "seed", "left").select(
        F.col("seed").alias("fqn"), "risk", "entry_count", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("urls", F.lit("")).alias("urls"), F.coalesce("n_tasks", F.lit(0)).alias("n_tasks")
    )


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS, COVERS)
    + """, hits AS (SELECT seed, test_id, max(confidence) AS c, count(DISTINCT node) AS h FROM walk JOIN covers ON key = node GROUP BY seed, test_id)
SELECT test_id, max(c) AS confidence, CAST(sum(h) AS BIGINT) AS hits, count(*) AS n_changed FROM hits GROUP BY test_id"""
)
def coverage_tests(g: Graph) -> DataFrame:
    per_seed = slices.covering_tests(g.backward(DEPTH, with_seed=False), covers_of(g))
    return per_seed.groupBy("test_id").agg(F.max("confidence").alias("confidence"), F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("n_changed"))


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS, COVERS)
    + """SELECT node AS uncovered, count(DISTINCT seed) AS n_changed FROM walk WHERE node IN (SELECT src FROM method_urls)
AND node NOT IN (SELECT key FROM covers) GROUP BY node"""
)
def coverage_gaps(g: Graph) -> DataFrame:
    return slices.coverage_gaps(g.backward(DEPTH, with_seed=False), covers_of(g), g.method_urls)


@query(_with(METHODS, CALLS, INPUTS, FORE06, LINKS, URLS) + "SELECT DISTINCT seed, task FROM walk JOIN method_tasks t ON t.src = node")
def scheduled_forward(g: Graph) -> DataFrame:
    return g.forward(DEPTH).join(g.method_tasks.withColumnRenamed("src", "node"), "node").select("seed", "task").distinct()


@query(_with(LINKS, ANCESTORS) + "SELECT * FROM ancestors")
def hierarchy_closure(g: Graph) -> DataFrame:
    return g.ancestors


_TYPES = """
typed AS (SELECT fqn, owner, simple, string_split(regexp_extract(fqn, '\\((.*)\\)$', 1), ',') AS types FROM methods WHERE n_params IS NOT NULL AND simple <> '<init>'),
overrides AS (SELECT DISTINCT a.fqn AS src, b.fqn AS dst FROM typed a JOIN ancestors h ON h.child = a.owner JOIN typed b ON b.owner = h.ancestor AND b.simple = a.simple AND b.types = a.types)"""


@query(_with(METHODS, LINKS, ANCESTORS, _TYPES) + "SELECT * FROM overrides")
def override_pairs(g: Graph) -> DataFrame:
    return g.overrides


_ALL_EDGES = """
linked AS (SELECT src, dst, min(etype) AS etype FROM (SELECT * FROM threaded UNION ALL SELECT src, dst, 'OVERRIDES' FROM overrides) GROUP BY src, dst)"""


@query(
    _with(METHODS, INPUTS, LINKS, ANCESTORS, _TYPES)
    + """, up5 AS (SELECT seed, seed AS node, 0 AS dist FROM seeds UNION SELECT u.seed, o.dst, u.dist + 1 FROM up5 u JOIN overrides o ON o.src = u.node WHERE u.dist < 5)
SELECT seed, node, min(dist) AS dist FROM up5 GROUP BY seed, node"""
)
def override_expansion(g: Graph) -> DataFrame:
    return traverse.bfs(g.seeds, g.overrides, 5)


@query(
    _with(METHODS, LINKS, ANCESTORS)
    + """, wanted AS (SELECT DISTINCT m.owner, m.simple FROM methods m WHERE m.n_params IS NULL)
SELECT w.owner, w.simple, arg_min(m.fqn, (a.depth, m.fqn)) AS fqn
FROM wanted w JOIN ancestors a ON a.child = w.owner JOIN methods m ON m.owner = a.ancestor AND m.simple = w.simple WHERE m.n_params IS NOT NULL GROUP BY ALL"""
)
def inherited_method(g: Graph) -> DataFrame:
    """Placeholders resolved to the method of that name in the nearest generation of ancestors."""
    wanted = g.methods.where("n_params is null and owner is not null and simple is not null").select("owner", "simple")
    return resolve.nearest_inherited(wanted, g.methods.where("n_params is not null"), g.ancestors)


@query(
    """WITH classes AS (SELECT DISTINCT owner_fqn AS c FROM method_nodes WHERE owner_fqn IS NOT NULL),
scopes AS (SELECT DISTINCT replace(fqn, '$', '.') AS scope FROM changed_symbols WHERE fqn IS NOT NULL AND NOT contains(fqn, '(')),
cut AS (SELECT scope, unnest(range(1, len(string_split(scope, '.')) + 1)) AS n FROM scopes),
pre AS (SELECT scope, array_to_string(string_split(scope, '.')[1:n], '.') AS p FROM cut),
hit AS (SELECT scope, arg_max(p, length(p)) AS class_fqn FROM pre WHERE p IN (SELECT c FROM classes) GROUP BY scope)
SELECT scope, class_fqn FROM scopes LEFT JOIN hit USING (scope)"""
)
def enclosing_scope(g: Graph) -> DataFrame:
    scopes = g.table("changed_symbols").where(F.col("fqn").isNotNull() & ~F.col("fqn").contains("(")).select(F.regexp_replace("fqn", r"\$", ".").alias("scope"))
    return resolve.enclosing_class(scopes, g.methods.select(F.col("owner").alias("class_fqn")).where("class_fqn is not null"))


_CHAIN = (
    _with(METHODS, CALLS, INPUTS, BACK1, REACH, LINKS, URLS)
    + "SELECT node AS src, seed AS dst, dist AS length FROM reach WHERE node IN (SELECT src FROM method_urls) AND node <> seed"
)


@query(_CHAIN)
def shortest_chain_len(g: Graph) -> DataFrame:
    """Length of the shortest call chain from every entry point to every changed method within reach."""
    reach = g.backward(DEPTH, with_seed=False).where("node <> seed")
    return reach.join(g.method_urls.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("src"), F.col("seed").alias("dst"), F.col("dist").alias("length"))


_READ_BACK = """, pairs AS (SELECT DISTINCT node AS src, seed AS dst FROM reach WHERE node IN (SELECT src FROM {ends}) AND node <> seed),
fore AS (SELECT DISTINCT src AS s, src AS node, 0 AS dist FROM pairs UNION SELECT f.s, c.dst, f.dist + 1 FROM fore f JOIN {edges} c ON c.src = f.node WHERE f.dist < {depth}),
least AS (SELECT s, node, min(dist) AS dist FROM fore GROUP BY s, node),
preds AS (SELECT b.s, b.node, min(a.node) AS before FROM least b JOIN {edges} c ON c.dst = b.node JOIN least a ON a.s = b.s AND a.node = c.src AND a.dist = b.dist - 1 GROUP BY b.s, b.node),
chains AS (
  SELECT p.src, p.dst, l.dist AS length, q.before, [p.dst] AS chain FROM pairs p JOIN least l ON l.s = p.src AND l.node = p.dst JOIN preds q ON q.s = p.src AND q.node = p.dst
  UNION ALL SELECT c.src, c.dst, c.length, q.before, list_prepend(c.before, c.chain) FROM chains c LEFT JOIN preds q ON q.s = c.src AND q.node = c.before WHERE c.before IS NOT NULL),
told AS (SELECT src, dst, length, chain, array_to_string(list_transform(chain[2:len(chain) - 1], lambda x: regexp_extract(x, '""" + names.METHOD_FQN + """', 2)), ' > ') AS via FROM chains WHERE before IS NULL)"""
_TYPED = """, steps AS (SELECT src, dst, unnest(range(1, len(chain))) AS n, chain FROM told),
named AS (SELECT s.src, s.dst, string_agg(e.etype, ' > ' ORDER BY n) AS types FROM steps s JOIN {edges} e ON e.src = chain[n] AND e.dst = chain[n + 1] GROUP BY ALL)
SELECT t.src, t.dst, length, via, types FROM told t JOIN named m ON m.src = t.src AND m.dst = t.dst"""


def _told(chains: DataFrame, *more: Column) -> DataFrame:
    between = F.slice("chain", 2, F.greatest(F.col("length") - 1, F.lit(0)))
    return chains.select("src", "dst", "length", F.array_join(F.transform(between, names.method_simple), " > ").alias("via"), *more)


@query(_with(METHODS, CALLS, INPUTS, BACK1, REACH, LINKS, URLS) + _READ_BACK.format(ends="method_urls", edges="calls", depth=DEPTH) + " SELECT src, dst, length, via FROM told")
def shortest_chain(g: Graph) -> DataFrame:
    """The chains themselves: simple names between the ends, for every entry point and changed method within reach."""
    reach = g.backward(DEPTH, with_seed=False).where("node <> seed")
    pairs = reach.join(g.method_urls.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("src"), F.col("seed").alias("dst"))
    return _told(traverse.shortest_chains(pairs, g.calls, DEPTH))


_THREADS = r"""
starts AS (SELECT DISTINCT c.src, m.fqn AS dst FROM calls c JOIN tasks t ON c.dst LIKE t.class_fqn || '.<init>(%' JOIN methods m ON m.owner = t.class_fqn AND m.n_params = 0 AND m.simple <> '<init>'),
threaded AS (SELECT src, dst, min(etype) AS etype FROM (SELECT src, dst, 'CALLS' AS etype FROM calls UNION ALL SELECT src, dst, 'STARTS_THREAD' FROM starts) GROUP BY src, dst)"""
_WALK = "walk AS (SELECT DISTINCT s.seed, c.{to} AS node, 1 AS dist FROM seeds s JOIN {edges} c ON c.{at} = s.seed UNION SELECT r.seed, c.{to}, r.dist + 1 FROM walk r JOIN {edges} c ON c.{at} = r.node WHERE r.dist < {depth})"


@query(_with(METHODS, CALLS, INPUTS, LINKS, URLS, _THREADS, _WALK.format(edges="threaded", at="src", to="dst", depth=DEPTH)) + "SELECT DISTINCT s.seed AS fqn, w.node AS reachable FROM seeds s LEFT JOIN walk w ON w.seed = s.seed")
def forward_reach_list(g: Graph) -> DataFrame:
    """What every changed method reaches over calls and started threads, a row each; a null for those that reach nothing."""
    reach = traverse.bfs(g.seeds, g.typed_edges("CALLS", "STARTS_THREAD"), DEPTH, with_seed=False).select("seed", F.col("node").alias("reachable"))
    return g.seeds.join(reach, "seed", "left").select(F.col("seed").alias("fqn"), "reachable")


def _chains_from(g: Graph, edges: DataFrame, ends: DataFrame) -> DataFrame:
    edges = g.space.put(edges)
    reach = traverse.bfs(g.seeds, edges, DEPTH, backward=True, with_seed=False).where("node <> seed")
    pairs = reach.join(ends.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("src"), F.col("seed").alias("dst"))
    return _told(traverse.chain_types(traverse.shortest_chains(pairs, edges, DEPTH), edges), F.array_join("types", " > ").alias("types"))


@query(
    _with(METHODS, CALLS, INPUTS, LINKS, URLS, _THREADS, _WALK.format(edges="threaded", at="dst", to="src", depth=DEPTH), REACH)
    + _READ_BACK.format(ends="method_tasks", edges="threaded", depth=DEPTH) + _TYPED.format(edges="threaded")
)
def shortest_chain_schedule(g: Graph) -> DataFrame:
    """Chains from the methods of tasks to the changed methods, over calls and started threads, with the types of their edges."""
    return _chains_from(g, g.typed_edges("CALLS", "STARTS_THREAD"), g.method_tasks)


@query(
    _with(METHODS, CALLS, INPUTS, LINKS, ANCESTORS, _TYPES, URLS, _THREADS, _ALL_EDGES, _WALK.format(edges="linked", at="dst", to="src", depth=DEPTH), REACH)
    + _READ_BACK.format(ends="method_urls", edges="linked", depth=DEPTH) + _TYPED.format(edges="linked")
)
def shortest_chain_typed(g: Graph) -> DataFrame:
    """Chains from the entry points to the changed methods over calls, started threads and overrides, with the types of their edges."""
    return _chains_from(g, g.typed_edges("CALLS", "STARTS_THREAD", "OVERRIDES"), g.method_urls)


@query(
    _with(METHODS, CALLS, INPUTS, FORE0, LINKS, URLS, ACCESS, _THREADS)
    + """, effects AS (
  SELECT DISTINCT seed, lower(access) || ' ' || name AS effect FROM walk JOIN table_access a ON a.src = node
  UNION SELECT DISTINCT seed, 'runs ' || task FROM walk JOIN method_tasks t ON t.src = node
  UNION SELECT DISTINCT seed, 'exposes ' || url FROM walk JOIN method_urls u ON u.src = node
  UNION SELECT DISTINCT seed, 'starts ' || dst FROM walk JOIN starts s ON s.src = node
  UNION SELECT DISTINCT seed, CASE WHEN kind = 'notification-macro' THEN 'notifies ' ELSE 'reflects ' END || to_method_fqn FROM walk JOIN call_edges e ON e.from_method_fqn = node
    WHERE to_method_fqn IS NOT NULL AND (kind = 'notification-macro' OR starts_with(kind, 'reflect-'))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed, split_part(effect, ' ', 1) ORDER BY effect) AS n FROM effects)
SELECT seed, string_agg(effect, '; ' ORDER BY effect) AS effects FROM ranked WHERE n <= 3 GROUP BY seed"""
)
def side_effects(g: Graph) -> DataFrame:
    """Of each kind of effect below a changed method the first three, as text."""
    walk = g.space.put(g.forward(TABLE_DEPTH).select("seed", "node"))
    effect = lambda edges, text: walk.join(edges.withColumnRenamed("src", "node"), "node").select("seed", text.alias("effect"))
    both = (
        effect(g.table_access, F.concat(F.lower("access"), F.lit(" "), "name"))
        .unionByName(effect(g.method_tasks, F.concat(F.lit("runs "), "task"))).unionByName(effect(g.method_urls, F.concat(F.lit("exposes "), "url")))
    )
    sent = g.table("call_edges").where(F.col("to_method_fqn").isNotNull() & ((F.col("kind") == "notification-macro") | F.col("kind").startswith("reflect-"))).select(
        F.col("from_method_fqn").alias("src"), F.when(F.col("kind") == "notification-macro", "notifies ").otherwise("reflects ").alias("how"), "to_method_fqn"
    ).distinct()
    both = both.unionByName(effect(g.starts_thread, F.concat(F.lit("starts "), "dst"))).unionByName(effect(sent, F.concat("how", "to_method_fqn"))).distinct()
    kinds = both.groupBy("seed", F.substring_index("effect", " ", 1).alias("kind")).agg(F.slice(F.array_sort(F.collect_set("effect")), 1, 3).alias("top"))
    return kinds.groupBy("seed").agg(F.array_join(F.array_sort(F.flatten(F.collect_list("top"))), "; ").alias("effects"))


_ENTRIES = """, below AS (SELECT DISTINCT seed, node FROM walk UNION SELECT seed, seed FROM seeds),
evidence AS (SELECT DISTINCT b.seed, b.node AS entry, u.url FROM below b JOIN method_urls u ON u.src = b.node
  UNION ALL SELECT DISTINCT s.seed, NULL, c.url FROM seeds s JOIN methods m ON m.fqn = s.seed JOIN class_urls c ON c.class_fqn = m.owner)"""


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + _ENTRIES
    + """ SELECT url, count(*) AS count, ['LOW','MEDIUM','HIGH'][max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)] AS risk, count(DISTINCT seed) AS n_methods, min(entry) AS first_entry
FROM evidence LEFT JOIN risks ON fqn = seed GROUP BY url"""
)
def affected_api(g: Graph) -> DataFrame:
    walk = g.space.put(g.backward(DEPTH, with_seed=False))
    changed = g.methods.join(g.seeds.withColumnRenamed("seed", "fqn"), "fqn", "left_semi")
    risks = slices.risk(walk, g.method_urls, g.method_tasks, changed, SENSITIVE)
    reach = walk.select("seed", "node").unionByName(g.seeds.select("seed", F.col("seed").alias("node"))).distinct()
    entries = reach.join(g.method_urls.withColumnRenamed("src", "node"), "node").select("seed", F.col("node").alias("entry"), "url")
    own = changed.select(F.col("fqn").alias("seed"), F.col("owner").alias("class_fqn")).join(g.class_urls, "class_fqn").select("seed", "url")
    return report.affected_apis(entries, risks, own)


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + _ENTRIES
    + """, points AS (SELECT DISTINCT b.seed, b.node, t.task FROM below b JOIN method_tasks t ON t.src = b.node)
SELECT task, count(*) AS count, ['LOW','MEDIUM','HIGH'][max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)] AS risk, count(DISTINCT seed) AS n_methods FROM points LEFT JOIN risks ON fqn = seed GROUP BY task"""
)
def affected_schedules(g: Graph) -> DataFrame:
    walk = g.space.put(g.backward(DEPTH, with_seed=False))
    changed = g.methods.join(g.seeds.withColumnRenamed("seed", "fqn"), "fqn", "left_semi")
    risks = slices.risk(walk, g.method_urls, g.method_tasks, changed, SENSITIVE)
    reach = walk.select("seed", "node").unionByName(g.seeds.select("seed", F.col("seed").alias("node"))).distinct()
    return report.affected_schedules(slices.schedule_points(reach, g.method_tasks), risks)


@query(
    _with(METHODS, CALLS, INPUTS, FORE0, ACCESS)
    + """, t AS (SELECT DISTINCT name, access FROM walk JOIN table_access a ON a.src = node)
SELECT (SELECT count(DISTINCT name) FROM t) AS n_tables, (SELECT count(*) FROM t WHERE access = 'READS_TABLE') AS n_read, (SELECT count(*) FROM t WHERE access = 'WRITES_TABLE') AS n_written,
  (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM (SELECT DISTINCT name FROM t ORDER BY name LIMIT 20)) AS sample"""
)
def layer_summary(g: Graph) -> DataFrame:
    hits = g.forward(TABLE_DEPTH).select("node").distinct().join(g.table_access.withColumnRenamed("src", "node"), "node")
    return report.layer_summary(hits)


@query(_with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + " SELECT coalesce(['LOW','MEDIUM','HIGH'][max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END)], 'LOW') AS risk FROM risks")
def overall_risk(g: Graph) -> DataFrame:
    return report.overall_risk(_risks(g))


_JSON = " SELECT fqn, to_json({'fqn': fqn, 'impact': {'risk': risk, 'entry_count': entry_count, 'n_entries': n_entries, 'urls': list_filter(string_split(urls, ' '), lambda u: u <> ''), 'n_tasks': n_tasks}})::VARCHAR AS report FROM summary"


@query(_with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + _SUMMARY.replace("\nSELECT x.fqn", ",\nsummary AS (SELECT x.fqn") + ")" + _JSON)
def report_json(g: Graph) -> DataFrame:
    """The report of every changed method as JSON."""
    return report.json_lines(impact_summary(g))
