"""Queries of the joins, merges, resolution cascades, aggregates, projections and text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import intervals, merge, resolve
from wakegraph.plans import tagging
from wakegraph.plans.graph import ACTION_BASE, TASK_BASE, Graph
from wakegraph.queries.impact import ACCESS, ANCESTORS, CALLS, COVERS, INPUTS, LINKS, METHODS, URLS, _with

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, base: f(Graph(spark, base))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- merges -------------------------------------------------------------------------------------------------------


def _early_late(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Method rows recorded before 2024-07 as what exists, the later ones as the batch, in order of recording."""
    rows = g.table("method_nodes").where("fqn is not null").select("fqn", "return_type", "start_line", F.unix_micros(F.col("recorded_at").cast("timestamp")).alias("ord"))
    early = rows.where(F.col("ord") < 1719792000000000)
    return merge.last_row(early.select("fqn", "ord", "return_type", "start_line"), ["fqn"], "ord").drop("ord").select("fqn", "return_type", "start_line"), rows.where(F.col("ord") >= 1719792000000000)


_EARLY = """early AS (SELECT fqn, return_type, start_line FROM method_nodes WHERE fqn IS NOT NULL AND recorded_at < TIMESTAMP '2024-07-01'
  QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY recorded_at DESC, return_type DESC NULLS LAST, start_line DESC NULLS LAST) = 1),
late AS (SELECT fqn, return_type, start_line, recorded_at FROM method_nodes WHERE fqn IS NOT NULL AND recorded_at >= TIMESTAMP '2024-07-01')"""


@query(
    _with(_EARLY)
    + """SELECT fqn, return_type, start_line FROM (SELECT *, 1 AS p FROM late UNION ALL SELECT *, NULL, 0 FROM early)
QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY p DESC, recorded_at DESC NULLS LAST, return_type DESC NULLS LAST, start_line DESC NULLS LAST) = 1"""
)
def merge_last_wins(g: Graph) -> DataFrame:
    existing, batch = _early_late(g)
    return merge.merge_set(existing, batch, ["fqn"], "ord")


@query(
    _with(_EARLY)
    + """SELECT * FROM early UNION ALL SELECT fqn, return_type, start_line FROM late WHERE fqn NOT IN (SELECT fqn FROM early)
QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY recorded_at, return_type NULLS FIRST, start_line NULLS FIRST) = 1"""
)
def merge_on_create(g: Graph) -> DataFrame:
    existing, batch = _early_late(g)
    return merge.merge_create(existing, batch, ["fqn"], "ord")


@query(
    _with(_EARLY)
    + """, batch AS (SELECT fqn, max(return_type) AS return_type, max(start_line) AS start_line FROM late GROUP BY fqn)
SELECT coalesce(e.fqn, b.fqn) AS fqn, coalesce(e.return_type, b.return_type) AS return_type, coalesce(b.start_line, e.start_line) AS start_line
FROM early e FULL JOIN batch b ON e.fqn = b.fqn"""
)
def merge_coalesce(g: Graph) -> DataFrame:
    existing, batch = _early_late(g)
    new = batch.groupBy("fqn").agg(F.max("return_type").alias("return_type"), F.max("start_line").alias("start_line"))
    return merge.merge_coalesce(existing, new, ["fqn"], ["start_line"])


@query("SELECT DISTINCT from_method_fqn AS src, to_method_fqn AS dst, kind FROM call_edges WHERE from_method_fqn IS NOT NULL AND to_method_fqn IS NOT NULL")
def merge_edges_by_kind(g: Graph) -> DataFrame:
    e = g.table("call_edges").where("from_method_fqn is not null and to_method_fqn is not null").select(F.col("from_method_fqn").alias("src"), F.col("to_method_fqn").alias("dst"), "kind", "recorded_at")
    half = F.col("recorded_at") < F.lit("2024-10-01").cast("timestamp_ntz")
    return merge.merge_edges(e.where(half), e.where(~half | F.col("recorded_at").isNull()), ["src", "dst", "kind"])


@query(
    _with(METHODS, LINKS)
    + f"""SELECT DISTINCT CASE WHEN f IS NULL THEN 'class' ELSE 'method' END AS level, coalesce(f, o) AS source, 'servlet:' || o || '/' || simple AS url
FROM (SELECT child AS o, simple FROM links CROSS JOIN (VALUES ('execute'), ('<init>'), ('doGet')) v(simple) WHERE parent = '{ACTION_BASE}')
LEFT JOIN (SELECT owner, simple AS s, min(fqn) AS f FROM methods GROUP BY ALL) ON owner = o AND s = simple"""
)
def resolve_or_fallback(g: Graph) -> DataFrame:
    """URLs claimed for three method names of every action: on the method where there is one, else on the class."""
    wanted = F.explode(F.array(*[F.lit(x) for x in ("execute", "<init>", "doGet")]))
    claims = g.hierarchy.where(F.col("parent") == ACTION_BASE).select(F.col("child").alias("owner"), wanted.alias("simple"))
    claims = claims.withColumn("url", F.concat(F.lit("servlet:"), "owner", F.lit("/"), "simple"))
    return merge.resolve_or_fallback(claims, g.methods)


_USES = r"""uses AS (SELECT DISTINCT path AS user_id, unnest(regexp_extract_all(content, '/api/[A-Za-z0-9_/]+')) AS used FROM repo_files WHERE content IS NOT NULL),
ends AS (SELECT DISTINCT unnest(regexp_extract_all(content, '/api/[A-Za-z0-9_/]+(?:\?[A-Za-z0-9_=&;]+)?')) AS url FROM repo_files WHERE content IS NOT NULL)"""


@query("WITH " + _USES + " SELECT DISTINCT user_id AS \"user\", url FROM uses JOIN ends ON url = used OR starts_with(url, used || '?')")
def prefix_link(g: Graph) -> DataFrame:
    """Files linked to the endpoints that they name, exactly or before a query."""
    uses = g.table("repo_files").select(F.col("path").alias("user"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("/api/[A-Za-z0-9_/]+"), 0))).alias("used"))
    ends = g.table("repo_files").select(F.explode(F.regexp_extract_all("content", F.lit(r"/api/[A-Za-z0-9_/]+(?:\?[A-Za-z0-9_=&;]+)?"), 0)).alias("url")).distinct()
    return merge.link_by_prefix(uses, ends)


@query(_with(METHODS, CALLS) + "SELECT src, dst FROM calls WHERE src IN (SELECT fqn FROM methods) AND dst IN (SELECT fqn FROM methods)")
def endpoint_required(g: Graph) -> DataFrame:
    keys = g.methods.select(F.col("fqn").alias("key"))
    return merge.endpoint_required(g.calls, keys, keys).select("src", "dst")


@query(_with(METHODS, CALLS) + "SELECT fqn AS key FROM methods UNION SELECT dst FROM calls")
def endpoint_creating(g: Graph) -> DataFrame:
    return merge.endpoint_creating(g.methods.select(F.col("fqn").alias("key")), g.calls, "dst")


@query(
    _with(METHODS)
    + """SELECT t.symbol_id, m.owner AS class_fqn FROM (SELECT symbol_id, split_part(replace(fqn, '$', '.'), '.', -1) AS s FROM changed_symbols WHERE kind IN ('CLASS', 'INTERFACE')) t
JOIN (SELECT DISTINCT owner FROM methods) m ON split_part(m.owner, '.', -1) = t.s"""
)
def simple_name_fanout(g: Graph) -> DataFrame:
    """Changed types to every class of their simple name."""
    types = g.table("changed_symbols").where(F.col("kind").isin("CLASS", "INTERFACE")).select("symbol_id", names.simple_name(F.regexp_replace("fqn", r"\$", ".")).alias("s"))
    classes = g.methods.where("owner is not null").select(F.col("owner").alias("class_fqn"), names.simple_name(F.col("owner")).alias("s")).distinct()
    return types.join(classes, "s").select("symbol_id", "class_fqn")


@query(
    _with(METHODS, LINKS)
    + f"""SELECT fqn, array_to_string(list_sort(list_distinct(list_concat(labels, CASE WHEN owner IN (SELECT child FROM links WHERE parent = '{TASK_BASE}') THEN ['Scheduled'] ELSE [] END))), ',') AS labels FROM methods"""
)
def dynamic_labels(g: Graph) -> DataFrame:
    extra = g.method_tasks.select(F.col("src").alias("fqn"), F.explode(F.array(F.lit("Scheduled"), F.lit("not a label"))).alias("label"))
    return merge.add_labels(g.methods.select("fqn", "labels"), "fqn", "labels", extra).select("fqn", F.array_join("labels", ",").alias("labels"))


@query(
    """WITH e AS (SELECT DISTINCT o_orderkey AS src, CAST(o_custkey AS VARCHAR) AS dst FROM orders),
p AS (SELECT *, 'p' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '.MessageConstants' ELSE '.OtherConstants' END AS o FROM part),
k AS (SELECT o, p_brand AS n, CAST(p_partkey AS VARCHAR) AS v FROM p UNION ALL SELECT o, p_type, CAST(p_size AS VARCHAR) FROM p),
t AS (SELECT v, CASE WHEN ends_with(o, '.MessageConstants') THEN 1 ELSE 2 END AS tier, count(DISTINCT o || '.' || n) AS c, min(o || '.' || n) AS target FROM k GROUP BY ALL),
b AS (SELECT v, target, c FROM t QUALIFY tier = min(tier) OVER (PARTITION BY v))
SELECT DISTINCT src, coalesce(target, dst) AS dst FROM e LEFT JOIN (SELECT v, target FROM b WHERE c = 1) ON v = dst"""
)
def rekey_constants(g: Graph) -> DataFrame:
    """Ids replaced by the only constant that has their value, preferred owners first: a part's key is a constant's value, its size that of many."""
    edges = g.table("orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").cast("string").alias("dst")).distinct()
    owner = F.concat(F.lit("p"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, ".MessageConstants").otherwise(".OtherConstants"))
    by_key = g.table("part").select(owner.alias("owner"), F.col("p_brand").alias("name"), F.col("p_partkey").cast("string").alias("value"))
    by_size = g.table("part").select(owner.alias("owner"), F.col("p_type").alias("name"), F.col("p_size").cast("string").alias("value"))
    return merge.rekey_unique(edges, by_key.unionByName(by_size), [".MessageConstants"])


@query(
    _with(METHODS, CALLS, LINKS, ANCESTORS)
    + """, typed AS (SELECT fqn, owner, simple, string_split(regexp_extract(fqn, '\\((.*)\\)$', 1), ',') AS types FROM methods WHERE n_params IS NOT NULL AND simple <> '<init>')
SELECT DISTINCT c.src, s.fqn AS dst FROM calls c JOIN typed b ON b.fqn = c.dst JOIN ancestors h ON h.ancestor = b.owner
JOIN typed s ON s.owner = h.child AND s.simple = b.simple AND s.types = b.types"""
)
def dispatch_bridge(g: Graph) -> DataFrame:
    """Callers of a method linked to all methods that override it."""
    return g.calls.join(g.overrides.select(F.col("dst"), F.col("src").alias("below")), "dst").select("src", F.col("below").alias("dst")).distinct()


@query("SELECT DISTINCT from_method_fqn AS src, to_method_fqn AS dst FROM call_edges WHERE from_method_fqn IS NOT NULL AND to_method_fqn IS NOT NULL AND NOT regexp_matches(to_method_fqn, '^java\\.lang\\.Thread\\.|\\.run\\(\\)$')")
def stale_edges_removed(g: Graph) -> DataFrame:
    doomed = g.calls.where(F.col("dst").rlike(r"^java\.lang\.Thread\.|\.run\(\)$"))
    return g.calls.join(doomed, ["src", "dst"], "left_anti")


@query(
    _with(METHODS, CALLS)
    + """, gone AS (SELECT fqn FROM methods WHERE commit_sha IN (SELECT min(commit_sha) FROM commit_nodes GROUP BY repo_id))
SELECT 'methods' AS what, (SELECT count(*) FROM methods WHERE fqn NOT IN (SELECT fqn FROM gone)) AS n
UNION ALL SELECT 'calls', (SELECT count(*) FROM calls WHERE src NOT IN (SELECT fqn FROM gone) AND dst NOT IN (SELECT fqn FROM gone))"""
)
def wipe_commits(g: Graph) -> DataFrame:
    """What is left after the least commit of each repository has been wiped with its edges."""
    wiped = g.table("commit_nodes").groupBy("repo_id").agg(F.min("commit_sha").alias("commit_sha")).select("commit_sha").distinct().withColumn("doomed", F.lit(True))
    nodes, edges = merge.delete_nodes(g.methods.join(wiped, "commit_sha", "left"), g.calls, "fqn", F.col("doomed"))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(nodes, "methods").unionByName(count(edges, "calls"))


@query(
    _with(METHODS, CALLS, LINKS, URLS, ACCESS)
    + """, r AS (SELECT min(repo_id) AS repo FROM commit_nodes),
own AS (SELECT DISTINCT commit_sha FROM commit_nodes WHERE repo_id = (SELECT repo FROM r)),
kept AS (SELECT fqn FROM methods WHERE commit_sha IS NULL OR commit_sha NOT IN (SELECT commit_sha FROM own)),
edges AS (SELECT src, dst FROM calls WHERE src NOT IN (SELECT fqn FROM methods WHERE fqn NOT IN (SELECT fqn FROM kept)) AND dst NOT IN (SELECT fqn FROM methods WHERE fqn NOT IN (SELECT fqn FROM kept))),
used AS (SELECT src AS k FROM edges UNION SELECT dst FROM edges)
SELECT (SELECT count(*) FROM methods) - (SELECT count(*) FROM kept) AS n_wiped, (SELECT count(*) FROM edges) AS n_edges,
  (SELECT count(*) FROM kept WHERE ends_with(fqn, '(?)') AND fqn NOT IN (SELECT k FROM used)) AS n_idle_placeholders,
  (SELECT count(*) FROM file_nodes WHERE repo_id = (SELECT repo FROM r)) AS n_files,
  (SELECT count(*) FROM own WHERE commit_sha NOT IN (SELECT commit_sha FROM commit_nodes WHERE repo_id <> (SELECT repo FROM r))) AS n_commits,
  (SELECT count(DISTINCT name) FROM table_access WHERE name NOT IN (SELECT name FROM table_access WHERE src NOT IN (SELECT fqn FROM methods WHERE fqn NOT IN (SELECT fqn FROM kept)))) AS n_tables,
  (SELECT count(DISTINCT url) FROM method_urls WHERE url NOT IN (SELECT url FROM method_urls WHERE src IN (SELECT fqn FROM kept))) AS n_endpoints"""
)
def wipe_repo_cascade(g: Graph) -> DataFrame:
    """The least repository wiped: its methods and their edges, placeholders, tables and endpoints that nothing refers to
    any more, its files, and the commits that no other repository has."""
    commits = g.table("commit_nodes")
    repo = commits.agg(F.min("repo_id").alias("repo_id"))  # one row
    own = commits.join(F.broadcast(repo), "repo_id", "left_semi").select("commit_sha").distinct()
    marked = g.space.put(g.methods.select("fqn", "commit_sha").join(own.withColumn("doomed", F.lit(True)), "commit_sha", "left"))
    gone = marked.where("doomed").select(F.col("fqn").alias("src"))
    kept, edges = merge.delete_nodes(marked, g.calls, "fqn", F.col("doomed"))
    edges = g.space.put(edges)
    used = edges.select(F.col("src").alias("fqn")).union(edges.select("dst")).distinct()
    idle = kept.where(F.col("fqn").endswith("(?)")).join(used, "fqn", "left_anti")
    elsewhere = commits.join(F.broadcast(repo), "repo_id", "left_anti").where("repo_id is not null").select("commit_sha").distinct()
    unreferenced = lambda edges, name: edges.select(name).distinct().join(edges.join(gone, "src", "left_anti").select(name).distinct(), name, "left_anti")
    counted = {
        "n_wiped": gone, "n_edges": edges, "n_idle_placeholders": idle, "n_files": g.table("file_nodes").join(F.broadcast(repo), "repo_id", "left_semi"),
        "n_commits": own.join(elsewhere, "commit_sha", "left_anti"), "n_tables": unreferenced(g.table_access, "name"), "n_endpoints": unreferenced(g.method_urls, "url"),
    }
    out = None
    for name, df in counted.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows of one number
    return out


@query("SELECT commit_sha, repo_id, count(*) AS n_rows FROM commit_nodes GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(g: Graph) -> DataFrame:
    return merge.duplicate_keys(g.table("commit_nodes"), ["commit_sha", "repo_id"])


_RULES = """rules AS (SELECT symbol_id AS ord, patch_id % 50 AS test_id, CASE WHEN symbol_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, 'FILE' AS kind,
  split_part(replace(file_path, chr(92), '/'), '/', -1) AS key FROM changed_symbols WHERE file_path IS NOT NULL),
covers AS (SELECT DISTINCT (length(path) % 50)::BIGINT AS test_id, 'FILE' AS kind, split_part(replace(path, chr(92), '/'), '/', -1) AS key, 0.6::DOUBLE AS confidence FROM repo_files)"""


@query(
    "WITH " + _RULES
    + """, last AS (SELECT test_id, kind, key, arg_max(op, ord) AS op FROM rules GROUP BY ALL)
SELECT coalesce(c.test_id, l.test_id) AS test_id, coalesce(c.kind, l.kind) AS kind, coalesce(c.key, l.key) AS key, CASE WHEN op = 'add' THEN 1.0 ELSE confidence END AS confidence
FROM covers c FULL JOIN last l ON c.test_id = l.test_id AND c.kind = l.kind AND c.key = l.key WHERE op IS NULL OR op = 'add'"""
)
def glossary_apply(g: Graph) -> DataFrame:
    """Rules drawn from the changed files applied, in order, to covers drawn from the repository's files."""
    name = lambda c: F.substring_index(F.translate(c, "\\", "/"), "/", -1)
    rules = g.table("changed_symbols").where("file_path is not null").select(
        F.col("symbol_id").alias("ord"), (F.col("patch_id") % 50).alias("test_id"), F.when(F.col("symbol_id") % 3 == 0, "remove").otherwise("add").alias("op"), F.lit("FILE").alias("kind"), name("file_path").alias("key")
    )
    covers = g.table("repo_files").select((F.length("path") % 50).cast("long").alias("test_id"), F.lit("FILE").alias("kind"), name("path").alias("key"), F.lit(0.6).alias("confidence")).distinct()
    return merge.apply_rules(covers, rules)


@query(
    _with(METHODS, COVERS)
    + """, rules AS (SELECT symbol_id AS ord, patch_id % 50 AS test_id, CASE WHEN symbol_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, 'METHOD' AS kind, split_part(fqn, '(', 1) AS key
  FROM changed_symbols WHERE kind = 'METHOD' AND fqn IS NOT NULL),
expanded AS (SELECT ord, test_id, op, kind, coalesce(m.fqn, r.key) AS key FROM rules r LEFT JOIN methods m ON starts_with(m.fqn, r.key || '(')),
known AS (SELECT DISTINCT test_id % 50 AS test_id, kind, key, confidence FROM covers),
last AS (SELECT test_id, kind, key, arg_max(op, ord) AS op FROM expanded GROUP BY ALL)
SELECT coalesce(c.test_id, l.test_id) AS test_id, coalesce(c.kind, l.kind) AS kind, coalesce(c.key, l.key) AS key, CASE WHEN op = 'add' THEN 1.0 ELSE confidence END AS confidence
FROM known c FULL JOIN last l ON c.test_id = l.test_id AND c.kind = l.kind AND c.key = l.key WHERE op IS NULL OR op = 'add'"""
)
def glossary_methods(g: Graph) -> DataFrame:
    """Rules on changed methods without their parameters, for all overloads, applied in order to the covers of the tests."""
    rules = g.table("changed_symbols").where("kind = 'METHOD' and fqn is not null").select(
        F.col("symbol_id").alias("ord"), (F.col("patch_id") % 50).alias("test_id"), F.when(F.col("symbol_id") % 3 == 0, "remove").otherwise("add").alias("op"), F.lit("METHOD").alias("kind"), F.substring_index("fqn", "(", 1).alias("key")
    )
    covers = tagging.covers_of(g).withColumn("test_id", F.col("test_id") % 50).distinct()
    return merge.apply_rules(covers, rules, g.methods)


# --- joins --------------------------------------------------------------------------------------------------------


@query(_with(METHODS, CALLS) + "SELECT dst AS fqn, count(*) AS n_callers FROM calls WHERE dst NOT IN (SELECT fqn FROM methods) GROUP BY dst")
def phantom_targets(g: Graph) -> DataFrame:
    """Call targets without a method row, with their distinct callers."""
    return g.calls.join(g.methods.select(F.col("fqn").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("fqn")).agg(F.count(F.lit(1)).alias("n_callers"))


@query(
    """WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM documents WHERE doc_kind = 'impact_report'),
c AS (SELECT DISTINCT owner_fqn AS class_fqn FROM method_nodes WHERE owner_fqn IS NOT NULL)
SELECT doc_id, min(class_fqn) AS class_fqn FROM t JOIN c ON ends_with(class_fqn, '.' || w) GROUP BY doc_id, w"""
)
def suffix_link(g: Graph) -> DataFrame:
    """Words of reports to the least class whose name ends with them: an equi-join on the last part."""
    words = g.table("documents").where("doc_kind = 'impact_report'").select("doc_id", F.explode(F.array_distinct(names.identifiers(F.col("text")))).alias("w"))
    classes = g.methods.where("owner is not null").select(F.col("owner").alias("class_fqn"), names.simple_name(F.col("owner")).alias("w")).where(F.col("class_fqn").contains(".")).distinct()
    return words.join(classes, "w").groupBy("doc_id", "w").agg(F.min("class_fqn").alias("class_fqn")).select("doc_id", "class_fqn")


_HUNKS = r"""paths AS (SELECT symbol_id, kind, start_line, end_line, hunk_start_line, hunk_end_line, coalesce(nullif(regexp_extract(p, '(?:^|/)java/(.+)\.[^./]*$', 1), ''), regexp_extract(p, '^(.*)\.[^./]*$', 1)) AS c
  FROM (SELECT *, regexp_replace(replace(file_path, chr(92), '/'), '^(?:\./|[ab]/)', '') AS p FROM changed_symbols WHERE file_path IS NOT NULL)),
syms AS (SELECT fqn, replace(regexp_extract(owner, '^((?:[a-z_]\w*\.)*[A-Z]\w*)', 1), '.', '/') AS f, start_line AS s_start, end_line AS s_end FROM methods WHERE start_line <= end_line AND regexp_extract(owner, '^((?:[a-z_]\w*\.)*[A-Z]\w*)', 1) <> ''),
placed AS (SELECT DISTINCT p.c, s.f FROM (SELECT DISTINCT c FROM paths WHERE c <> '') p JOIN (SELECT DISTINCT f FROM syms) s ON s.f = p.c OR ends_with(s.f, '/' || p.c) OR ends_with(p.c, '/' || s.f)),
hunks AS (SELECT symbol_id, f, hunk_start_line AS h_start, hunk_end_line AS h_end FROM paths JOIN placed USING (c) WHERE hunk_start_line <= hunk_end_line)"""


def _hunks_and_symbols(g: Graph, start: str = "hunk_start_line", end: str = "hunk_end_line", kinds: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Line ranges of the changed symbols and of the methods, in the source files that both name.

    Paths are written in many ways: the two mean one file if one ends with the other, whole parts of it.
    """
    top = F.regexp_extract("owner", r"^((?:[a-z_]\w*\.)*[A-Z]\w*)", 1)
    symbols = g.methods.select("fqn", F.translate(top, ".", "/").alias("file_path"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end")).where("file_path <> ''")
    changed = g.table("changed_symbols").where("file_path is not null")
    changed = changed.where(F.col("kind").isin(*kinds)) if kinds else changed
    ranges = changed.select("symbol_id", names.source_path(F.col("file_path")).alias("c"), F.col(start).alias("h_start"), F.col(end).alias("h_end"))
    known = symbols.where("s_start <= s_end").select("file_path").distinct()
    last = lambda c: F.substring_index(c, "/", -1)
    met = ranges.select("c").where("c <> ''").distinct().withColumn("k", last("c")).join(known.withColumn("k", last("file_path")), "k")
    slash = lambda c: F.concat(F.lit("/"), c)
    placed = met.where((F.col("c") == F.col("file_path")) | F.col("file_path").endswith(slash(F.col("c"))) | F.col("c").endswith(slash(F.col("file_path")))).select("c", "file_path")
    return ranges.join(placed, "c").drop("c"), symbols


@query(
    _with(METHODS, _HUNKS)
    + "SELECT symbol_id, arg_min(fqn, (s_end - s_start, s_start, fqn)) AS fqn FROM hunks JOIN syms USING (f) WHERE s_start <= h_start AND h_end <= s_end GROUP BY symbol_id"
)
def interval_smallest_enclosing(g: Graph) -> DataFrame:
    return intervals.smallest_enclosing(*_hunks_and_symbols(g), "symbol_id", "fqn")


@query(
    _with(METHODS, _HUNKS)
    + r"""SELECT DISTINCT symbol_id, s.fqn FROM paths JOIN placed USING (c) JOIN syms s USING (f)
WHERE kind IN ('CLASS', 'INTERFACE') AND start_line <= s_start AND s_end <= end_line"""
)
def interval_inside(g: Graph) -> DataFrame:
    """Methods within the lines of the changed types."""
    return intervals.inside(*_hunks_and_symbols(g, "start_line", "end_line", ("CLASS", "INTERFACE")), "symbol_id", "fqn")


@query(_with(METHODS, _HUNKS) + "SELECT symbol_id, fqn FROM hunks JOIN syms USING (f) WHERE h_start <= s_end AND s_start <= h_end")
def hunk_overlap(g: Graph) -> DataFrame:
    return intervals.overlapping(*_hunks_and_symbols(g)).select("symbol_id", "fqn")


@query(
    _with(METHODS, _HUNKS)
    + """, p AS (SELECT *, CASE WHEN h_start <= s_start AND s_end <= h_end THEN 1 WHEN s_start <= h_start AND h_end <= s_end THEN 2 ELSE 3 END AS rule
  FROM hunks JOIN syms USING (f) WHERE h_start <= s_end AND s_start <= h_end),
b AS (SELECT * FROM p QUALIFY rule = min(rule) OVER (PARTITION BY symbol_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY s_end - s_start, s_start, fqn) AS k FROM b)
SELECT DISTINCT symbol_id, fqn, rule FROM n WHERE rule <> 2 OR k = 1"""
)
def touched_symbols(g: Graph) -> DataFrame:
    return intervals.touched_symbols(*_hunks_and_symbols(g), "symbol_id", "fqn")


@query(
    _with(METHODS, CALLS, LINKS)
    + r"""SELECT DISTINCT c.src, m.fqn AS dst FROM calls c JOIN methods i ON i.fqn = c.dst JOIN links l ON l.parent = i.owner
JOIN methods m ON m.owner = l.child AND regexp_extract(m.fqn, '([A-Za-z0-9_$<>]+\(.*\))$', 1) = regexp_extract(c.dst, '([A-Za-z0-9_$<>]+\(.*\))$', 1)
WHERE i.simple <> '<init>' AND i.n_params IS NOT NULL"""
)
def interface_dispatch(g: Graph) -> DataFrame:
    """Calls of a type's method linked to the same signature in its direct implementers."""
    called = g.calls.join(g.methods.where("simple <> '<init>' and n_params is not null").select(F.col("fqn").alias("dst"), F.col("owner").alias("parent")), "dst")
    below = called.join(g.hierarchy, "parent").select("src", F.col("child").alias("owner"), names.signature_tail(F.col("dst")).alias("tail"))
    return below.join(g.methods.select("fqn", "owner", names.signature_tail(F.col("fqn")).alias("tail")), ["owner", "tail"]).select("src", F.col("fqn").alias("dst")).distinct()


@query(_with(LINKS, ANCESTORS) + "SELECT ancestor AS type, count(*) AS n_implementers, min(child) AS first FROM ancestors WHERE regexp_matches(split_part(ancestor, '.', -1), '^I[A-Z]') GROUP BY ancestor")
def ancestor_implementers(g: Graph) -> DataFrame:
    return g.ancestors.where(names.simple_name(F.col("ancestor")).rlike("^I[A-Z]")).groupBy(F.col("ancestor").alias("type")).agg(F.count(F.lit(1)).alias("n_implementers"), F.min("child").alias("first"))


@query(_with(METHODS, LINKS, URLS) + "SELECT DISTINCT url || '/' || simple AS url, fqn FROM class_urls JOIN methods ON owner = class_fqn WHERE simple NOT IN ('<init>', 'main', 'toString', 'hashCode', 'equals')")
def class_method_expansion(g: Graph) -> DataFrame:
    """Class URLs times the methods of the class, without those that are never called by URL."""
    m = g.methods.where(~F.col("simple").isin("<init>", "main", "toString", "hashCode", "equals"))
    return m.join(g.class_urls, F.col("owner") == F.col("class_fqn")).select(F.concat("url", F.lit("/"), "simple").alias("url"), "fqn").distinct()


@query(
    _with(METHODS, LINKS, URLS)
    + """SELECT url, fqn FROM class_urls JOIN methods ON owner = class_fqn WHERE n_params IS NOT NULL
UNION SELECT url, class_fqn FROM class_urls WHERE class_fqn NOT IN (SELECT owner FROM methods WHERE owner IS NOT NULL AND n_params IS NOT NULL)"""
)
def action_map(g: Graph) -> DataFrame:
    """Actions to their methods, and to the class itself where it has none."""
    m = g.methods.where("owner is not null and n_params is not null").select("fqn", F.col("owner").alias("class_fqn"))
    hit = g.class_urls.join(m, "class_fqn").select("url", "fqn")
    return hit.unionByName(g.class_urls.join(m, "class_fqn", "left_anti").select("url", F.col("class_fqn").alias("fqn"))).distinct()


@query(_with(METHODS, LINKS, URLS) + "SELECT task, min(fqn) AS fqn, count(*) AS n_methods FROM tasks JOIN methods ON owner = class_fqn WHERE n_params IS NOT NULL GROUP BY task")
def task_methods(g: Graph) -> DataFrame:
    return g.method_tasks.join(g.methods.where("n_params is not null").select(F.col("fqn").alias("src")), "src").groupBy("task").agg(F.min("src").alias("fqn"), F.count(F.lit(1)).alias("n_methods"))


@query(
    _with(METHODS)
    + r"""SELECT DISTINCT a.owner AS class_fqn, b.owner AS counterpart FROM (SELECT DISTINCT owner, regexp_replace(split_part(owner, '.', -1), '(Service|Manager|Handler|Helper|Util|Dao)$', '') AS stem FROM methods) a
JOIN (SELECT DISTINCT owner, regexp_replace(split_part(owner, '.', -1), '(Service|Manager|Handler|Helper|Util|Dao)$', '') AS stem FROM methods) b
ON a.stem = b.stem AND a.owner <> b.owner AND split_part(a.owner, '.', -1) <> split_part(b.owner, '.', -1) WHERE a.stem <> ''"""
)
def counterpart_names(g: Graph) -> DataFrame:
    """Classes whose names differ only by the suffix of their role."""
    stem = names.strip_suffix(names.simple_name(F.col("owner")), ["Service", "Manager", "Handler", "Helper", "Util", "Dao"])
    c = g.methods.where("owner is not null").select("owner", stem.alias("stem"), names.simple_name(F.col("owner")).alias("s")).distinct()
    a, b = c.select(F.col("owner").alias("class_fqn"), "stem", F.col("s").alias("s1")), c.select(F.col("owner").alias("counterpart"), "stem", F.col("s").alias("s2"))
    return a.join(b, "stem").where("class_fqn <> counterpart and s1 <> s2 and stem <> ''").select("class_fqn", "counterpart").distinct()


# --- resolution ---------------------------------------------------------------------------------------------------


@query(
    _with(METHODS, CALLS, LINKS, ANCESTORS)
    + r"""SELECT * FROM (WITH known AS (SELECT fqn, owner, simple, n_params, is_static FROM methods WHERE n_params IS NOT NULL),
sites AS (SELECT DISTINCT edge_id AS site, regexp_extract(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 1) AS owner, regexp_extract(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 2) AS simple,
  CASE WHEN ends_with(to_method_fqn, '()') THEN 0 ELSE len(string_split(regexp_extract(to_method_fqn, '\((.*)\)$', 1), ',')) END AS arity
  FROM call_edges WHERE to_method_fqn IS NOT NULL AND regexp_matches(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$')),
shapes AS (SELECT DISTINCT owner, simple, arity FROM sites),
cand AS (
  SELECT DISTINCT s.owner, s.simple, s.arity, k.fqn, k.is_static, CASE WHEN k.n_params = s.arity THEN 1 ELSE 2 END AS tier FROM shapes s JOIN known k USING (owner, simple) WHERE k.n_params <= s.arity
  UNION SELECT s.owner, s.simple, s.arity, k.fqn, k.is_static, CASE WHEN k.n_params = s.arity THEN 3 ELSE 4 END FROM shapes s JOIN ancestors a ON a.child = s.owner JOIN known k ON k.owner = a.ancestor AND k.simple = s.simple WHERE k.n_params <= s.arity),
best AS (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY owner, simple, arity)),
counted AS (SELECT *, count(*) OVER (PARTITION BY owner, simple, arity) AS n FROM best)
SELECT site, coalesce(fqn, s.owner || '.' || s.simple || '(?)') AS target,
  CASE WHEN n > 1 THEN 'ambiguous-of-' || n WHEN fqn IS NOT NULL AND is_static THEN 'static' WHEN fqn IS NOT NULL THEN 'virtual'
    WHEN (s.owner, s.simple) IN (SELECT owner, simple FROM known) THEN 'unresolved-arity' ELSE 'unresolved' END AS kind
FROM sites s LEFT JOIN counted c ON c.owner = s.owner AND c.simple = s.simple AND c.arity = s.arity)"""
)
def call_resolution(g: Graph) -> DataFrame:
    """Every call edge's target resolved anew from its owner, name and number of arguments."""
    to = F.col("to_method_fqn")
    sites = g.table("call_edges").where(to.rlike(names.METHOD_FQN)).select(F.col("edge_id").alias("site"), names.method_owner(to).alias("owner"), names.method_simple(to).alias("simple"), names.parameter_count(to).alias("arity"))
    # the few shapes of a hot target are resolved once
    shapes = sites.select("owner", "simple", "arity").distinct().withColumn("site", F.struct("owner", "simple", "arity"))
    found = resolve.resolve_calls(shapes, g.methods, g.ancestors).select("site.*", "target", "kind")
    return sites.join(found, ["owner", "simple", "arity"]).select("site", "target", "kind")


_IMPORTS = r"""files AS (SELECT DISTINCT path, content, regexp_extract(content, 'package\s+([\w.]+)\s*;', 1) AS pkg FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.java'),
uses AS (SELECT DISTINCT path AS file, pkg, unnest(regexp_extract_all(content, '(?:extends|implements|new)\s+([A-Z]\w*)', 1)) AS name FROM files),
imports AS (SELECT DISTINCT path AS file, unnest(regexp_extract_all(content, 'import\s+([\w.]+(?:\.\*)?)\s*;', 1)) AS target FROM files),
classes AS (SELECT DISTINCT owner_fqn AS class_fqn, split_part(owner_fqn, '.', -1) AS simple, regexp_replace(owner_fqn, '\.[^.]*$', '') AS pkg FROM method_nodes WHERE owner_fqn IS NOT NULL)"""


@query(
    "WITH " + _IMPORTS
    + r""", cand AS (
  SELECT u.file, u.name, i.target AS class_fqn, 1 AS tier FROM uses u JOIN imports i ON i.file = u.file AND NOT ends_with(i.target, '.*') AND split_part(i.target, '.', -1) = u.name
  UNION SELECT file, name, min(class_fqn), 2 FROM (SELECT u.file, u.name, c.class_fqn FROM uses u JOIN imports i ON i.file = u.file AND ends_with(i.target, '.*') JOIN classes c ON c.simple = u.name AND c.pkg = regexp_replace(i.target, '\.\*$', '')) GROUP BY file, name HAVING count(DISTINCT class_fqn) = 1
  UNION SELECT u.file, u.name, c.class_fqn, 3 FROM uses u JOIN classes c ON c.simple = u.name AND c.pkg = u.pkg
  UNION SELECT file, name, 'java.lang.' || name, 4 FROM uses WHERE name IN ('String','Object','Integer','Long','Boolean','Double','StringBuilder','Exception','RuntimeException','Override','Iterable','Math','System','Thread','Runnable')
  UNION SELECT file, name, name, 5 FROM uses)
SELECT file, name, min(class_fqn) AS class_fqn, ['import','wildcard','package','java.lang','raw'][tier] AS rule
FROM (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY file, name)) GROUP BY file, name, tier"""
)
def import_cascade(g: Graph) -> DataFrame:
    """Types named after extends, implements and new in the Java files of the repositories, resolved by their imports."""
    files = g.table("repo_files").where("content is not null and lower(path) like '%.java'").select("path", "content", F.regexp_extract("content", r"package\s+([\w.]+)\s*;", 1).alias("pkg")).distinct()
    uses = files.select(F.col("path").alias("file"), "pkg", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:extends|implements|new)\s+([A-Z]\w*)"), 1))).alias("name"))
    imports = files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"import\s+([\w.]+(?:\.\*)?)\s*;"), 1))).alias("target"))
    owner = F.col("owner_fqn")
    classes = g.table("method_nodes").where("owner_fqn is not null").select(owner.alias("class_fqn"), names.simple_name(owner).alias("simple"), F.regexp_replace(owner, r"\.[^.]*$", "").alias("pkg")).distinct()
    return resolve.import_cascade(uses, imports, classes)


_LIBRARY = "library AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in resolve.library_names()) + ") v(name, lib))"


@query(
    "WITH " + _IMPORTS + ", " + _LIBRARY
    + r""", stars AS (SELECT DISTINCT file, regexp_replace(target, '\.\*$', '') AS star FROM imports WHERE ends_with(target, '.*')),
single AS (SELECT file, min(star) AS star FROM stars GROUP BY file HAVING count(*) = 1),
cand AS (
  SELECT u.file, u.name, i.target AS class_fqn, 1 AS tier FROM uses u JOIN imports i ON i.file = u.file AND NOT ends_with(i.target, '.*') AND split_part(i.target, '.', -1) = u.name
  UNION SELECT u.file, u.name, lib || '.' || u.name, 2 FROM uses u JOIN library l ON l.name = u.name JOIN stars s ON s.file = u.file AND s.star = lib
  UNION SELECT u.file, u.name, star || '.' || u.name, 3 FROM uses u JOIN single s ON s.file = u.file
  UNION SELECT u.file, u.name, lib || '.' || u.name, 4 FROM uses u JOIN library l ON l.name = u.name
  UNION SELECT file, name, pkg || '.' || name, 5 FROM uses WHERE pkg <> ''
  UNION SELECT file, name, name, 6 FROM uses)
SELECT file, name, min(class_fqn) AS class_fqn, ['import','library wildcard','only wildcard','library','package','raw'][tier] AS rule
FROM (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY file, name)) GROUP BY file, name, tier"""
)
def import_tiers(g: Graph) -> DataFrame:
    """The same types by the imports of their file alone, with the library's packages."""
    files = g.table("repo_files").where("content is not null and lower(path) like '%.java'").select("path", "content", F.regexp_extract("content", r"package\s+([\w.]+)\s*;", 1).alias("pkg")).distinct()
    uses = files.select(F.col("path").alias("file"), "pkg", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?:extends|implements|new)\s+([A-Z]\w*)"), 1))).alias("name"))
    imports = files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"import\s+([\w.]+(?:\.\*)?)\s*;"), 1))).alias("target"))
    return resolve.imported_names(uses, imports)


# --- aggregates, projections, sorts -------------------------------------------------------------------------------


@query("SELECT kind || '/' || coalesce(nature, 'BODY') AS what, count(*) AS n FROM changed_symbols WHERE kind IS NOT NULL GROUP BY 1")
def kind_nature_counts(g: Graph) -> DataFrame:
    return g.table("changed_symbols").where("kind is not null").groupBy(F.concat_ws("/", "kind", F.coalesce("nature", F.lit("BODY"))).alias("what")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT *, CASE nature WHEN 'DELETED' THEN 4 WHEN 'ADDED' THEN 3 WHEN 'SIGNATURE' THEN 2 WHEN 'BODY' THEN 1 ELSE 0 END AS k FROM changed_symbols)
SELECT file_path, fqn, kind, min(start_line) AS start_line, max(end_line) AS end_line, [NULL,'BODY','SIGNATURE','ADDED','DELETED'][max(k) + 1] AS nature,
  first(hunk_start_line ORDER BY (hunk_start_line IS NULL), symbol_id) AS hunk_start_line, first(hunk_end_line ORDER BY (hunk_end_line IS NULL), symbol_id) AS hunk_end_line, count(*) AS n_rows
FROM r GROUP BY file_path, fqn, kind"""
)
def merge_duplicate_symbols(g: Graph) -> DataFrame:
    return intervals.merge_duplicate_symbols(g.table("changed_symbols"), names.NATURE_RANK)


@query(
    """SELECT symbol_id, CASE WHEN hunk_start_line <= start_line AND hunk_end_line >= end_line THEN 'ADDED' WHEN hunk_start_line <= start_line THEN 'SIGNATURE' ELSE 'BODY' END AS derived,
CASE WHEN greatest(hunk_start_line, start_line) <= least(hunk_end_line, end_line) THEN greatest(hunk_start_line, start_line) ELSE start_line END AS low,
CASE WHEN greatest(hunk_start_line, start_line) <= least(hunk_end_line, end_line) THEN least(hunk_end_line, end_line) ELSE end_line END AS high
FROM changed_symbols WHERE start_line IS NOT NULL AND end_line IS NOT NULL AND hunk_start_line IS NOT NULL AND hunk_end_line IS NOT NULL"""
)
def change_nature(g: Graph) -> DataFrame:
    s = g.table("changed_symbols").where("start_line is not null and end_line is not null and hunk_start_line is not null and hunk_end_line is not null")
    args = [F.col(c) for c in ("hunk_start_line", "hunk_end_line", "start_line", "end_line")]
    low, high = names.clamp(*args)
    return s.select("symbol_id", names.change_nature(*args).alias("derived"), low.alias("low"), high.alias("high"))


@query("SELECT kind, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM call_edges GROUP BY kind")
def call_kind_distribution(g: Graph) -> DataFrame:
    counts = g.table("call_edges").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    # one row a kind
    return counts.select("kind", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("percent"))


@query(
    _with(METHODS, CALLS, LINKS)
    + """SELECT 'Method' AS label, count(*) AS n FROM methods UNION ALL SELECT 'Placeholder', count(*) FROM methods WHERE ends_with(fqn, '(?)')
UNION ALL SELECT 'Class', count(DISTINCT owner) FROM methods UNION ALL SELECT 'CALLS', count(*) FROM calls UNION ALL SELECT 'HIERARCHY', count(*) FROM links
UNION ALL SELECT l, count(*) FROM (SELECT unnest(labels) AS l FROM methods) GROUP BY l"""
)
def label_counts(g: Graph) -> DataFrame:
    m = g.methods
    one = lambda df, label, n=F.count(F.lit(1)): df.agg(n.alias("n")).select(F.lit(label).alias("label"), "n")
    parts = [
        one(m, "Method"), one(m.where(F.col("fqn").endswith("(?)")), "Placeholder"), one(m, "Class", F.count_distinct("owner")), one(g.calls, "CALLS"), one(g.hierarchy, "HIERARCHY"),
        m.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    """WITH f AS (SELECT repo_id, commit_sha, count(*) AS n_files, count(DISTINCT pkg) AS n_packages FROM file_nodes GROUP BY ALL),
c AS (SELECT commit_sha, repo_id, max(committed_at) AS committed_at FROM commit_nodes GROUP BY ALL)
SELECT c.repo_id, c.commit_sha, strftime(committed_at, '%Y-%m-%d') AS day, coalesce(n_files, 0) AS n_files, coalesce(n_packages, 0) AS n_packages FROM c LEFT JOIN f ON f.repo_id = c.repo_id AND f.commit_sha = c.commit_sha"""
)
def snapshot_listing(g: Graph) -> DataFrame:
    files = g.table("file_nodes").groupBy("repo_id", "commit_sha").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("pkg").alias("n_packages"))
    commits = g.table("commit_nodes").groupBy("repo_id", "commit_sha").agg(F.max("committed_at").alias("committed_at"))
    return commits.join(files, ["repo_id", "commit_sha"], "left").select("repo_id", "commit_sha", F.date_format("committed_at", "yyyy-MM-dd").alias("day"), F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_packages", F.lit(0)).alias("n_packages"))


@query("SELECT repo_id, count(DISTINCT commit_sha) AS n_commits, count(DISTINCT path) AS n_paths, count(*) AS n_rows FROM file_nodes GROUP BY repo_id")
def repo_listing(g: Graph) -> DataFrame:
    return g.table("file_nodes").groupBy("repo_id").agg(F.count_distinct("commit_sha").alias("n_commits"), F.count_distinct("path").alias("n_paths"), F.count(F.lit(1)).alias("n_rows"))


@query(
    """WITH f AS (SELECT DISTINCT repo_id, path, lower(content_hash) AS h, recorded_at < TIMESTAMP '2024-09-01' AS old FROM file_nodes WHERE path IS NOT NULL AND content_hash IS NOT NULL)
SELECT DISTINCT repo_id, path, h AS content_hash FROM f WHERE NOT old AND (repo_id, path, h) NOT IN (SELECT (repo_id, path, h) FROM f WHERE old AND repo_id IS NOT NULL)"""
)
def incremental_files(g: Graph) -> DataFrame:
    """Files that the earlier snapshots don't have with this content: what an incremental run reads."""
    f = g.table("file_nodes").where("path is not null and content_hash is not null").select("repo_id", "path", F.lower("content_hash").alias("content_hash"), "recorded_at")
    old = F.col("recorded_at") < F.lit("2024-09-01").cast("timestamp_ntz")
    key = ["repo_id", "path", "content_hash"]
    return f.where(~old).select(*key).distinct().join(f.where(old).select(*key), key, "left_anti")


@query(_with(METHODS) + "SELECT owner, count(*) AS n FROM methods WHERE owner IS NOT NULL GROUP BY owner ORDER BY n DESC, owner LIMIT 20")
def topn_owners(g: Graph) -> DataFrame:
    return g.methods.where("owner is not null").groupBy("owner").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "owner").limit(20)


@query(
    _with(METHODS, CALLS)
    + r""", acc AS (SELECT DISTINCT upper(split_part(owner, '.', -1)) AS t, src, m.simple AS s FROM calls JOIN methods m ON m.fqn = src WHERE dst = 'io.harborline.platform.dao.DbSession.query(String,Object[])'),
n AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY src) AS k FROM acc)
SELECT t AS name, count(*) AS n_readers, string_agg(src, ',' ORDER BY src) FILTER (WHERE k <= 10) AS sample FROM n GROUP BY t"""
)
def affected_tables(g: Graph) -> DataFrame:
    """Tables with their readers: how many, and the first ten."""
    reads = g.calls.where(F.col("dst") == "io.harborline.platform.dao.DbSession.query(String,Object[])").join(g.methods.select(F.col("fqn").alias("src"), "owner"), "src")
    named = reads.select(F.upper(names.simple_name(F.col("owner"))).alias("name"), "src").distinct()
    # a table's readers are numbered, so that no list longer than the sample is built
    n = F.row_number().over(Window.partitionBy("name").orderBy("src"))
    return named.withColumn("n", n).groupBy("name").agg(F.count(F.lit(1)).alias("n_readers"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") <= 10, F.col("src")))), ",").alias("sample"))


@query(
    _with(METHODS)
    + """SELECT kind, count(*) AS n_classes FROM (SELECT DISTINCT owner, CASE WHEN ends_with(owner, 'TaskHandler') THEN 'TaskHandler' WHEN ends_with(owner, 'Task') THEN 'TaskType' WHEN ends_with(owner, 'Servlet') OR ends_with(owner, 'Action') THEN 'Endpoint'
WHEN ends_with(owner, 'Dao') THEN 'Storage' WHEN ends_with(owner, 'Listener') OR ends_with(owner, 'Handler') THEN 'Event' ELSE 'Other' END AS kind FROM methods WHERE owner IS NOT NULL) GROUP BY kind"""
)
def feature_classify(g: Graph) -> DataFrame:
    o = F.col("owner")
    kind = (
        F.when(o.endswith("TaskHandler"), "TaskHandler").when(o.endswith("Task"), "TaskType").when(o.endswith("Servlet") | o.endswith("Action"), "Endpoint")
        .when(o.endswith("Dao"), "Storage").when(o.endswith("Listener") | o.endswith("Handler"), "Event").otherwise("Other")
    )
    return g.methods.where("owner is not null").select("owner", kind.alias("kind")).distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_classes"))


# --- text and tests -----------------------------------------------------------------------------------------------


@query(
    r"""SELECT DISTINCT fqn, trim(regexp_replace(regexp_replace(simple_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')) AS words,
split_part(regexp_extract(fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 1), '.', -1) || '.' || regexp_extract(fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 2) || '()' AS short
FROM method_nodes WHERE simple_name IS NOT NULL AND fqn IS NOT NULL"""
)
def camel_split(g: Graph) -> DataFrame:
    m = g.table("method_nodes").where("simple_name is not null and fqn is not null")
    return m.select("fqn", F.trim(names.camel_words(F.col("simple_name"))).alias("words"), names.short_method(F.col("fqn")).alias("short")).distinct()


_TESTS = """tests AS (SELECT doc_id AS test_id, text FROM documents WHERE doc_kind IN ('test_case', 'impact_report') AND text IS NOT NULL)"""


@query(
    _with(METHODS, _TESTS)
    + """, words AS (SELECT DISTINCT test_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM tests),
cat AS (SELECT DISTINCT simple AS word, 'METHOD' AS kind, fqn AS key, 0.8::DOUBLE AS c FROM methods WHERE start_line > 0
  UNION SELECT DISTINCT split_part(owner, '.', -1), 'CLASS', owner, 0.8::DOUBLE FROM methods WHERE start_line > 0)
SELECT test_id, kind, key, max(c) AS confidence FROM words JOIN cat USING (word) GROUP BY ALL"""
)
def token_tagging(g: Graph) -> DataFrame:
    m = g.methods.where("start_line > 0")
    catalogue = m.select(F.col("simple").alias("word"), F.lit("METHOD").alias("kind"), F.col("fqn").alias("key"), F.lit(0.8).alias("confidence")).unionByName(
        m.where("owner is not null").select(names.simple_name(F.col("owner")).alias("word"), F.lit("CLASS").alias("kind"), F.col("owner").alias("key"), F.lit(0.8).alias("confidence"))
    )
    return tagging.token_tags(tagging.test_cases(g.table("documents")), catalogue)


@query(
    _with(METHODS, LINKS, URLS, _TESTS)
    + """, pages AS (SELECT url FROM method_urls UNION SELECT url FROM class_urls UNION SELECT '/page/' || lower(split_part(owner, '.', -1)) FROM methods WHERE owner IS NOT NULL),
fragments AS (SELECT url, lower(regexp_replace(url, '^servlet:', '')) AS fragment FROM pages UNION SELECT url, lower(regexp_extract(split_part(url, '?', 1), '([^/:]+)[/:]*$', 1)) FROM pages)
SELECT DISTINCT test_id, 'URL' AS kind, url AS key, 0.6::DOUBLE AS confidence FROM tests JOIN fragments ON length(fragment) >= 4 AND contains(lower(text), fragment)"""
)
def url_fragment_tagging(g: Graph) -> DataFrame:
    """Texts tagged with the URLs of methods and classes, and of one page a class, that they have anywhere."""
    pages = g.methods.where("owner is not null").select(F.concat(F.lit("/page/"), F.lower(names.simple_name(F.col("owner")))).alias("url"))
    return tagging.url_substring_tags(tagging.test_cases(g.table("documents")), g.method_urls.select("url").unionByName(g.class_urls.select("url")).unionByName(pages).distinct())


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^@@ [^@\n]*@@')) AS n_hunks, len(regexp_extract_all(text, '(?m)^diff --git ')) AS n_files,
len(regexp_extract_all(text, '(?m)^\+(?:[^+\n]|$)')) AS n_added FROM documents WHERE doc_kind = 'patch' AND text IS NOT NULL"""
)
def patch_shape(g: Graph) -> DataFrame:
    d = g.table("documents").where("doc_kind = 'patch' and text is not null")
    n = lambda re: F.size(F.regexp_extract_all("text", F.lit(re), 0))
    return d.select("doc_id", n(r"(?m)^@@ [^@\n]*@@").alias("n_hunks"), n(r"(?m)^diff --git ").alias("n_files"), n(r"(?m)^\+(?:[^+\n]|$)").alias("n_added"))


@query(
    """SELECT language, count(*) AS n FROM (SELECT CASE lower(regexp_extract(split_part(replace(path, chr(92), '/'), '/', -1), '\\.([^.]+)$', 1)) WHEN 'java' THEN 'java' WHEN 'js' THEN 'javascript' WHEN 'hbs' THEN 'javascript'
WHEN 'cs' THEN 'csharp' WHEN 'xml' THEN 'xml' WHEN 'json' THEN 'config' WHEN 'properties' THEN 'config' WHEN 'sql' THEN 'config' ELSE 'other' END AS language FROM repo_files WHERE path IS NOT NULL) GROUP BY language"""
)
def language_routing(g: Graph) -> DataFrame:
    return g.table("repo_files").where("path is not null").groupBy(names.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


# --- event stream tables, in batch form ---------------------------------------------------------------------------


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def last_n_per_key(g: Graph) -> DataFrame:
    """The last 20 events of each user: a ring buffer."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return g.table("events").select("user_id", "event_id", "ts").withColumn("n", n).where("n <= 20").select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE")
def ttl_evict(g: Graph) -> DataFrame:
    e = g.table("events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("interval 30 minutes")).select("event_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least_k FROM events GROUP BY user_id")
def job_state(g: Graph) -> DataFrame:
    """The latest state of each key and what its properties hold."""
    k = F.get_json_object("props", "$.k").cast("long")
    return g.table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count(F.lit(1)).alias("n"), F.min(k).alias("least_k"))
