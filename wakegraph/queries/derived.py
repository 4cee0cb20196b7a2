"""Queries of the source readers over texts that are made from the tables: descriptors, mappings, sheets, rules, logs.

The tables hold no web descriptors, registries or rule files of their own, so each is written from the rows of a table
by a fixed rule that the query's docstring names, and read back by the operator; the SQL goes to the rows directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import resolve
from wakegraph.plans import report
from wakegraph.plans.graph import ACTION_BASE, Graph
from wakegraph.queries.impact import _RISK, BACK1, CALLS, INPUTS, LINKS, METHODS, URLS, _risks, _with
from wakegraph.sources import config, files
from wakegraph.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, base: f(Graph(spark, base))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FILES = 64


def _written(g: Graph, lines: DataFrame, root: str) -> str:
    """A folder of XML files below the workspace, the lines (value) in FILES roots."""
    path = f"{g.space.root}/{root}"
    files_ = lines.groupBy(F.pmod(F.crc32("value"), F.lit(FILES)).alias("file")).agg(F.array_join(F.collect_list("value"), "\n").alias("body"))
    files_.select("file", F.concat(F.lit(f"<{root}>\n"), "body", F.lit(f"\n</{root}>")).alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    return path


def _tag(name: str, **attributes: Column) -> Column:
    parts: list[Column] = [F.lit(f"<{name}")]
    for k, v in attributes.items():
        parts += [F.lit(f' {k}="'), v, F.lit('"')]
    return F.concat(*parts, F.lit("/>"))


@query(_with(LINKS) + f"SELECT DISTINCT split_part(child, '.', -1) AS name, child AS class_fqn, '/' || lower(split_part(child, '.', -1)) AS url FROM links WHERE parent = '{ACTION_BASE}' AND split_part(child, '.', -1) IN (SELECT split_part(child, '.', -1) FROM links WHERE parent = '{ACTION_BASE}' GROUP BY 1 HAVING count(*) = 1)")
def servlet_urls(g: Graph) -> DataFrame:
    """A web descriptor with a servlet and two mappings, one with a wildcard, of every action whose simple name is unique."""
    simple = names.simple_name(F.col("child"))
    actions = g.hierarchy.where(F.col("parent") == ACTION_BASE).select("child", simple.alias("name"))
    unique = actions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("child")).where("n = 1")
    lines = unique.select(F.concat(
        F.lit("<servlet><servlet-name> "), "name", F.lit("</servlet-name><servlet-class>"), "child", F.lit("</servlet-class></servlet><servlet-mapping><servlet-name>"), "name",
        F.lit("</servlet-name><url-pattern>/"), F.lower("name"), F.lit("</url-pattern><url-pattern>/"), "name", F.lit("/*</url-pattern></servlet-mapping>"),
    ).alias("value"))
    return config.servlets(g.spark, _written(g, lines, "web-app"))


_ENTRY = "entry AS (SELECT fqn, owner, simple FROM methods WHERE list_contains(labels, 'EntryPoint') AND owner IS NOT NULL AND simple <> '<init>')"


def _entries(g: Graph) -> DataFrame:
    return g.methods.where(F.array_contains("labels", "EntryPoint") & F.col("owner").isNotNull() & (F.col("simple") != "<init>")).select("fqn", "owner", "simple")


@query(_with(METHODS, _ENTRY) + "SELECT DISTINCT '/api/' || simple AS url, owner AS class_fqn, simple AS call FROM entry")
def api_mapping_rows(g: Graph) -> DataFrame:
    """Mapping rows of every entry point, one with and one without a leading slash, and a row without a URL."""
    e = _entries(g)
    row = lambda url: _tag("ApiMapping", API_URL=url, SERVLET_CLASS_NAME=F.col("owner"), MTCALL_VALUE=F.col("simple"))
    none = _tag("ApiMapping", SERVLET_CLASS_NAME=F.col("owner"))
    texts = e.select(F.col("fqn").alias("path"), F.concat(row(F.concat(F.lit("/api/"), "simple")), row(F.concat(F.lit("api/"), "simple")), none).alias("content"))
    return config.api_mappings(texts, "ApiMapping")


@query(_with(METHODS, _ENTRY) + ", api AS (SELECT DISTINCT '/api/' || simple AS url, owner AS class_fqn, simple AS method FROM entry) SELECT '/go/' || a.method AS url, a.url AS forward, a.class_fqn FROM api a")
def forwarded_apis(g: Graph) -> DataFrame:
    """Servlet APIs of the entry points (rows without a method are left out), and the forwards that lead to them."""
    e = _entries(g)
    simple = F.col("simple")
    texts = e.select(F.col("fqn").alias("path"), F.concat(
        _tag("ServletAPI", URL_PATH=F.concat(F.lit("/api/"), simple), CLASS_NAME=F.col("owner"), METHOD_NAME=simple), _tag("ServletAPI", URL_PATH=simple, CLASS_NAME=F.col("owner")),
        _tag("forward", url=F.concat(F.lit("/go/"), simple), to=F.concat(F.lit("/api/"), simple)),
    ).alias("content"))
    return config.forwards(texts, config.servlet_apis(texts, "ServletAPI").select("url", "class_fqn"))


@query(
    _with(METHODS, LINKS, URLS)
    + """, a AS (SELECT '/' || split_part(class_fqn, '.', -1) || '.do' AS url, class_fqn, CASE WHEN length(class_fqn) % 2 = 0 THEN 'call' END AS parameter FROM class_urls),
m AS (SELECT DISTINCT owner, simple FROM methods WHERE owner IS NOT NULL AND simple IS NOT NULL)
SELECT DISTINCT CASE WHEN parameter IS NULL THEN url ELSE url || '?' || parameter || '=' || simple END AS url, class_fqn || '.' || simple AS target FROM a JOIN m ON owner = class_fqn
UNION SELECT url, class_fqn FROM a WHERE class_fqn NOT IN (SELECT owner FROM m)"""
)
def dispatched_actions(g: Graph) -> DataFrame:
    """Action elements of every action class, every other one dispatching by a parameter, expanded to its methods."""
    c = F.col("class_fqn")
    path = F.concat(F.lit("/"), names.simple_name(c))
    element = F.when(F.length(c) % 2 == 0, _tag("action", path=path, type=c, parameter=F.lit("call"))).otherwise(_tag("action", path=path, type=c))
    texts = g.class_urls.select(c.alias("path"), element.alias("content"))
    return config.action_methods(config.actions(texts), g.methods.where("owner is not null and simple is not null").select("owner", "simple"))


@query(_with(METHODS, LINKS, URLS) + "SELECT task AS name, max(class_fqn) || 'New' AS class_fqn FROM tasks GROUP BY task")
def task_definitions(g: Graph) -> DataFrame:
    """Tasks defined in both kinds of element and more than one file: the last definition of a name counts."""
    t, c = F.col("task"), F.col("class_fqn")
    texts = g.tasks.select(c.alias("path"), F.concat(
        _tag("BackgroundTaskDetails", task_name=t, class_name=F.concat(c, F.lit("New"))), _tag("TaskEngine_Task", task_name=t, class_name=c), _tag("TaskEngine_Task", task_name=t),
    ).alias("content"))
    return config.task_classes(texts)


@query("""SELECT DISTINCT p_brand AS "table", 'C' || p_size AS name, 'CHAR' AS data_type, p_size AS max_size, p_size % 2 = 1 AS nullable, p_size % 5 = 0 AS pk_like FROM part""")
def dictionary_columns(g: Graph) -> DataFrame:
    """A data dictionary with a table a brand and a column a size; even sizes aren't nullable, sizes by five are unique values."""
    size = F.col("p_size").cast("string")
    odd = F.col("p_size") % 2 == 1
    column = F.concat(F.lit('<column name="C'), size, F.lit('"><data-type>CHAR</data-type><max-size>'), size, F.lit("</max-size>"), F.when(odd, "").otherwise("<nullable>false</nullable>"), F.lit("</column>"))
    unique = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("<uniquevalue-column>c"), size, F.lit("</uniquevalue-column>"))).otherwise("")
    parts = g.table("part").select("p_brand", "p_size").distinct().select("p_brand", column.alias("column"), unique.alias("u"))
    # 50 sizes at most
    tables = parts.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("column")), "").alias("c"), F.array_join(F.sort_array(F.collect_list("u")), "").alias("u"))
    lines = tables.select(F.concat(F.lit('<table name="'), "p_brand", F.lit('"><columns>'), "c", F.lit("</columns><uniquevalue-generation>"), "u", F.lit("</uniquevalue-generation></table>")).alias("value"))
    return config.data_dictionary(g.spark, _written(g, lines, "dictionary"))


_CASES = "SELECT 'LBF-' || kind || '-' || symbol_id AS test_id, replace(fqn, '|', '') AS title, kind AS area, coalesce(nature, '') AS steps, coalesce(kind, '') AS expected, patch_id::VARCHAR AS source FROM changed_symbols WHERE kind IS NOT NULL AND fqn IS NOT NULL AND fqn = trim(fqn)"


@query(_CASES)
def markdown_tests(g: Graph) -> DataFrame:
    """A Markdown table with a case of every changed symbol, among headers, separators and rows that are none."""
    s = g.table("changed_symbols").where("kind is not null and fqn is not null and fqn = trim(fqn)")
    cell = lambda c: F.coalesce(F.replace(c, F.lit("|"), F.lit("")), F.lit(""))
    row = F.concat(F.lit("| (LBF-"), "kind", F.lit("-"), F.col("symbol_id").cast("string"), F.lit(") | "), cell(F.col("fqn")), F.lit(" | "), cell(F.col("nature")), F.lit(" | "), "kind", F.lit(" | low |"))
    head = F.lit("| id | title | steps | expected | prio |\n|---|---|---|---|---|\n")
    return config.markdown_cases(s.select(F.col("patch_id").cast("string").alias("path"), F.concat(head, row, F.lit("\n| LBF-1 | too | few |\nno row")).alias("content")))


@query("SELECT 'T' || event_id AS test_id, event_type AS title, '' AS area, props AS steps, '' AS expected FROM events")
def sheet_tests(g: Graph) -> DataFrame:
    """A CSV sheet with the events as cases, under synonyms of the header names; missing columns are empty."""
    path = f"{g.space.root}/sheet"
    e = g.table("events")
    e.select(F.concat(F.lit("T"), "event_id").alias(" Test ID"), F.col("event_type").alias("Summary"), F.col("props").alias("Procedure")).write.option("header", "true").option("escape", '"').csv(path)
    return config.csv_cases(g.spark, path).drop("source")


@query("SELECT 'T-' || patch_id AS test_id, CASE WHEN symbol_id % 3 = 0 THEN 'remove' ELSE 'add' END AS op, kind, fqn AS key FROM changed_symbols WHERE kind IS NOT NULL AND fqn IS NOT NULL AND fqn = trim(fqn) AND NOT contains(fqn, ' #')")
def glossary_rules(g: Graph) -> DataFrame:
    """A rule file of every changed symbol, read back as rules."""
    s = g.table("changed_symbols").where("kind is not null and fqn is not null and fqn = trim(fqn) and not contains(fqn, ' #')")
    op = F.when(F.col("symbol_id") % 3 == 0, "remove").otherwise("add")
    text = F.concat(F.lit("# rules\nT-"), F.col("patch_id").cast("string"), F.lit(":\n  "), op, F.lit(":\n    - "), "kind", F.lit(": "), "fqn", F.lit("  # why\n"))
    return config.rules_of(s.select(F.col("symbol_id").cast("string").alias("path"), text.alias("content"))).select("test_id", "op", "kind", "key")


_MACROS = """macros AS (SELECT DISTINCT regexp_replace(fqn, '\\(.*$', '') AS macro_class, 'K' || start_line AS macro_key, '%' || simple_name || '%' AS placeholder, upper(simple_name) AS db_column
  FROM method_nodes WHERE fqn IS NOT NULL AND start_line IS NOT NULL AND simple_name IS NOT NULL)"""


def _macros(g: Graph) -> DataFrame:
    """A registry of macro keys in JSON with an object a method, read back."""
    m = g.table("method_nodes").where("fqn is not null and start_line is not null and simple_name is not null")
    own = m.select(F.regexp_replace("fqn", r"\(.*$", "").alias("cls"), F.concat(F.lit("K"), "start_line").alias("key"), F.concat(F.lit("%"), "simple_name", F.lit("%")).alias("placeholder"), F.upper("simple_name").alias("column")).distinct()
    text = F.to_json(F.create_map("cls", F.array(F.struct("key", "placeholder", "column"))))
    return config.registry_of(own.select(F.lit("registry").alias("path"), text.alias("content")))


@query("WITH " + _MACROS + " SELECT * FROM macros")
def macro_keys(g: Graph) -> DataFrame:
    return _macros(g)


@query("WITH " + _MACROS + ", c AS (SELECT DISTINCT upper(simple_name) AS db_column FROM method_nodes WHERE start_line < 60) SELECT macro_class, string_agg(DISTINCT macro_key, ',' ORDER BY macro_key) AS keys FROM macros SEMI JOIN c USING (db_column) GROUP BY macro_class")
def macro_columns(g: Graph) -> DataFrame:
    """Macro classes whose columns are among those of the methods that begin before line 60, with their keys."""
    return config.keys_of_columns(_macros(g), g.table("method_nodes").where("start_line < 60").select(F.col("simple_name").alias("db_column")))


@query(
    r"""WITH f AS (SELECT DISTINCT concat_ws(':', repo_id, path) AS file, content FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.properties'),
l AS (SELECT file, trim(unnest(regexp_split_to_array(content, '\r\n|\r|\n')), ' ' || chr(9)) AS line, generate_subscripts(regexp_split_to_array(content, '\r\n|\r|\n'), 1) AS n FROM f),
k AS (SELECT file, n, trim(split_part(line, '=', 1), ' ' || chr(9)) AS key, trim(line[length(split_part(line, '=', 1)) + 2:], ' ' || chr(9)) AS value FROM l WHERE line <> '' AND line[1] NOT IN ('#', '!') AND contains(line, '='))
SELECT file, key, arg_max(value, n) AS value FROM k GROUP BY file, key"""
)
def property_values(g: Graph) -> DataFrame:
    """Keys and values of the properties files of the repositories."""
    own = g.table("repo_files").where("content is not null and lower(path) like '%.properties'").select(F.concat_ws(":", "repo_id", "path").alias("file"), "content").distinct()
    return files.properties_of(own)


@query(
    r"""WITH s AS (SELECT DISTINCT symbol_id, regexp_replace(replace(file_path, chr(92), '/'), '^(\./|[ab]/)', '') AS path FROM changed_symbols WHERE file_path IS NOT NULL),
f AS (SELECT path, max(n_bytes) AS n_bytes FROM repo_files GROUP BY path)
SELECT symbol_id, s.path, n_bytes FROM s LEFT JOIN f USING (path)"""
)
def blob_sizes(g: Graph) -> DataFrame:
    """Changed files with the size of what their path holds in the trees; null where they don't have it."""
    changes = g.table("changed_symbols").where("file_path is not null").select("symbol_id", names.clean_path(F.col("file_path")).alias("new_path")).distinct()
    trees = g.table("repo_files").groupBy("path").agg(F.max("n_bytes").alias("content"))
    return files.blobs(changes, trees).select("symbol_id", F.col("new_path").alias("path"), F.col("content").alias("n_bytes"))


@query(
    """WITH f AS (SELECT path, lower(content_hash) AS h, recorded_at FROM file_nodes WHERE path IS NOT NULL AND content_hash IS NOT NULL)
SELECT DISTINCT path, h AS content_hash FROM f WHERE recorded_at >= TIMESTAMP '2024-09-01' AND (path, h) NOT IN (SELECT (path, h) FROM f WHERE recorded_at < TIMESTAMP '2024-09-01')"""
)
def unseen_files(g: Graph) -> DataFrame:
    """Contents that no earlier snapshot has under this path."""
    f = g.table("file_nodes").where("path is not null and content_hash is not null").select("path", F.lower("content_hash").alias("content_hash"), "recorded_at")
    old = F.col("recorded_at") < F.lit("2024-09-01").cast("timestamp_ntz")
    return files.unseen(f.where(~old).select("path", "content_hash"), f.where(old)).distinct()


_SEEDS = r"""t AS (SELECT unnest(regexp_extract_all(content, '<([A-Za-z_]\w*\s[^<>]*)>', 1)) AS body FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.xml'),
p AS (SELECT lower(regexp_extract(body, '^(\w+)', 1)) AS "table", upper(unnest(regexp_extract_all(body, '([A-Za-z_][\w.-]*)\s*=\s*["'']([^"''<>]*)["'']', 1))) AS "column", unnest(regexp_extract_all(body, '([A-Za-z_][\w.-]*)\s*=\s*["'']([^"''<>]*)["'']', 2)) AS class_fqn FROM t),
seeds AS (SELECT DISTINCT * FROM p WHERE regexp_matches(class_fqn, '^[a-z_]\w*(\.\w+)*\.[A-Z]\w*$'))"""


@query(
    "WITH " + _SEEDS + """, w AS (SELECT DISTINCT "table" FROM seeds), c AS (SELECT "table", "column", list_position(['NAME', 'CLASS', 'TYPE', 'ID'], "column") AS prio, count(*) AS n FROM seeds GROUP BY ALL),
b AS (SELECT "table", arg_min("column", prio) AS "column", arg_min(n, prio) AS n FROM c WHERE prio IS NOT NULL GROUP BY "table")
SELECT b."table", b."column", b.n, CASE WHEN b.n <= 250 THEN (SELECT string_agg(class_fqn, ',' ORDER BY class_fqn) FROM seeds s WHERE s."table" = b."table" AND s."column" = b."column") END AS classes FROM b"""
)
def table_class_candidates(g: Graph) -> DataFrame:
    """Classes that the XML files name for a table, from the first of four columns that has any."""
    seeds = config.seed_classes(g.table("repo_files").where("content is not null and lower(path) like '%.xml'").select("path", "content"))
    return config.table_candidates(seeds.select("table"), seeds, ["NAME", "CLASS", "TYPE", "ID"]).withColumn("classes", F.array_join("classes", ","))


@query(
    _with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK
    + """, high AS (SELECT DISTINCT m.owner FROM risks r JOIN methods m ON m.fqn = r.fqn WHERE r.risk = 'HIGH')
SELECT DISTINCT file_path, CASE WHEN file_path IN (SELECT file_path FROM changed_symbols WHERE split_part(fqn, '(', 1) IN (SELECT owner FROM high) AND file_path IS NOT NULL) THEN 'HIGH' ELSE 'LOW' END AS risk FROM changed_symbols WHERE file_path IS NOT NULL"""
)
def escalated_files(g: Graph) -> DataFrame:
    """Changed files, HIGH where one of the types changed in them owns a changed method of high risk."""
    s = g.table("changed_symbols").where("file_path is not null")
    # the types of a file: those that its symbols name
    changes = s.groupBy("file_path").agg(F.collect_set(F.substring_index("fqn", "(", 1)).alias("owners")).withColumn("risk", F.lit("LOW"))
    owners = _risks(g).where("risk = 'HIGH'").join(g.methods.select("fqn", "owner"), "fqn").select("owner")
    return report.escalated(changes, owners).select("file_path", "risk")


@query(_with(METHODS, CALLS, INPUTS, BACK1, LINKS, URLS) + _RISK + ", o AS (SELECT coalesce(max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END), 1) AS r FROM risks) SELECT t AS threshold, r >= n AS fails FROM o, (VALUES ('LOW', 1), ('MEDIUM', 2), ('HIGH', 3), ('unknown', 0)) v(t, n)")
def fail_gate(g: Graph) -> DataFrame:
    """Whether a run fails at each threshold."""
    overall = report.overall_risk(_risks(g))
    out = None
    for t in ("LOW", "MEDIUM", "HIGH", "unknown"):
        one = overall.select(F.lit(t).alias("threshold"), names.exceeds(F.col("risk"), t).alias("fails"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    r"""SELECT DISTINCT fqn, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(simple_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: length(w) > 1))), ',') AS tokens,
CASE WHEN start_line % 3 = 0 THEN start_line::VARCHAR WHEN start_line % 3 = 1 THEN simple_name ELSE NULL END AS literal, start_line AS hunk
FROM method_nodes WHERE fqn IS NOT NULL AND simple_name IS NOT NULL AND start_line IS NOT NULL"""
)
def text_functions(g: Graph) -> DataFrame:
    """Words of method names, values of literals (numbers, texts and what is none), and the line of a hunk header."""
    m = g.table("method_nodes").where("fqn is not null and simple_name is not null and start_line is not null")
    n = F.col("start_line").cast("string")
    literal = F.when(F.col("start_line") % 3 == 0, F.concat(n, F.lit("L"))).when(F.col("start_line") % 3 == 1, F.concat(F.lit('"'), "simple_name", F.lit('"'))).otherwise(F.concat("simple_name", F.lit("()")))
    header = F.concat(F.lit("@@ -1,2 +"), n, F.lit(",7 @@ void x("))
    return m.select("fqn", F.array_join(names.camel_tokens(F.col("simple_name")), ",").alias("tokens"), names.literal_value(literal).alias("literal"), names.hunk_start(header).alias("hunk")).distinct()


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') OR bool_or(event_type = 'click') OR bool_or(event_type = 'view') THEN 'RUNNING' ELSE 'PENDING' END AS status, count(*) AS n_changes FROM events GROUP BY user_id")
def stream_job_states(g: Graph) -> DataFrame:
    """The state machine of jobs in a stream: three types of event set a user's job running, others are no state."""
    status = F.when(F.col("event_type").isin("purchase", "click", "view"), "RUNNING").otherwise(F.col("event_type"))
    changes = jobs.table_stream(g.spark, g.base, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), status.alias("status"))
    out = jobs.drain(jobs.states(changes), "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "n_changes"), F.struct("batch", "n_changes")).alias("s"))
    return last.select(F.col("job_id").alias("user_id"), "s.status", "s.n_changes")


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS seq FROM events QUALIFY seq >= 10")
def replayed_lines(g: Graph) -> DataFrame:
    """Lines of every job numbered without gaps, and replayed from the eleventh on to one who joins late."""
    e = g.table("events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), "event_id")
    return jobs.replay(jobs.sequenced(e, "at"), 10).select(F.col("job_id").alias("user_id"), "event_id", "seq")


@query("SELECT count(*) AS n_done, 100.0::DOUBLE AS percent FROM events")
def stream_progress(g: Graph) -> DataFrame:
    """What the watchdog of a stream has seen of the events when they are through."""
    return jobs.watched(jobs.table_stream(g.spark, g.base, "events").select("event_id"), g.table("events").count())


@query("SELECT kind, count(*) AS n, count(DISTINCT repo_id) AS n_repos FROM call_edges WHERE kind IS NOT NULL GROUP BY kind HAVING count(*) > 10")
def adhoc_query(g: Graph) -> DataFrame:
    """A query text over the tables by name."""
    return g.sql("SELECT kind, count(*) AS n, count(DISTINCT repo_id) AS n_repos FROM call_edges WHERE kind IS NOT NULL GROUP BY kind HAVING count(*) > 10")


@query(r"""SELECT edge_id, from_method_fqn AS caller, to_method_fqn AS target, kind FROM call_edges WHERE from_method_fqn IS NOT NULL AND NOT regexp_matches(from_method_fqn, '[\t\n\r]')""")
def call_log(g: Graph) -> DataFrame:
    """The per-call log as tab-separated files of at most 5,000 rows each, read back."""
    calls = g.table("call_edges").where(F.col("from_method_fqn").isNotNull() & ~F.col("from_method_fqn").rlike("[\\t\\n\\r]")).select("edge_id", F.col("from_method_fqn").alias("caller"), F.col("to_method_fqn").alias("target"), "kind")
    path = f"{g.space.root}/calls"
    report.write_log(calls, path)
    return report.read_log(g.spark, path, calls.schema)


@query(
    _with(METHODS)
    + """, strategies AS (SELECT coalesce(kind, 'none') AS strategy, edge_id % 1000 AS took FROM call_edges)
SELECT strategy, count(*) AS n, round(avg(took), 6) AS average, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent, row_number() OVER (ORDER BY count(*) DESC, strategy)::INT AS place FROM strategies GROUP BY strategy"""
)
def strategy_counters(g: Graph) -> DataFrame:
    """Counts and averages of the resolution strategies, most frequent first, with their share."""
    return resolve.strategy_table(g.table("call_edges").select(F.coalesce("kind", F.lit("none")).alias("strategy"), (F.col("edge_id") % 1000).alias("took")))
