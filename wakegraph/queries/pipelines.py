"""Queries of the sources and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.operators import intervals
from wakegraph.plans import ingest, polyglot
from wakegraph.session import table
from wakegraph.sources import config, patches
from wakegraph.streaming import jobs


def _patches(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "documents").where("doc_kind = 'patch' and text is not null").select(F.col("doc_id").alias("patch_id"), "text")


def ingest_counts(spark: SparkSession, base: str) -> DataFrame:
    """Rows of every node and edge table that the Java files of the repositories give."""
    return ingest.counts(ingest.ingest(table(spark, base, "repo_files")))


def patch_files(spark: SparkSession, base: str) -> DataFrame:
    """Changed files of all patches with their edited ranges; a line number that is no int is null."""
    c = patches.git_changes(_patches(spark, base))
    last = F.when(~F.exists("hunk_ends", F.isnull), F.array_max("hunk_ends"))
    return c.select("patch_id", "ordinal", "old_path", "new_path", "change", F.size("hunk_starts").alias("n_edits"), F.array_min("hunk_starts").alias("first_line"), last.alias("last_line"))


def patch_lines(spark: SparkSession, base: str) -> DataFrame:
    """Added and removed lines of each patch."""
    return patches.line_counts(_patches(spark, base))


def _java_files(spark: SparkSession, base: str) -> DataFrame:
    """(file, path, lines) of the Java files of the repositories."""
    files = table(spark, base, "repo_files").where("content is not null and lower(path) like '%.java'")
    return files.select(F.concat_ws(":", "repo_id", "path").alias("file"), "path", "content").distinct().select("file", "path", F.split("content", "\r\n|\r|\n").alias("lines"))


def _patch_text(header: Column, lines: Column) -> Column:
    path = F.col("path")
    return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, header, F.array_join(lines, "\n"), F.lit("\n"))


def deleted_symbols(spark: SparkSession, base: str) -> DataFrame:
    """Declarations on the removed lines of patches that delete the Java files of the repositories."""
    header = F.concat(F.lit("\n+++ /dev/null\n@@ -1,"), F.size("lines").cast("string"), F.lit(" +0,0 @@\n"))
    gone = F.transform("lines", lambda x: F.concat(F.lit("-"), x))
    made = _java_files(spark, base).select(F.col("file").alias("patch_id"), _patch_text(header, gone).alias("text"))
    return patches.deleted_declarations(made).select(F.col("patch_id").alias("file"), "kind", "fqn", "line_no").distinct()


def hunk_shifts(spark: SparkSession, base: str) -> DataFrame:
    """Edited ranges moved to where their lines stand: of each Java file a patch of seven of its lines, three lines off."""
    files = _java_files(spark, base).where(F.size("lines") >= 18)
    header = F.concat(F.lit("\n+++ b/"), F.col("path"), F.lit("\n@@ -9,4 +9,7 @@\n"))
    seven = F.transform(F.slice("lines", 12, 7), lambda x, i: F.concat(F.when(i.between(2, 4), "+").otherwise(" "), x))
    made = files.select(F.col("file").alias("patch_id"), _patch_text(header, seven).alias("text"))
    lines = patches.hunk_lines(made).withColumn("hunk_id", F.concat_ws(":", "patch_id", "ordinal", "hunk")).withColumn("path", F.col("patch_id"))
    edits = patches.file_changes(made).select("patch_id", F.explode(F.arrays_zip(F.col("hunk_starts").alias("a"), F.col("hunk_ends").alias("b"))).alias("e"))
    edits = edits.select(F.concat_ws(":", "patch_id", "e.a").alias("edit_id"), F.col("patch_id").alias("file_path"), F.col("e.a").alias("h_start"), F.col("e.b").alias("h_end"))
    source = files.select(F.col("file").alias("file_path"), F.posexplode("lines").alias("n", "text")).select("file_path", (F.col("n") + 1).alias("line_no"), "text")
    moved = intervals.reconciled(edits, patches.hunk_contents(lines), patches.anchors(lines), source)
    return moved.select(F.col("file_path").alias("file"), "h_start", "h_end", "new_start", "new_end")


def seed_classes(spark: SparkSession, base: str) -> DataFrame:
    """Class names among the attributes of the XML files, by element and attribute."""
    return config.seed_classes(table(spark, base, "repo_files").where("content is not null and lower(path) like '%.xml'").select("path", "content"))


def secured_urls(spark: SparkSession, base: str) -> DataFrame:
    return config.secured_urls(table(spark, base, "repo_files").where("content is not null and lower(path) like '%.xml'").select("path", "content")).select("url")


def stream_states(spark: SparkSession, base: str) -> DataFrame:
    """The latest event type of every user and its number of events, kept by a stream over the events."""
    out = jobs.drain(jobs.latest(jobs.table_stream(spark, base, "events"), "user_id", "event_id", "event_type"), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("batch", "n")).alias("s"))
    return last.select("user_id", F.col("s.event_type").alias("event_type"), F.col("s.n").alias("n"))


def stream_buffer(spark: SparkSession, base: str) -> DataFrame:
    """The last 20 events of every user, kept in a stream's state."""
    events = jobs.table_stream(spark, base, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    out = jobs.drain(jobs.last_lines(events, 20), "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("total", "texts"), F.struct("batch", "total")).alias("s"))
    return last.select(F.col("job_id").alias("user_id"), F.col("s.total").alias("total"), F.array_join("s.texts", ",").alias("texts"))


QUERIES = {
    f.__name__: f
    for f in (ingest_counts, patch_files, patch_lines, deleted_symbols, hunk_shifts, seed_classes, secured_urls, stream_states, stream_buffer)
}

_PATCHES = r"""
patches AS (SELECT doc_id AS patch_id, regexp_split_to_array(text, '\r\n|\r|\n') AS parts FROM documents WHERE doc_kind = 'patch' AND text IS NOT NULL),
plines AS (SELECT patch_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM patches),
heads AS (SELECT *, regexp_matches(line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@') AS is_head FROM plines),
led AS (SELECT *, max(CASE WHEN is_head THEN n END) OVER (PARTITION BY patch_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS head FROM heads),
shaped AS (
  SELECT l.patch_id, l.line, l.n, l.head, CASE WHEN l.line = '' THEN ' ' ELSE l.line[1] END AS sign,
    coalesce(nullif(regexp_extract(h.line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 2), ''), '1')::INT AS olds, regexp_extract(h.line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 3)::INT AS new_start,
    coalesce(nullif(regexp_extract(h.line, '^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@', 4), ''), '1')::INT AS news
  FROM led l JOIN led h ON h.patch_id = l.patch_id AND h.n = l.head WHERE l.n > l.head),
summed AS (
  SELECT *, count(*) FILTER (WHERE sign IN (' ', '-')) OVER before AS old_before, count(*) FILTER (WHERE sign IN (' ', '+')) OVER before AS new_before, count(*) FILTER (WHERE sign NOT IN (' ', '-', '+', chr(92))) OVER before AS broken
  FROM shaped WINDOW before AS (PARTITION BY patch_id, head ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
hunks AS (
  SELECT patch_id, head, n, line, sign, new_start + CASE WHEN news = 0 THEN 1 ELSE 0 END + new_before AS new_no FROM summed
  WHERE sign IN (' ', '-', '+') AND broken = 0 AND (old_before < olds OR new_before < news))"""

SQL = {
    "patch_lines": f"""WITH {_PATCHES}
SELECT p.patch_id, count(*) FILTER (WHERE sign = '+') AS n_added, count(*) FILTER (WHERE sign = '-') AS n_removed FROM patches p LEFT JOIN hunks h ON h.patch_id = p.patch_id GROUP BY p.patch_id""",
    "patch_files": rf"""WITH {_PATCHES},
marks AS (SELECT l.* FROM plines l LEFT JOIN hunks h ON h.patch_id = l.patch_id AND h.n = l.n WHERE h.n IS NULL),
files AS (SELECT patch_id, n AS first, lead(n) OVER (PARTITION BY patch_id ORDER BY n) AS next, (row_number() OVER (PARTITION BY patch_id ORDER BY n) - 1)::INT AS ordinal, line FROM marks WHERE starts_with(line, 'diff --git ')),
named AS (
  SELECT f.patch_id, f.ordinal, f.first, f.next, f.line, max(m.line) FILTER (WHERE starts_with(m.line, '--- ')) AS a, max(m.line) FILTER (WHERE starts_with(m.line, '+++ ')) AS b,
    coalesce(bool_or(starts_with(m.line, 'rename from ')), false) AS renamed, coalesce(bool_or(starts_with(m.line, 'copy from ')), false) AS copied
  FROM files f LEFT JOIN marks m ON m.patch_id = f.patch_id AND m.n > f.first AND (f.next IS NULL OR m.n < f.next) GROUP BY ALL),
paths AS (
  SELECT patch_id, ordinal, first, next, CASE WHEN a = '--- /dev/null' THEN NULL ELSE regexp_replace(trim(split_part(coalesce(a[5:], regexp_extract(line, '^diff --git (.*?) b/', 1)), chr(9), 1)), '^a/', '') END AS old_path,
    CASE WHEN b = '+++ /dev/null' THEN NULL ELSE regexp_replace(trim(split_part(coalesce(b[5:], regexp_extract(line, ' (b/.*)$', 1)), chr(9), 1)), '^b/', '') END AS new_path,
    CASE WHEN b = '+++ /dev/null' THEN 'DELETE' WHEN a = '--- /dev/null' THEN 'ADD' WHEN renamed THEN 'RENAME' WHEN copied THEN 'COPY' ELSE 'MODIFY' END AS change FROM named),
runs AS (SELECT *, count(*) FILTER (WHERE sign = ' ') OVER (PARTITION BY patch_id, head ORDER BY n) AS run FROM hunks),
edits AS (SELECT patch_id, head, run, min(new_no) AS low, greatest(min(new_no) + count(*) FILTER (WHERE sign = '+') - 1, min(new_no)) AS high FROM runs WHERE sign <> ' ' GROUP BY ALL)
SELECT p.patch_id, ordinal, old_path, new_path, change, count(low)::INT AS n_edits, min(low)::INT AS first_line, max(high)::INT AS last_line
FROM paths p LEFT JOIN edits e ON e.patch_id = p.patch_id AND e.head > p.first AND (p.next IS NULL OR e.head < p.next) AND change <> 'DELETE' GROUP BY ALL""",
    "deleted_symbols": r"""WITH f AS (SELECT DISTINCT concat_ws(':', repo_id, path) AS file, regexp_extract(path, '([^/\\]+)\.[^.]*$', 1) AS top, content FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.java'),
s AS (SELECT file, top, regexp_split_to_array(content, '\r\n|\r|\n') AS parts FROM f),
l AS (SELECT file, top, unnest(parts) AS t, generate_subscripts(parts, 1)::INT AS line_no FROM s),
p AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(t, '^\s*package\s+([A-Za-z_$][\w$.]*)\s*;') THEN regexp_extract(t, '^\s*package\s+([A-Za-z_$][\w$.]*)\s*;', 1) || '.' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS pkg FROM l),
g AS (SELECT *, regexp_extract(t, '^\s*(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*(class|interface|enum|record)\s+([A-Za-z_$][\w$]*)', ['word', 'name']) AS c,
  regexp_extract(t, '^\s*(?:@\w+\s+)*((?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*)(?:<[^>]*>\s+)?((?:[A-Za-z_$][\w$.]*(?:<[^()]*>)?(?:\[\])*\s+)?)([A-Za-z_$][\w$]*)\s*\(([^()]*)\)\s*(?:throws\s+[\w$.,\s]+)?[{;]', ['mods', 'returns', 'name', 'params']) AS m FROM p),
k AS (SELECT *, CASE WHEN c.word = 'interface' THEN 'INTERFACE' WHEN c.word <> '' THEN 'CLASS' WHEN m.name = top AND trim(m.returns) = '' THEN 'CONSTRUCTOR'
    WHEN m.name NOT IN ('', top, 'if', 'for', 'while', 'switch', 'catch', 'synchronized', 'super', 'this') AND trim(m.returns) NOT IN ('', 'return', 'new', 'throw', 'else', 'case', 'assert', 'yield', 'package', 'import') THEN 'METHOD' END AS kind,
  array_to_string(list_filter(string_split(m.params, ''), lambda ch, i: len(replace(m.params[1:i], '>', '')) = len(replace(m.params[1:i], '<', '')) AND ch <> '>'), '') AS bare FROM g),
q AS (SELECT *, CASE WHEN trim(bare) = '' THEN '' ELSE array_to_string(list_transform(string_split(trim(bare), ','), lambda x: regexp_replace(regexp_replace(trim(x, ' 	'), '^final\s+|\s+[\w$]+$', '', 'g'), '^.*\.', '')), ',') END AS params FROM k WHERE kind IS NOT NULL)
SELECT DISTINCT file, kind, CASE WHEN c.word <> '' THEN pkg || c.name ELSE pkg || top || '.' || CASE WHEN kind = 'CONSTRUCTOR' THEN '<init>' ELSE m.name END || '(' || params || ')' END AS fqn, line_no FROM q""",
    "hunk_shifts": r"""WITH f AS (SELECT DISTINCT concat_ws(':', repo_id, path) AS file, content FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.java'),
s AS (SELECT file, regexp_split_to_array(content, '\r\n|\r|\n') AS parts FROM f),
l AS (SELECT file, len(parts) AS n_lines, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS t, generate_subscripts(parts, 1) AS line_no FROM s WHERE len(parts) >= 18),
a AS (SELECT file, t, line_no - 3 AS expected, CASE WHEN line_no IN (17, 18) THEN 1 WHEN line_no IN (12, 13) THEN 2 ELSE 3 END AS kind FROM l WHERE line_no BETWEEN 12 AND 18 AND length(t) >= CASE WHEN line_no BETWEEN 14 AND 16 THEN 20 ELSE 8 END),
w AS (SELECT file, kind, count(*) AS n, min(expected) AS first FROM a GROUP BY ALL),
h AS (SELECT file, kind, l.line_no - expected AS shift, n_lines, count(*) AS n FROM a JOIN l USING (file, t) GROUP BY ALL),
p AS (SELECT h.*, first + shift AS place FROM h JOIN w USING (file, kind, n)),
b AS (SELECT file, first(shift ORDER BY kind, abs(place - 9), place) AS shift FROM p WHERE place >= 9 - greatest(50, abs(n_lines - 8)) AND place < 9 + greatest(50, abs(n_lines - 8)) GROUP BY file)
SELECT DISTINCT l.file, 11 AS h_start, 13 AS h_end, greatest(11 + coalesce(shift, 0), 1)::INT AS new_start, CASE WHEN coalesce(shift, 0) = 0 THEN 13 ELSE least(greatest(13 + shift, greatest(11 + shift, 1)), n_lines) END::INT AS new_end
FROM l LEFT JOIN b USING (file)""",
    "secured_urls": r"""SELECT DISTINCT url FROM (
  SELECT unnest(regexp_extract_all(content, '<url\b[^<>]*?\bpath\s*=\s*["'']([^"''<>]*)["'']', 1)) AS url FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.xml')""",
    "seed_classes": r"""WITH t AS (SELECT unnest(regexp_extract_all(content, '<([A-Za-z_]\w*\s[^<>]*)>', 1)) AS body FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.xml'),
p AS (SELECT lower(regexp_extract(body, '^(\w+)', 1)) AS "table", unnest(regexp_extract_all(body, '([A-Za-z_][\w.-]*)\s*=\s*["'']([^"''<>]*)["'']', 1)) AS "column", unnest(regexp_extract_all(body, '([A-Za-z_][\w.-]*)\s*=\s*["'']([^"''<>]*)["'']', 2)) AS class_fqn FROM t)
SELECT DISTINCT "table", upper("column") AS "column", class_fqn FROM p WHERE regexp_matches(class_fqn, '^[a-z_]\w*(\.\w+)*\.[A-Z]\w*$')""",
    "stream_states": "SELECT user_id, arg_max(event_type, event_id) AS event_type, count(*) AS n FROM events GROUP BY user_id",
    "stream_buffer": """SELECT user_id, max(total) AS total, string_agg(event_type, ',' ORDER BY event_id) AS texts
FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20 GROUP BY user_id""",
}


def _repo_texts(spark: SparkSession, base: str, extension: str) -> DataFrame:
    files = table(spark, base, "repo_files").where(f"content is not null and lower(path) like '%.{extension}'")
    return files.select(F.concat_ws(":", "repo_id", "path").alias("file"), "content").distinct()


def xml_columns(spark: SparkSession, base: str) -> DataFrame:
    """Columns of the XML files with the table around them."""
    return polyglot.xml_columns(polyglot.file_lines(_repo_texts(spark, base, "xml")))


def script_functions(spark: SparkSession, base: str) -> DataFrame:
    """Named functions of the JavaScript files."""
    return polyglot.script_functions(_repo_texts(spark, base, "js"))


def owner_facts(spark: SparkSession, base: str) -> DataFrame:
    """Classes with their methods, parents and callers' repositories, a list each."""
    m = table(spark, base, "method_nodes").where("owner_fqn is not null and simple_name is not null")
    e = table(spark, base, "extends_edges").where("from_class_fqn is not null and to_class_fqn is not null")
    c = table(spark, base, "call_edges").where("to_method_fqn is not null and repo_id is not null")
    owner = F.regexp_extract("to_method_fqn", r"^(.*)\.([^.(]+)\([^()]*\)$", 1)
    return polyglot.owner_facts(m.select(F.col("owner_fqn").alias("owner")), {
        "methods": m.select(F.col("owner_fqn").alias("owner"), F.col("simple_name").alias("value")), "parents": e.select(F.col("from_class_fqn").alias("owner"), F.col("to_class_fqn").alias("value")),
        "caller_repos": c.select(owner.alias("owner"), F.col("repo_id").alias("value")).distinct(),
    })


def feature_pivot(spark: SparkSession, base: str) -> DataFrame:
    """Calls and callers by kind, with totals."""
    c = table(spark, base, "call_edges").groupBy("kind", F.col("repo_id").alias("owner")).agg(F.count(F.lit(1)).alias("n"))
    return polyglot.feature_pivot(c)


QUERIES |= {f.__name__: f for f in (xml_columns, script_functions, owner_facts, feature_pivot)}

SQL |= {
    "xml_columns": r"""WITH f AS (SELECT DISTINCT concat_ws(':', repo_id, path) AS file, content FROM repo_files WHERE content IS NOT NULL AND lower(path) LIKE '%.xml'),
l AS (SELECT file, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) AS text, generate_subscripts(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), 1) AS line_no FROM f),
m AS (SELECT *, CASE WHEN regexp_extract(text, '<table\b[^<>]*?\bname\s*=\s*["'']([^"''<>]*)["'']', 1) <> '' THEN regexp_extract(text, '<table\b[^<>]*?\bname\s*=\s*["'']([^"''<>]*)["'']', 1) WHEN contains(text, '</table') THEN '' END AS mark FROM l),
c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS t, regexp_extract(text, '<column\b[^<>]*?\bname\s*=\s*["'']([^"''<>]*)["'']', 1) AS col FROM m)
SELECT file, line_no, CASE WHEN t <> '' THEN t END AS "table", col AS "column", regexp_extract(text, '<column\b[^<>]*?\btype\s*=\s*["'']([^"''<>]*)["'']', 1) AS data_type FROM c WHERE col <> ''""",
    "owner_facts": r"""WITH o AS (SELECT DISTINCT owner_fqn AS owner FROM method_nodes WHERE owner_fqn IS NOT NULL AND simple_name IS NOT NULL),
m AS (SELECT owner_fqn AS owner, string_agg(DISTINCT simple_name, ',' ORDER BY simple_name) AS methods FROM method_nodes WHERE owner_fqn IS NOT NULL GROUP BY 1),
p AS (SELECT from_class_fqn AS owner, string_agg(DISTINCT to_class_fqn, ',' ORDER BY to_class_fqn) AS parents FROM extends_edges WHERE from_class_fqn IS NOT NULL AND to_class_fqn IS NOT NULL GROUP BY 1),
c AS (SELECT regexp_extract(to_method_fqn, '^(.*)\.([^.(]+)\([^()]*\)$', 1) AS owner, string_agg(DISTINCT repo_id, ',' ORDER BY repo_id) AS caller_repos FROM call_edges WHERE to_method_fqn IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1)
SELECT owner, coalesce(methods, '') AS methods, coalesce(parents, '') AS parents, coalesce(caller_repos, '') AS caller_repos FROM o LEFT JOIN m USING (owner) LEFT JOIN p USING (owner) LEFT JOIN c USING (owner)""",
    "feature_pivot": """SELECT coalesce(kind, 'none') AS kind, count(DISTINCT repo_id) AS n_owners, count(*) AS total FROM call_edges GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT repo_id), count(*) FROM call_edges""",
}
