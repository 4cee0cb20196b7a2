"""The impact report: counts, affected interfaces, schedules and tables, as nested rows, JSON and HTML."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakegraph.functions import names
from wakegraph.functions.names import RISK_RANK, name_of_rank, rank


def affected_apis(entries: DataFrame, risks: DataFrame, own: DataFrame) -> DataFrame:
    """(url, count, risk, n_methods, first_entry): every URL that changed methods come out at, most risky first by risk.

    entries: seed, entry, url (reached from below); own: seed, url (exposed by the changed class itself); risks: fqn,
    risk. count is one for each (seed, entry, url) and each own exposure; risk is the greatest of the seeds'.
    """
    evidence = entries.select("seed", "entry", "url").distinct().unionByName(own.select("seed", F.lit(None).cast("string").alias("entry"), "url").distinct())
    graded = evidence.join(risks.select(F.col("fqn").alias("seed"), rank(F.col("risk"), RISK_RANK).alias("r")), "seed", "left")
    return graded.groupBy("url").agg(
        F.count(F.lit(1)).alias("count"), name_of_rank(F.max(F.coalesce("r", F.lit(1))), RISK_RANK).alias("risk"), F.count_distinct("seed").alias("n_methods"), F.min("entry").alias("first_entry")
    )


def affected_schedules(points: DataFrame, risks: DataFrame) -> DataFrame:
    """(task, count, risk, n_methods) of schedule points (seed, entry, task)."""
    graded = points.join(risks.select(F.col("fqn").alias("seed"), rank(F.col("risk"), RISK_RANK).alias("r")), "seed", "left")
    return graded.groupBy("task").agg(F.count(F.lit(1)).alias("count"), name_of_rank(F.max(F.coalesce("r", F.lit(1))), RISK_RANK).alias("risk"), F.count_distinct("seed").alias("n_methods"))


def interface_paths(ends: DataFrame, risks: DataFrame) -> DataFrame:
    """(url, rank, n_paths, shortest, owner, changed): of ends(seed, node, dist, url, owner) one row a URL.

    n_paths counts the pairs of a change and an entry; owner is that of the nearest entry, the least name among equals;
    changed lists the first five changes, of which no more are kept while they are gathered; rank is the greatest risk.
    """
    graded = ends.join(risks.select(F.col("fqn").alias("seed"), rank(F.col("risk"), RISK_RANK).alias("r")), "seed", "left")
    per_url = graded.groupBy("url").agg(
        F.max(F.coalesce("r", F.lit(1))).alias("rank"), F.count(F.lit(1)).alias("n_paths"), F.min("dist").alias("shortest"), F.min_by("owner", F.struct("dist", "node")).alias("owner")
    )
    first = F.row_number().over(Window.partitionBy("url").orderBy("seed"))
    listed = ends.select("url", "seed").distinct().withColumn("k", first).where("k <= 5").groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("seed")), ",").alias("changed"))
    return per_url.join(listed, "url").select("url", "rank", "n_paths", "shortest", "owner", "changed")


# Evidence for an affected task, strongest first.
SCHEDULE_SOURCES = {"runs-changed": 1, "task-changed": 2, "reads-changed-table": 3}


def rich_schedules(evidence: DataFrame, risks: DataFrame, touched: DataFrame) -> DataFrame:
    """(task, source, prio, n_changed, rank, reads, writes) of evidence(task, seed, prio): the strongest counts.

    risks: fqn, risk; touched: task, access, name. rank is the greatest risk of the changes, LOW without any.
    """
    graded = evidence.join(risks.select(F.col("fqn").alias("seed"), rank(F.col("risk"), RISK_RANK).alias("r")), "seed", "left")
    best = graded.groupBy("task").agg(F.min("prio").alias("prio"), F.count_distinct("seed").alias("n_changed"), F.coalesce(F.max("r"), F.lit(1)).alias("rank"))
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("access") == kind, F.col("name")))), ",")
    own = touched.groupBy("task").agg(of("READS_TABLE").alias("reads"), of("WRITES_TABLE").alias("writes"))
    return best.join(own, "task", "left").select(
        "task", name_of_rank(F.col("prio"), SCHEDULE_SOURCES).alias("source"), "prio", "n_changed", "rank", F.coalesce("reads", F.lit("")).alias("reads"), F.coalesce("writes", F.lit("")).alias("writes")
    )


def rich_tables(sources: DataFrame, access: DataFrame, sample: int = 10) -> DataFrame:
    """(name, source, prio, n_readers, n_writers, readers, writers) of sources(name, source); the lists hold the first `sample`.

    access: src, access, name, distinct.
    """
    k = F.row_number().over(Window.partitionBy("name", "access").orderBy("src"))
    numbered = access.withColumn("k", k)
    kinds = {"readers": "READS_TABLE", "writers": "WRITES_TABLE"}
    counts = [F.count_if(F.col("access") == v).alias(f"n_{n}") for n, v in kinds.items()]
    lists = [F.array_join(F.array_sort(F.collect_list(F.when((F.col("access") == v) & (F.col("k") <= sample), F.col("src")))), ",").alias(n) for n, v in kinds.items()]
    grouped = numbered.groupBy("name").agg(*counts, *lists)
    zero = [F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in kinds]
    none = [F.coalesce(n, F.lit("")).alias(n) for n in kinds]
    return sources.join(grouped, "name", "left").select("name", "source", rank(F.col("source"), names.TABLE_SOURCE_RANK).alias("prio"), *zero, *none)


def list_sizes(summary: DataFrame) -> DataFrame:
    """One row of sums over impact_summary: symbols, entry points, URLs and tasks, each as often as it is listed."""
    urls = F.size(F.filter(F.split("urls", " "), lambda u: u != ""))
    return summary.agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n_entries").alias("n_entries"), F.sum(urls).alias("n_urls"), F.sum("n_tasks").alias("n_tasks"))


def table_sources(schema_changed: DataFrame, reached: DataFrame, safety: DataFrame | None = None) -> DataFrame:
    """(name, source) of tables named by schema changes (name) and by code (name): both, schema-changed or java-reached;
    those of safety (name) that neither names are regression-safety."""
    if safety is not None:
        found = table_sources(schema_changed, reached)
        return found.unionByName(safety.select("name").distinct().join(found, "name", "left_anti").select("name", F.lit("regression-safety").alias("source")))
    s, j = schema_changed.select("name").distinct().withColumn("s", F.lit(True)), reached.select("name").distinct().withColumn("j", F.lit(True))
    return s.join(j, "name", "full_outer").select("name", F.when(F.col("s") & F.col("j"), "both").when(F.col("s"), "schema-changed").otherwise("java-reached").alias("source"))


def layer_summary(reach_tables: DataFrame) -> DataFrame:
    """One row: distinct tables read, written and touched by changed methods, and the first 20 names."""
    t = reach_tables.select("name", "access").distinct()
    numbered = t.select("name").distinct()
    first = numbered.orderBy("name").limit(20).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("sample"))  # 20 names
    totals = t.agg(F.count_distinct("name").alias("n_tables"), F.count_if(F.col("access") == "READS_TABLE").alias("n_read"), F.count_if(F.col("access") == "WRITES_TABLE").alias("n_written"))
    return totals.crossJoin(first)  # one row each


def escalated(changes: DataFrame, high_owners: DataFrame) -> DataFrame:
    """changes(file_path, risk, owners) with risk HIGH where an owner is of high risk itself."""
    marks = changes.select("file_path", F.explode("owners").alias("owner")).join(high_owners.select("owner").distinct(), "owner", "left_semi").select("file_path").distinct().withColumn("__high", F.lit(True))
    return changes.join(marks, "file_path", "left").withColumn("risk", F.when(F.col("__high"), "HIGH").otherwise(F.col("risk"))).drop("__high")


def overall_risk(risks: DataFrame) -> DataFrame:
    """One row: the greatest risk, LOW where there is none."""
    return risks.agg(name_of_rank(F.coalesce(F.max(rank(F.col("risk"), RISK_RANK)), F.lit(1)), RISK_RANK).alias("risk"))


def symbol_rows(summary: DataFrame) -> DataFrame:
    """Nested rows (fqn, impact) of impact_summary."""
    return summary.select("fqn", F.struct("risk", "entry_count", "n_entries", F.filter(F.split("urls", " "), lambda u: u != "").alias("urls"), "n_tasks").alias("impact"))


def json_lines(summary: DataFrame) -> DataFrame:
    """(fqn, report): each changed method's part of the report as JSON."""
    return symbol_rows(summary).select("fqn", F.to_json(F.struct("fqn", "impact")).alias("report"))


def write_json(summary: DataFrame, path: str) -> None:
    """The report as JSON lines, one file a task."""
    symbol_rows(summary).write.mode("overwrite").json(path)


def _escaped(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def html_rows(df: DataFrame) -> DataFrame:
    """(value): a table row of every row, cells escaped, nulls empty, nested values as JSON."""
    cells = []
    for f in df.schema:
        own = F.col(f"`{f.name}`")
        text = own if isinstance(f.dataType, T.StringType) else own.cast("string") if isinstance(f.dataType, T.AtomicType) else F.to_json(own)
        cells += [F.lit("<td>"), F.coalesce(_escaped(text), F.lit("")), F.lit("</td>")]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def html_lines(title: str, sections: dict[str, DataFrame]) -> Iterator[str]:
    """A page with one table a section, line by line and with all rows; a partition of them is on the driver at a time."""
    yield f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
    for name, df in sections.items():
        yield f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
        yield from (r.value for r in html_rows(df).toLocalIterator())
        yield "</table>"
    yield "</body></html>"


def render_html(title: str, sections: dict[str, DataFrame]) -> str:
    """The page as one text, for reports that fit one; write_html for those that don't."""
    return "".join(html_lines(title, sections))


def write_html(sections: dict[str, DataFrame], folder: str) -> None:
    """The table rows of each section as text files below folder/section, written by the tasks that have them."""
    for name, df in sections.items():
        html_rows(df).write.mode("overwrite").text(f"{folder}/{name}")


LOG_ROWS = 5000  # rows a file of a log
_LOG = {"sep": "\t", "nullValue": "\\N", "emptyValue": "", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_log(calls: DataFrame, path: str) -> None:
    """Calls as tab-separated files of at most LOG_ROWS rows, written by the tasks that have them."""
    calls.write.mode("overwrite").options(**_LOG).option("maxRecordsPerFile", LOG_ROWS).csv(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**_LOG).csv(path)


def gate(risks: DataFrame, threshold: str) -> bool:
    """Whether a run fails: its overall risk reaches the threshold (every risk reaches an unknown one)."""
    return bool(overall_risk(risks).select(names.exceeds(F.col("risk"), threshold)).first()[0])
