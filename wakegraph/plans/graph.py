"""The property graph over the test tables: typed node and edge tables, each a declared plan.

Where the tables have no column for a notion of the graph it is derived by a fixed rule, stated at the property.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import hierarchy, merge, resolve, traverse
from wakegraph.session import Workspace, table

# Classes of the shared platform that give others their role.
ACTION_BASE = "io.harborline.platform.web.BaseAction"
TASK_BASE = "io.harborline.platform.task.BaseTask"
QUERY_CALL = "io.harborline.platform.dao.DbSession.query(String,Object[])"
UPDATE_CALL = "io.harborline.platform.dao.Criteria.<init>(?)"
SENSITIVE = (".security.", ".audit.")


class Graph:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.space = spark, base, Workspace(spark)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    def sql(self, text: str) -> DataFrame:
        """A query text over the tables, each a view by its name."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        for status in folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder):
            file = status.getPath().getName()
            if file.endswith(".parquet"):
                self.table(file.removesuffix(".parquet")).createOrReplaceTempView(file.removesuffix(".parquet"))
        return self.spark.sql(text)

    @cached_property
    def methods(self) -> DataFrame:
        """One row per fqn, the latest: fqn, owner, simple, n_params, types, is_static, labels, start_line, end_line, commit_sha."""
        rows = self.table("method_nodes").where("fqn is not null").select(
            "fqn", "recorded_at", "start_line", "end_line", "commit_sha", F.col("owner_fqn").alias("owner"), F.col("simple_name").alias("simple"),
            "is_static", F.coalesce("extra_labels", F.array().cast("array<string>")).alias("labels"),
        )
        latest = merge.last_row(rows, ["fqn"], "recorded_at", "start_line", "end_line", "commit_sha")
        known = ~F.col("fqn").endswith("(?)")
        return latest.select(
            "fqn", "owner", "simple", F.when(known, names.parameter_count(F.col("fqn"))).alias("n_params"), F.when(known, names.parameter_types(F.col("fqn"))).alias("types"),
            "is_static", "labels", "start_line", "end_line", "commit_sha",
        )

    @cached_property
    def calls(self) -> DataFrame:
        """Distinct (src, dst) of call edges."""
        return traverse.edges_of(self.table("call_edges"), "from_method_fqn", "to_method_fqn")

    @cached_property
    def hierarchy(self) -> DataFrame:
        return hierarchy.class_links(self.table("extends_edges"), self.table("implements_edges"))

    @cached_property
    def ancestors(self) -> DataFrame:
        return self.space.put(traverse.closure(self.hierarchy))

    @cached_property
    def method_urls(self) -> DataFrame:
        """(src, url): a method with the label EntryPoint exposes /class/method in lower case."""
        return self.methods.where(F.array_contains("labels", "EntryPoint")).select(
            F.col("fqn").alias("src"), F.lower(F.concat(F.lit("/"), names.simple_name(F.col("owner")), F.lit("/"), F.col("simple"))).alias("url")
        )

    @cached_property
    def class_urls(self) -> DataFrame:
        """(class_fqn, url): direct subclasses of the action base are served as servlet:<class>."""
        return self.hierarchy.where(F.col("parent") == ACTION_BASE).select(F.col("child").alias("class_fqn"), F.concat(F.lit("servlet:"), "child").alias("url"))

    @cached_property
    def tasks(self) -> DataFrame:
        """(class_fqn, task): direct subclasses of the task base are scheduled under their simple name."""
        return self.hierarchy.where(F.col("parent") == TASK_BASE).select(F.col("child").alias("class_fqn"), names.simple_name(F.col("child")).alias("task"))

    @cached_property
    def method_tasks(self) -> DataFrame:
        """(src, task): methods of task classes, whichever way the schedule edge points."""
        return self.methods.join(self.tasks, F.col("owner") == F.col("class_fqn")).select(F.col("fqn").alias("src"), "task")

    @cached_property
    def table_access(self) -> DataFrame:
        """(src, access, name): callers of the query and update entry points touch the table named after their class."""
        access = F.when(F.col("dst") == QUERY_CALL, "READS_TABLE").when(F.col("dst") == UPDATE_CALL, "WRITES_TABLE")
        hits = self.calls.where(F.col("dst").isin(QUERY_CALL, UPDATE_CALL))
        return hits.select("src", access.alias("access"), F.upper(names.simple_name(names.method_owner(F.col("src")))).alias("name")).where("name <> ''").distinct()

    @cached_property
    def overrides(self) -> DataFrame:
        return self.space.put(resolve.overrides(self.methods, self.ancestors))

    @cached_property
    def starts_thread(self) -> DataFrame:
        """(src, dst): whoever makes an instance of a task class starts its methods without parameters."""
        made = self.calls.select("src", names.method_owner(F.col("dst")).alias("class_fqn"), names.method_simple(F.col("dst")).alias("called")).where("called = '<init>'")
        runs = self.methods.where("n_params = 0 and simple <> '<init>'").select(F.col("owner").alias("class_fqn"), F.col("fqn").alias("dst"))
        return made.join(self.tasks.select("class_fqn"), "class_fqn", "left_semi").join(runs, "class_fqn").select("src", "dst").distinct()

    def typed_edges(self, *types: str) -> DataFrame:
        """(src, dst, etype) of CALLS, STARTS_THREAD and OVERRIDES edges; an edge of several types once, by its least."""
        tables = {"CALLS": lambda: self.calls, "STARTS_THREAD": lambda: self.starts_thread, "OVERRIDES": lambda: self.overrides}
        out = None
        for t in types:
            one = tables[t]().select("src", "dst", F.lit(t).alias("etype"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("src", "dst").agg(F.min("etype").alias("etype"))

    @cached_property
    def inputs(self) -> DataFrame:
        """(input, fqn): names of changed methods and the graph's names for them, exact before fuzzy."""
        changed = self.table("changed_symbols").where(F.col("kind").isin("METHOD", "CONSTRUCTOR")).select(F.col("fqn").alias("input"))
        found = resolve.fuzzy_methods(changed, self.methods.where("n_params is not null"))
        return self.space.put(found.select("input", "fqn").distinct())

    @cached_property
    def seeds(self) -> DataFrame:
        return self.inputs.select(F.col("fqn").alias("seed")).distinct()

    def backward(self, depth: int, with_seed: bool = True) -> DataFrame:
        return traverse.bfs(self.seeds, self.calls, depth, backward=True, with_seed=with_seed)

    def forward(self, depth: int, with_seed: bool = True) -> DataFrame:
        return traverse.bfs(self.seeds, self.calls, depth, with_seed=with_seed)
