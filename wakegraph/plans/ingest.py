"""From source files to the graph: declarations become nodes, call sites are resolved to edges by joins.

Extensions take part through `Detector`: per_file sees the records of one pass over the files, after_all the finished
tables; both return further tables by name.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakegraph.functions import names
from wakegraph.operators import resolve, traverse
from wakegraph.session import Workspace
from wakegraph.sources.java_source import java_records


class Detector(Protocol):
    def per_file(self, records: DataFrame) -> dict[str, DataFrame]: ...

    def after_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]: ...


def ingest(files: DataFrame, detectors: Sequence[Detector] = ()) -> dict[str, DataFrame]:
    """Node and edge tables of files(repo_id, path, content); all nodes before any edge.

    classes, methods, fields, extends, implements, contains, calls (src, dst, kind), accesses (src, dst field), starts_thread (src, dst),
    reflects (src, dst), servlets (class_fqn, url); and what the detectors add.
    """
    space = Workspace(files.sparkSession)
    r = space.put(java_records(files))
    types = r.where(F.col("kind").isin("class", "interface", "enum", "record"))
    classes = space.put(types.select(
        F.col("name").alias("fqn"), names.simple_name(F.col("name")).alias("simple"), F.col("pkg"), "repo_id", "path", (F.col("kind") == "interface").alias("is_interface"), "start_line", "end_line",
        "types", F.filter(F.split(F.coalesce("text", F.lit("")), ","), lambda x: x != "").alias("interfaces"),
    ).distinct())
    methods = space.put(r.where(F.col("kind").isin("method", "constructor")).select(
        F.col("name").alias("fqn"), "owner", F.when(F.col("kind") == "constructor", "<init>").otherwise(F.regexp_extract("name", r"\.([^.(]+)\(", 1)).alias("simple"),
        F.col("arity").alias("n_params"), "types", F.col("text").alias("return_type"), "is_static", "start_line", "end_line", "repo_id", "path",
    ).dropDuplicates(["fqn"]))
    fields = r.where("kind = 'field'").select(F.col("name").alias("fqn"), "owner", F.try_element_at("types", F.lit(1)).alias("type"), F.col("text").alias("constant_value"), "is_static").distinct()

    file = F.concat_ws(":", F.coalesce("repo_id", F.lit("")), "path")
    imports = r.where("kind = 'import' and not is_static").select(file.alias("file"), F.col("name").alias("target")).distinct()
    known = classes.select(F.col("fqn").alias("class_fqn"), "simple", F.regexp_replace("fqn", r"\.[^.]*$", "").alias("pkg")).distinct()
    parents = classes.select("fqn", file.alias("file"), "pkg", F.explode(F.concat(F.transform("types", lambda t: F.struct(F.lit("extends").alias("how"), t.alias("name"))), F.transform("interfaces", lambda t: F.struct(F.lit("implements").alias("how"), t.alias("name"))))).alias("p"))
    parents = parents.select("fqn", "file", "pkg", "p.how", "p.name")
    sites = space.put(r.where("kind in ('call', 'access')").withColumn("site", F.monotonically_increasing_id()).select(
        "site", F.col("kind").alias("what"), file.alias("file"), "pkg", F.col("owner").alias("src"), F.try_element_at("types", F.lit(1)).alias("inside"), "name", "arity", "scope_kind", F.regexp_replace("scope", r"(\[\])+$", "").alias("scope"), "text", F.col("start_line").alias("line"),
    ))
    plain = lambda c: F.regexp_replace(names.without_generics(c), r"(\[\])+$", "")
    typed = r.where("kind = 'field'").select("owner", F.substring_index("name", ".", -1).alias("field"), file.alias("file"), "pkg", plain(F.try_element_at("types", F.lit(1))).alias("name")).where("name is not null").distinct()
    by_type = sites.where("scope is not null and scope_kind <> 'field'")
    uses = parents.select("file", "pkg", "name").unionByName(by_type.select("file", "pkg", F.col("scope").alias("name"))).unionByName(typed.select("file", "pkg", "name")).distinct()
    dotted = uses.where(F.col("name").contains(".")).select("file", "name", F.col("name").alias("class_fqn"))
    named = space.put(resolve.import_cascade(uses.where(~F.col("name").contains(".")), imports, known).select("file", "name", "class_fqn").unionByName(dotted))
    edges = parents.join(named, ["file", "name"]).select("how", F.col("fqn").alias("child"), F.col("class_fqn").alias("parent")).distinct()
    ancestors = space.put(traverse.closure(edges))

    own = sites.where(F.col("scope_kind").isin("none", "this")).select("site", F.col("inside").alias("owner"), F.col("name").alias("simple"), "arity")
    above = sites.where("scope_kind = 'super'").join(edges.where("how = 'extends'").select(F.col("child").alias("inside"), F.col("parent").alias("owner")), "inside").select("site", "owner", F.col("name").alias("simple"), "arity")
    scoped = by_type.join(named.withColumnRenamed("name", "scope"), ["file", "scope"]).select("site", F.col("class_fqn").alias("owner"), F.col("name").alias("simple"), "arity")
    # by fields of the class or of its nearest ancestor that has one of the name, whose type is read in the declaring file
    lineage = ancestors.select(F.col("child").alias("inside"), F.col("ancestor").alias("owner"), "depth").unionByName(classes.select(F.col("fqn").alias("inside"), F.col("fqn").alias("owner"), F.lit(0).alias("depth"))).distinct()
    of_type = typed.join(named, ["file", "name"]).select("owner", "field", "class_fqn")
    asked = sites.where("scope_kind = 'field'").select("inside", F.col("scope").alias("field")).distinct()
    nearest = asked.join(lineage, "inside").join(of_type, ["owner", "field"]).groupBy("inside", "field").agg(F.min_by("class_fqn", F.struct("depth", "owner", "class_fqn")).alias("owner"))
    by_field = sites.where("scope_kind = 'field'").join(nearest.withColumnRenamed("field", "scope"), ["inside", "scope"]).select("site", "owner", F.col("name").alias("simple"), "arity")
    everything = space.put(own.unionByName(above).unionByName(scoped).unionByName(by_field).join(sites.select("site", "what"), "site"))
    shaped = everything.where("what = 'call'").drop("what")
    fields_of = fields.select("owner", F.substring_index("fqn", ".", -1).alias("simple"), "fqn").distinct()
    reads = everything.where("what = 'access'").select("owner", "simple").distinct()
    found_fields = reads.withColumnRenamed("owner", "inside").join(lineage, "inside").join(fields_of, ["owner", "simple"]).groupBy("inside", "simple").agg(F.min_by("fqn", F.struct("depth", "fqn")).alias("dst"))
    accesses = everything.where("what = 'access'").select("site", F.col("owner").alias("inside"), "simple").join(found_fields, ["inside", "simple"]).join(sites.select("site", "src"), "site").select("src", "dst").distinct()
    shapes = shaped.select("owner", "simple", "arity").distinct().withColumn("site", F.struct("owner", "simple", "arity"))
    found = resolve.resolve_calls(shapes, methods, ancestors).select("site.*", "target", "kind")
    kind = F.when((F.col("simple") == "<init>") & (F.col("kind") != "unresolved"), "constructor").otherwise(F.col("kind"))
    calls = space.put(
        shaped.join(found, ["owner", "simple", "arity"]).join(sites.select("site", "src"), "site").select("src", F.col("target").alias("dst"), kind.alias("kind")).distinct()
    )
    # x.start() on something that has a run(): the caller starts its thread
    runs = methods.where("simple = 'run' and n_params = 0").select("owner", F.col("fqn").alias("dst"))
    starts = shaped.where("simple = 'start' and arity = 0").join(runs, "owner").join(sites.select("site", "src"), "site").select("src", "dst").distinct()
    # Class.forName("a.b.C"): the literal's class, by its constructors
    literal = sites.where("name = 'forName' and scope = 'Class' and text is not null").select("src", F.regexp_replace("text", '^"|"$', "").alias("owner"))
    reflects = literal.join(methods.where("simple = '<init>'").select("owner", "fqn"), "owner", "left").select("src", F.coalesce("fqn", F.concat("owner", F.lit(".<init>(?)"))).alias("dst")).distinct()
    tables = {
        "classes": classes.drop("types", "interfaces"), "methods": methods, "fields": fields,
        "extends": edges.where("how = 'extends'").select("child", "parent"), "implements": edges.where("how = 'implements'").select("child", "parent"),
        "contains": classes.select(F.col("pkg").alias("src"), F.col("fqn").alias("dst")).unionByName(methods.select(F.col("owner").alias("src"), F.col("fqn").alias("dst"))).unionByName(fields.select(F.col("owner").alias("src"), F.col("fqn").alias("dst"))).distinct(),
        "calls": calls, "accesses": accesses, "starts_thread": starts, "reflects": reflects,
        "servlets": edges.where("how = 'extends'").where(names.simple_name(F.col("parent")).endswith("Servlet")).select(F.col("child").alias("class_fqn"), F.concat(F.lit("servlet:"), "child").alias("url")),
        "corrupt": r.where("kind = 'corrupt'").select("repo_id", "path"),
    }
    for d in detectors:
        tables |= d.per_file(r)
    for d in detectors:
        tables |= d.after_all(tables)
    return tables


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, n) of all tables."""
    out = None
    for name in sorted(tables):
        one = tables[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out
