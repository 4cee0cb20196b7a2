"""Upserts and deletions of node and edge tables, as new tables from old ones.

`ord` columns give the order of rows within a batch; where a batch has none, equal keys are settled by value. Keys with
nulls are rows of their own and never merge, like in a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rest(df: DataFrame, keys: Sequence[str], *without: str) -> list[str]:
    return [c for c in df.columns if c not in keys and c not in without]


def last_row(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row a key: the greatest by `order`, further ties by the other columns; nulls come first."""
    rest = _rest(df, keys, *order)
    top = F.max(F.struct(*order, *rest)).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def merge_set(existing: DataFrame, batch: DataFrame, keys: Sequence[str], ord: str) -> DataFrame:
    """Insert or overwrite: of each key the last row of the batch, else the existing row (all its columns)."""
    columns = existing.columns
    both = existing.withColumn("__prio", F.lit(0)).withColumn("__ord", F.lit(0).cast("long")).unionByName(
        batch.select(*columns, F.lit(1).alias("__prio"), F.col(ord).cast("long").alias("__ord"))
    )
    return last_row(both, keys, "__prio", "__ord").select(*columns)


def merge_create(existing: DataFrame, batch: DataFrame, keys: Sequence[str], ord: str) -> DataFrame:
    """Insert only: the first row of the batch for keys that don't exist yet; existing rows stay as they are."""
    columns = existing.columns
    rest = _rest(existing, keys)
    new = batch.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest) if rest else F.lit(1), F.struct(F.col(ord), *rest)).alias("__row"))
    return existing.unionByName(first.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*columns))


def merge_coalesce(existing: DataFrame, batch: DataFrame, keys: Sequence[str], prefer_new: Sequence[str] = ()) -> DataFrame:
    """Fill up: existing values stay unless null; columns of prefer_new take the batch's value unless null.

    Both sides have one row a key.
    """
    e, b = existing.alias("e"), batch.alias("b")
    value = lambda c: F.coalesce(*([F.col(f"b.{c}"), F.col(f"e.{c}")] if c in prefer_new else [F.col(f"e.{c}"), F.col(f"b.{c}")])).alias(c)
    on = [F.col(f"e.{k}") == F.col(f"b.{k}") for k in keys]
    return e.join(b, on, "full_outer").select(*[F.coalesce(F.col(f"e.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[value(c) for c in _rest(existing, keys)])


def merge_edges(existing: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct edges by endpoints and key properties."""
    return existing.select(*key).unionByName(batch.select(*key)).distinct()


def resolve_or_fallback(claims: DataFrame, methods: DataFrame) -> DataFrame:
    """(level, source, url) of claims (owner, simple, url): the least method of that owner and name, else the class."""
    known = methods.groupBy(F.col("owner").alias("owner"), F.col("simple").alias("simple")).agg(F.min("fqn").alias("fqn"))
    return claims.join(known, ["owner", "simple"], "left").select(
        F.when(F.col("fqn").isNull(), "class").otherwise("method").alias("level"), F.coalesce("fqn", "owner").alias("source"), "url"
    ).distinct()


def link_by_prefix(uses: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(user, url): an endpoint equal to what is used, or the same followed by a query; an equi-join on the part before `?`."""
    return uses.join(endpoints.withColumn("__base", F.substring_index("url", "?", 1)), F.col("used") == F.col("__base")).select("user", "url").distinct()


def endpoint_required(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    return edges.join(sources.select(F.col("key").alias("src")).distinct(), "src", "left_semi").join(targets.select(F.col("key").alias("dst")).distinct(), "dst", "left_semi")


def endpoint_creating(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Nodes (key) with those that the edges name on one side and that don't exist yet."""
    return nodes.select("key").unionByName(edges.select(F.col(side).alias("key"))).where("key is not null").distinct()


def add_labels(nodes: DataFrame, key: str, labels: str, extra: DataFrame) -> DataFrame:
    """Nodes with their labels united with extra(key, label); labels that are no identifiers are left out."""
    clean = extra.where(F.col("label").rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")).groupBy(key).agg(F.collect_set("label").alias("__new"))
    none = F.array().cast("array<string>")
    joined = nodes.join(clean, key, "left")
    return joined.withColumn(labels, F.array_sort(F.array_union(F.coalesce(labels, none), F.coalesce("__new", none)))).drop("__new")


def rekey_unique(edges: DataFrame, constants: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Edges to numeric ids moved to the constant of that value, if exactly one stands for it.

    edges: src, dst; constants: owner, name, value. Owners that end with one of the preferred suffixes are asked first,
    then those that end with Constants. The new target is owner.name.
    """
    numeric = F.col("dst").rlike(r"^-?[0-9]+L?$")
    tier = F.when(F.greatest(*[F.col("owner").endswith(s) for s in [*preferred, *preferred]]), 1).when(F.col("owner").endswith("Constants"), 2)
    named = constants.select(F.col("value").alias("dst"), F.concat_ws(".", "owner", "name").alias("target"), tier.alias("tier")).where("tier is not null")
    by_tier = named.groupBy("dst", "tier").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target"))
    chosen = by_tier.groupBy("dst").agg(F.min_by(F.struct("n", "target"), "tier").alias("c")).where("c.n = 1").select("dst", F.col("c.target").alias("target"))
    moved = edges.join(chosen, "dst", "left").select("src", F.when(numeric, F.coalesce("target", "dst")).otherwise(F.col("dst")).alias("dst"))
    return moved.distinct()


def delete_nodes(nodes: DataFrame, edges: DataFrame, key: str, doomed: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes without the doomed ones, and edges without those at either end of them."""
    gone = nodes.where(doomed).select(F.col(key).alias("k")).distinct()
    kept = edges.join(gone.withColumnRenamed("k", "src"), "src", "left_anti").join(gone.withColumnRenamed("k", "dst"), "dst", "left_anti")
    return nodes.where(~F.coalesce(doomed, F.lit(False))), kept.select(*edges.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that stand on more than one row, with n_rows: what a uniqueness constraint would refuse."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def expand_rules(rules: DataFrame, methods: DataFrame) -> DataFrame:
    """Rules (ord, test_id, op, kind, key) with METHOD keys without parameters replaced by all overloads among methods (fqn).

    The overloads keep the rule's ord. Keys without an overload, and rules of other kinds, stay as they are.
    """
    bare = F.when((F.col("kind") == "METHOD") & ~F.col("key").contains("("), F.col("key"))
    overloads = methods.where(F.col("fqn").contains("(")).select(F.substring_index("fqn", "(", 1).alias("__bare"), "fqn").distinct()
    joined = rules.withColumn("__bare", bare).join(overloads, "__bare", "left")
    return joined.withColumn("key", F.coalesce("fqn", "key")).select(*rules.columns)


def apply_rules(covers: DataFrame, rules: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Covers (test_id, kind, key, confidence) after rules (ord, test_id, op, kind, key), the last rule of a key winning.

    add gives confidence 1.0, remove takes the row away; rules of other ops are ignored. With methods (fqn), METHOD
    rules without parameters hold for all overloads.
    """
    keys = ["test_id", "kind", "key"]
    if methods is not None:
        rules = expand_rules(rules, methods)
    last = rules.where(F.col("op").isin("add", "remove")).groupBy(*keys).agg(F.max_by("op", "ord").alias("op"))
    c = covers.groupBy(*keys).agg(F.max("confidence").alias("confidence"))
    joined = c.join(last, keys, "full_outer")
    return joined.where(F.col("op").isNull() | (F.col("op") == "add")).select(*keys, F.when(F.col("op") == "add", 1.0).otherwise(F.col("confidence")).alias("confidence"))


def covers_edges(cases: DataFrame, claims: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """(test_id, kind, key, confidence): claims whose node exists, and one SUITE row for each case with a suite.

    cases: test_id, suite; claims: test_id, kind, key, confidence; nodes: by kind a table with key. Claims of other
    kinds, of unknown nodes and of unknown cases give nothing; of equal claims the greatest confidence counts.
    """
    own = claims.join(cases.select("test_id").distinct(), "test_id", "left_semi").groupBy("test_id", "kind", "key").agg(F.max("confidence").alias("confidence"))
    out = cases.where("suite <> ''").select("test_id", F.lit("SUITE").alias("kind"), F.col("suite").alias("key"), F.lit(1.0).alias("confidence")).distinct()
    for kind, known in nodes.items():
        out = out.unionByName(own.where(F.col("kind") == kind).join(known.select("key").distinct(), "key", "left_semi").select("test_id", "kind", "key", "confidence"))
    return out
