"""Changes between consecutive full snapshots.

All pairs of neighbouring snapshots are compared at once: each row stands once as itself (+1) and once, moved to the
next snapshot, as its predecessor (-1). Rows equal on both sides cancel in one aggregate, which is EXCEPT ALL in both
directions for a single shuffle; a full join of the two residues by key then labels what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.session import Workspace


def except_all_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """left EXCEPT ALL right (side +1) and right EXCEPT ALL left (side -1), with the multiplicity in `__n`.

    Nulls equal nulls. Both inputs need the same columns.
    """
    columns = left.columns
    signed = left.withColumn("__n", F.lit(1)).unionByName(right.select(*columns).withColumn("__n", F.lit(-1)))
    return (
        signed.groupBy(*columns).agg(F.sum("__n").alias("__n")).where(F.col("__n") != 0)
        .withColumn("__side", F.signum("__n").cast("int")).withColumn("__n", F.abs("__n"))
    )


def previous_in_order(df: DataFrame, group: str, order: str, name: str, slot: Column) -> DataFrame:
    """The `name` of the row before in the group, by `order`; null for the first.

    A hot group isn't sorted in one task: the row before is looked for within (group, slot), slot growing with order;
    the first row of a slot takes the last of the nearest earlier slot, found over one row a slot.
    """
    slotted = df.withColumn("__slot", slot)
    within = Window.partitionBy(group, "__slot").orderBy(order, name)
    near = slotted.withColumn("__before", F.lag(name).over(within)).withColumn("__nth", F.row_number().over(within))
    ends = slotted.groupBy(group, "__slot").agg(F.max_by(name, F.struct(order, name)).alias("__last"))
    across = ends.withColumn("__carried", F.lag("__last").over(Window.partitionBy(group).orderBy("__slot"))).drop("__last")
    return (
        near.join(across, [group, "__slot"])
        .withColumn("previous", F.when(F.col("__nth") == 1, F.col("__carried")).otherwise(F.col("__before")))
        .select(*df.columns, "previous")
    )


def latest_rows(df: DataFrame, keys: Sequence[str], value: str, at: str) -> DataFrame:
    """One row a key: the value of the latest `at` (a null time is the earliest; equal times: the largest value)."""
    newest = F.struct(F.col(at).isNotNull(), F.col(at), F.col(value).isNotNull(), F.col(value))
    return df.groupBy(*keys).agg(F.max(newest)[value].alias(value))


def snapshot_changes(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, commit_sha, path, change) of every snapshot against the one before it in its repository.

    files: repo_id, commit_sha, path, content_hash, recorded_at; commits: repo_id, commit_sha, committed_at; other
    columns are ignored. Paths are compared with `/` for `\\` and without a leading `./`, hashes without letter case.
    Rows with a null repo_id, commit_sha or path, commits without such rows and file rows of unknown commits are left
    out; a null hash on either side gives no change, a path that comes or goes is a case whatever its hash. The first
    snapshot of a repository gives nothing. Rows delivered twice count once, corrected rows as in latest_rows.
    """
    spark = files.sparkSession
    space = Workspace(spark)
    path = F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")
    current = space.put(
        latest_rows(
            files.where(F.col("path").isNotNull() & F.col("repo_id").isNotNull() & F.col("commit_sha").isNotNull())
            .select("repo_id", "commit_sha", path.alias("path"), F.lower("content_hash").alias("content_hash"), "recorded_at"),
            ["repo_id", "commit_sha", "path"], "content_hash", "recorded_at",
        )
    )
    present = current.select("repo_id", "commit_sha").distinct()
    dated = (
        commits.where(F.col("committed_at").isNotNull()).groupBy("repo_id", "commit_sha")
        .agg(F.max("committed_at").alias("committed_at"))
        .join(present, ["repo_id", "commit_sha"], "left_semi")
    )
    ordered = space.put(previous_in_order(dated, "repo_id", "committed_at", "commit_sha", F.date_trunc("quarter", "committed_at")))
    later = ordered.where(F.col("previous").isNotNull())
    here = current.join(later.select("repo_id", "commit_sha"), ["repo_id", "commit_sha"], "left_semi")
    before = current.withColumnRenamed("commit_sha", "previous").join(
        later.select("repo_id", "commit_sha", "previous"), ["repo_id", "previous"]
    )
    columns = ["repo_id", "commit_sha", "path", "content_hash"]
    residue = space.put(except_all_both(here.select(*columns), before.select(*columns)))
    key = ["repo_id", "commit_sha", "path"]
    new = residue.where(F.col("__side") == 1).select(*key, F.col("content_hash").alias("__new"), F.lit(True).alias("__is"))
    old = residue.where(F.col("__side") == -1).select(*key, F.col("content_hash").alias("__old"), F.lit(True).alias("__was"))
    change = (
        F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed")
        .when(F.col("__new") != F.col("__old"), "changed")
    )
    return (
        new.join(old, key, "full_outer").select(*key, change.alias("change")).where(F.col("change").isNotNull())
    )
