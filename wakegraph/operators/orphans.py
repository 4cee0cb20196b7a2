"""References to records that do not exist, found with bitmaps per key range and period.

Keys are dictionary-encoded as integers. For each range of 32,768 keys and each month there is one bitmap of the keys
referenced in it and one of the keys whose parent holds through the whole month. Reference AND-NOT parent leaves the
keys with possible orphans; their surviving bits are decoded, and only the references of those (key, month) cells are
compared with the times of their parents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.session import Workspace

RANGE_BITS = 15  # a bitmap of bitmap_construct_agg has 32,768 bits
REFS_PER_SLICE = 200_000  # references of one (key, month) cell that one task compares with its parents' times


def month_of(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def month_start(month: Column) -> Column:
    return F.make_timestamp_ntz(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def month_text(month: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"))


def surviving_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, month, refs, full) bitmaps to (key_id, month) of the bits in refs AND NOT full."""
    for batch in batches:
        ranges, months = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        refs, full = batch.column(2), batch.column(3)
        for start in range(0, batch.num_rows, 128):  # unpacked bits take 32 KB a row
            rows = range(start, min(start + 128, batch.num_rows))
            left = np.stack([np.frombuffer(refs[i].as_py(), np.uint8) for i in rows])
            for at, i in enumerate(rows):
                if full[i].is_valid:
                    left[at] &= ~np.frombuffer(full[i].as_py(), np.uint8)
            row, bit = np.nonzero(np.unpackbits(left, axis=1, bitorder="little"))
            row += start
            yield pa.RecordBatch.from_arrays(
                [pa.array((ranges[row] << RANGE_BITS) + bit, pa.int64()), pa.array(months[row], pa.int32())],
                names=["key_id", "month"],
            )


def digest(key: Column) -> Column:
    """What keys are compared by: 128 bits, a fifth of a long name, of which no two names are taken to have the same."""
    return F.unhex(F.md5(key.cast("string")))


def _bitmap(df: DataFrame) -> DataFrame:
    return df.groupBy(F.shiftright("key_id", RANGE_BITS).alias("range"), "month").agg(
        F.bitmap_construct_agg(F.col("key_id").bitwiseAND((1 << RANGE_BITS) - 1)).alias("bits")
    )


def orphan_references(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references for which no parent row of their key holds at their time.

    references: ref_id (unique with endpoint), endpoint, key, at; parents: key, since, until. A parent row holds at t
    if since <= t and (until is null or t < until). Other columns are ignored. References with a null key are no
    references; one with a null time finds no parent and is an orphan. Parents with a null key or a null since never
    hold; parents with until <= since hold at no time. Repeated parent rows count once, repeated references each.
    Result: ref_id, endpoint, key (its digest), at, month (null for a null time).
    """
    space = Workspace(references.sparkSession)
    refs = references.where(F.col("key").isNotNull()).select("ref_id", "endpoint", digest(F.col("key")).alias("key"), "at", month_of(F.col("at")).alias("month"))
    dated = refs.where(F.col("at").isNotNull())
    spans = space.put(
        parents.where(F.col("key").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("since") < F.col("until"))))
        .select(digest(F.col("key")).alias("key"), "since", "until").distinct()
    )
    # one row a cell (key, month); a hot key is summed on the map side
    cells = space.put(dated.groupBy("key", "month").agg(F.count(F.lit(1)).alias("n_refs")))
    # ids must not change when a task runs again, so they are written before use
    keys = space.put(cells.select("key").union(spans.select("key")).distinct().select("key", F.monotonically_increasing_id().alias("key_id")))
    referenced = _bitmap(cells.join(keys, "key").select("key_id", "month"))

    bounds = cells.agg(F.min("month").alias("first"), F.max("month").alias("last"))  # one row
    first_full = month_of(F.col("since")) + F.when(F.col("since") > month_start(month_of(F.col("since"))), 1).otherwise(0)
    covered = (
        spans.join(keys, "key").crossJoin(F.broadcast(bounds))  # a single row beside each
        .select(
            "key_id", F.greatest(first_full, F.col("first")).alias("a"),
            F.least(F.coalesce(month_of(F.col("until")) - 1, F.col("last")), F.col("last")).alias("b"),
        )
        .where(F.col("a") <= F.col("b")).select("key_id", F.explode(F.sequence("a", "b")).alias("month"))
    )
    survivors = (
        referenced.withColumnRenamed("bits", "refs").join(_bitmap(covered).withColumnRenamed("bits", "full"), ["range", "month"], "left")
        .select("range", "month", "refs", "full").mapInArrow(surviving_bits, "key_id long, month int")
    )
    suspects = space.put(survivors.join(keys, "key_id").select("key", "month").join(cells, ["key", "month"]))

    # parents that begin or end within a suspect cell: changes of the number that holds
    low, high = month_start(F.col("month")), month_start(F.col("month") + 1)
    within = suspects.select("key", "month", F.ceil(F.col("n_refs") / REFS_PER_SLICE).cast("int").alias("slices")).join(spans, "key").where(
        (F.col("since") < high) & (F.col("until").isNull() | (F.col("until") > low))
    )
    steps = space.put(
        within.select("key", "month", "slices", F.explode(F.array(
            F.struct(F.greatest("since", low).alias("at"), F.lit(1).alias("step")),
            F.struct(F.col("until").alias("at"), F.lit(-1).alias("step")),
        )).alias("e"))
        .where(F.col("e.at").isNotNull() & (F.col("e.at") < high))
        .groupBy("key", "month", F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"), F.max("slices").alias("slices"))
        .where(F.col("step") != 0)
    )
    touched = steps.groupBy("key", "month").agg(F.max("slices").alias("slices"))
    marked = suspects.select("key", "month").join(touched, ["key", "month"], "left")
    open_refs = space.put(dated.join(marked, ["key", "month"]))
    certain = open_refs.where(F.col("slices").isNull()).drop("slices")

    sliced = open_refs.where(F.col("slices").isNotNull()).select(
        "key", "month", F.pmod(F.xxhash64("ref_id", "endpoint"), F.col("slices")).cast("int").alias("slice"),
        "at", F.lit(1).alias("is_ref"), F.lit(0).cast("long").alias("step"), "ref_id", "endpoint",
    )
    stepped = steps.select(
        "key", "month", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "at", F.lit(0).alias("is_ref"), F.col("step").cast("long").alias("step"),
        F.lit(None).cast(dated.schema["ref_id"].dataType).alias("ref_id"), F.lit(None).cast("string").alias("endpoint"),
    )
    so_far = Window.partitionBy("key", "month", "slice").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    compared = (
        sliced.unionByName(stepped).withColumn("holding", F.sum("step").over(so_far))
        .where((F.col("is_ref") == 1) & (F.col("holding") <= 0))
    )
    columns = ["ref_id", "endpoint", "key", "at", "month"]
    return certain.select(*columns).unionByName(compared.select(*columns)).unionByName(refs.where(F.col("at").isNull()).select(*columns))


def call_ends(edges: DataFrame) -> DataFrame:
    """Both ends of each call edge as references: ref_id, endpoint, key, at."""
    ends = F.array(
        F.struct(F.lit("from").alias("endpoint"), F.col("from_method_fqn").alias("key")),
        F.struct(F.lit("to").alias("endpoint"), F.col("to_method_fqn").alias("key")),
    )
    return edges.select(F.col("edge_id").alias("ref_id"), F.explode(ends).alias("e"), F.col("recorded_at").alias("at")).select(
        "ref_id", "e.endpoint", "e.key", "at"
    )


def call_orphans(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Orphan ends of call edges against the validity of method rows; see orphan_references."""
    return orphan_references(
        call_ends(edges), methods.select(F.col("fqn").alias("key"), F.col("recorded_at").alias("since"), F.col("removed_at").alias("until"))
    )


def orphan_report(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Per table end and month: n_refs, n_orphans and why: n_unknown (no parent row at any time), n_later (recorded
    after the reference), n_removed (the parents before it had all ended)."""
    known = methods.where(F.col("fqn").isNotNull() & F.col("recorded_at").isNotNull()).groupBy(digest(F.col("fqn")).alias("key")).agg(F.min("recorded_at").alias("born"))
    orphans = call_orphans(edges, methods).join(known, "key", "left")
    counted = orphans.groupBy("endpoint", "month").agg(
        F.count(F.lit(1)).alias("n_orphans"),
        F.count_if(F.col("born").isNull()).alias("n_unknown"),
        F.count_if(F.col("born") > F.col("at")).alias("n_later"),
        F.count_if(F.col("born") <= F.col("at")).alias("n_removed"),
    )
    refs = call_ends(edges).where(F.col("key").isNotNull()).groupBy("endpoint", month_of(F.col("at")).alias("month")).agg(F.count(F.lit(1)).alias("n_refs"))
    joined = refs.alias("r").join(counted.alias("o"), (F.col("r.endpoint") == F.col("o.endpoint")) & F.col("r.month").eqNullSafe(F.col("o.month")), "left")
    zero = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit(0)).cast("long").alias(c)
    return joined.select("r.endpoint", month_text(F.col("r.month")).alias("month"), "r.n_refs", *[zero(c) for c in ("n_orphans", "n_unknown", "n_later", "n_removed")])
