"""Per-key results over skewed keys by value-frequency compression.

Rows are grouped by (key, value) before they are grouped by key. The first shuffle spreads a hot key over all
partitions by its values and is pre-aggregated on the map side; the second one moves a row per key and partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE, WEIGHT = "__value", "__weight"


def compress(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, value) with the number of rows of each, null keys and values being values of their own."""
    return (
        df.select(*[F.col(f"`{k}`") for k in keys], value.alias(VALUE))
        .groupBy(*[f"`{k}`" for k in keys], VALUE)
        .agg(F.count(F.lit(1)).alias(WEIGHT))
    )


def profile(df: DataFrame, keys: Sequence[str], value: Column, prefix: str = "value") -> DataFrame:
    """Of each key: n_rows, n_{prefix}s (distinct, not null), top_{prefix} and top_{prefix}_rows (the mode).

    Ties of the mode go to the least value. A key all of whose values are null has 0 values and a null mode.
    Keys that are null form their own key. An empty table gives no rows.
    """
    by_value = compress(df, keys, value)
    some = F.col(VALUE).isNotNull()
    rank = F.when(some, F.struct(-F.col(WEIGHT), F.col(VALUE)))
    return by_value.groupBy(*[f"`{k}`" for k in keys]).agg(
        F.sum(WEIGHT).alias("n_rows"),
        F.count(VALUE).alias(f"n_{prefix}s"),
        F.min_by(VALUE, rank).alias(f"top_{prefix}"),
        F.max(F.when(some, F.col(WEIGHT))).alias(f"top_{prefix}_rows"),
    )


def percentiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float], bits: int = 64, digit: int = 16
) -> DataFrame:
    """Exact discrete percentiles of an integer value per key: the least value with a share of at least p up to it.

    The value is found digit by digit, `digit` bits at a time from the highest of `bits`: a round sums the weights by
    (key, digit) and keeps the digit that holds the wanted rank. No task ever sorts more than 2**digit sums of a key,
    however many distinct values the key has. With bits < 64 the values must lie in [0, 2**bits).
    Null values don't count; keys without a value don't come out.
    """
    ks = [F.col(f"`{k}`") for k in keys]
    flip = F.lit(-(1 << 63)) if bits == 64 else F.lit(0)
    pairs = (
        compress(df.where(value.isNotNull()), keys, value.cast("long"))
        .withColumn(VALUE, F.col(VALUE).bitwiseXOR(flip))
    )
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()]))
    wanted = (
        pairs.groupBy(*ks).agg(F.sum(WEIGHT).alias("__total")).select(*ks, "__total", named.alias("__q"))
        .select(
            *ks, F.col("__q.name").alias("__name"), F.lit(0).cast("long").alias("__head"),
            F.greatest(F.lit(1), F.ceil(F.col("__total") * F.col("__q.p"))).cast("long").alias("__rank"),
        )
    )
    for shift in range(bits - digit, -1, -digit):
        head = F.lit(0).cast("long") if shift + digit >= bits else F.shiftrightunsigned(VALUE, shift + digit)
        here = F.shiftrightunsigned(VALUE, shift).bitwiseAND((1 << digit) - 1)
        sums = (
            pairs.groupBy(*ks, head.alias("__head"), here.alias("__digit")).agg(F.sum(WEIGHT).alias("__n"))
        )
        w, s = wanted.alias("w"), sums.alias("s")
        same = F.col("w.__head") == F.col("s.__head")
        for k in keys:
            same = same & F.col(f"w.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
        joined = w.join(s, same).select(*[F.col(f"w.`{k}`").alias(k) for k in keys], "w.__name", "w.__head", "w.__rank", "s.__digit", "s.__n")
        upto = Window.partitionBy(*ks, "__name").orderBy("__digit").rowsBetween(Window.unboundedPreceding, 0)
        wanted = (
            joined.withColumn("__upto", F.sum("__n").over(upto))
            .where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("__n") < F.col("__rank")))
            .select(
                *ks, "__name", (F.shiftleft("__head", digit) + F.col("__digit")).alias("__head"),
                (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"),
            )
        )
    result = F.col("__head").bitwiseXOR(flip)
    return wanted.groupBy(*ks).agg(*[F.max(F.when(F.col("__name") == n, result)).alias(n) for n in probs])


def heavy_hitters(df: DataFrame, keys: Sequence[str], value: Column, share: float) -> DataFrame:
    """The keys without a null that hold at least `share` of all rows of `df`, with n_rows; at most 1/share of them.

    Rows with null keys and repeated rows count in the total.
    """
    per_key = compress(df, keys, value).groupBy(*[f"`{k}`" for k in keys]).agg(F.sum(WEIGHT).alias("n_rows"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))  # from the footers of Parquet files
    present = F.lit(True)
    for k in keys:
        present = present & F.col(f"`{k}`").isNotNull()
    # one row: the total
    return (
        per_key.where(present).join(F.broadcast(total), F.col("n_rows") >= F.col("__all") * F.lit(Decimal(str(share))))
        .select(*[F.col(f"`{k}`") for k in keys], "n_rows")
    )
