"""Mixing sources to target weights by temperature, under a limit on repetition.

A source's weight in the mix is its share of the tokens times (target / share) ** a. At a = 1 that is the target, at
a = 0 the corpus as it is, which repeats nothing; a is bisected to the largest at which no source needs more tokens
than it may repeat. Where that is below 1, the sources that cannot reach their targets give all they may, and a is
bisected again over the others against the tokens left, until the others are at a = 1: they keep the proportions of
their targets. The weights become budgets of tokens, and the budgets whole passes over a source plus a partial pass
over blocks of documents in a random order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakegraph.session import Workspace

DOCS_PER_BLOCK = 1000
BLOCK_BITS = 10  # a block is cut into 1,024 smaller ones, as often as the largest source asks for
DRAW_BITS = 60
BISECTIONS = 60


def clean_source(column: str = "source"):
    return F.lower(F.trim(F.regexp_replace(column, r"^\s+|\s+$", "")))


def weights_at(tokens: np.ndarray, target: np.ndarray, a: float) -> np.ndarray:
    """Normalised share * (target / share) ** a; a source without tokens has none."""
    out = np.zeros(len(tokens))
    some = (tokens > 0) & (target > 0)
    share = tokens[some] / tokens.sum()
    out[some] = share * (target[some] / share) ** a
    return out / out.sum() if out.sum() else out


def _fits(weight: np.ndarray, size: float, cap: np.ndarray) -> np.ndarray:
    return weight * size <= cap * (1 + 1e-12) + 1e-9


def bisect_exponent(tokens: np.ndarray, target: np.ndarray, limit: np.ndarray, size: float | None = None) -> float:
    """The largest a in [0, 1] at which weight * size <= tokens * limit for every source that has tokens.

    size: tokens of the mix, all that the sources have where it is not given.
    """
    size = tokens.sum() if size is None else size

    def fits(a: float) -> bool:
        return bool(np.all(_fits(weights_at(tokens, target, a), size, tokens * limit)))

    if not size or fits(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def fill(tokens: np.ndarray, target: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exponent, tokens planned) of each source for a mix of as many tokens as the sources have.

    In each round the exponent of the open sources is bisected against the tokens left. If it comes out below 1, those
    that would break their limit at 1 are planned with all they may give and closed, with the exponent of that round
    (0 where nothing may be taken); what they leave falls to the others, in proportion to their targets.
    """
    cap, size = tokens * limit, float(tokens.sum())
    planned, exponent = np.zeros(len(tokens)), np.where(target > 0, 0.0, 1.0)
    open_ = (cap > 0) & (target > 0)
    while open_.any():
        left = size - planned.sum()
        a = bisect_exponent(tokens[open_], target[open_], limit[open_], left)
        share = np.where(open_, target, 0.0) / target[open_].sum()
        over = open_ & ~_fits(share, left, cap)
        if a == 1.0 or not over.any():
            planned[open_], exponent[open_] = share[open_] * left, 1.0
            break
        planned[over], exponent[over] = cap[over], a
        open_ &= ~over
    return exponent, np.minimum(planned, cap)


def mixture_plan(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a row of targets(mix_id, source, target_share, max_repeats), with what its source has and will give.

    counted: source, n_tokens. Sources are compared in lower case without surrounding blanks; documents of a null
    source belong to no mix, and several target rows of one source and mix are planned each by itself. Columns: tokens
    (of the source), total (of all sources of the mix), wanted (target_share * total), short (the source can't reach
    its target even at its most repeats), exponent, weight (planned share), budget (planned tokens). Null shares and
    repeats count as 0. A mix whose sources have no documents has total 0 and gives nothing.
    """
    per_source = counted.where("source is not null").groupBy(clean_source().alias("source")).agg(F.sum("n_tokens").alias("tokens"))
    named = targets.select(
        "mix_id", clean_source().alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(0)).cast("int").alias("max_repeats"),
    )
    rows = named.join(per_source, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)).cast("long"))

    def plan(mix: pd.DataFrame) -> pd.DataFrame:
        """A mix: as many rows as it has sources."""
        mix = mix.sort_values(["source", "target_share", "max_repeats"], ascending=[True, False, False], ignore_index=True)
        first = (~mix.duplicated("source")).to_numpy()
        total = int(mix.tokens[first].sum())
        target, limit, tokens = mix.target_share.to_numpy(float), mix.max_repeats.to_numpy(float), mix.tokens.to_numpy(float)
        exponent, planned = fill(np.where(first, tokens, 0.0), np.where(first, target, 0.0), np.maximum(limit, 0.0))
        wanted = target * total
        return mix.assign(
            total=total, wanted=wanted, short=tokens * limit < wanted, exponent=exponent, weight=planned / planned.sum() if planned.sum() else 0.0,
            budget=np.floor(planned + 1e-6).astype("int64"),
        )[["mix_id", "source", "target_share", "max_repeats", "tokens", "total", "wanted", "short", "exponent", "weight", "budget"]]

    return rows.groupBy("mix_id").applyInPandas(
        plan,
        "mix_id string, source string, target_share double, max_repeats int, tokens long, total long, wanted double,"
        " short boolean, exponent double, weight double, budget long",
    )


def mixture(counted: DataFrame, targets: DataFrame, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mixtures and the report of what they reached.

    The first result has mix_id, source, doc_id, n_tokens, copies: budget // tokens whole passes for every document,
    and one copy more for those that the partial pass takes. The partial pass goes through a source's blocks of
    documents in random order, and through the documents of the block in which the budget ends, as far as the budget
    reaches; the order depends on seed, mix and doc_id alone. Blocks are nested, each level 1,024 to a block, until
    one has about DOCS_PER_BLOCK documents, so that no task orders a whole source or all of its blocks. Documents of 0
    tokens have the copies of the whole passes. The second result is mixture_plan with actual_tokens and actual_share.
    Rows of equal doc_id are kept apart by n_tokens only in order.
    """
    space = Workspace(counted.sparkSession)
    docs = space.put(counted.where("source is not null").select("doc_id", clean_source().alias("source"), "n_tokens"))
    plan = space.put(mixture_plan(docs, targets))
    largest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = 0
    while levels < DRAW_BITS // BLOCK_BITS and largest > DOCS_PER_BLOCK << (levels * BLOCK_BITS):
        levels += 1
    active = plan.where("budget > 0 and tokens > 0").select(
        "mix_id", "source", F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("passes"), (F.col("budget") % F.col("tokens")).alias("rest"),
    )
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "doc_id"), 64 - DRAW_BITS)
    key = ["mix_id", "source"]
    # plan rows: as many as the targets have
    cut = active.withColumn("block", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long"))
    for level in range(levels):
        shift = DRAW_BITS - level * BLOCK_BITS
        inside = docs.join(cut, "source").withColumn("draw", draw).where(F.shiftright("draw", shift) == F.col("block"))
        sums = inside.groupBy(*key, "passes", "rest", "before", F.shiftright("draw", shift - BLOCK_BITS).alias("block")).agg(F.sum("n_tokens").alias("size"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, 0))  # 1,024 rows at most
        ended = sums.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
        cut = space.put(ended.select(*key, "passes", "rest", "block", (F.col("upto") - F.col("size")).alias("before")))
    own = F.shiftright("draw", DRAW_BITS - levels * BLOCK_BITS)
    placed = docs.join(cut, "source").withColumn("draw", draw)
    order = Window.partitionBy(*key).orderBy("draw", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(own == F.col("block")).withColumn("upto", F.col("before") + F.sum("n_tokens").over(order))
    last = last.withColumn("extra", ((F.col("upto") <= F.col("rest")) & (F.col("n_tokens") > 0)).cast("int")).drop("upto")
    others = placed.where(own != F.col("block")).withColumn("extra", ((own < F.col("block")) & (F.col("n_tokens") > 0)).cast("int"))
    chosen = space.put(
        last.unionByName(others).withColumn("copies", F.col("passes") + F.col("extra")).where("copies > 0").select("mix_id", "source", "doc_id", "n_tokens", "copies")
    )
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"))
    all_tokens = Window.partitionBy("mix_id")
    report = (
        plan.join(reached, ["mix_id", "source"], "left").withColumn("actual_tokens", F.when(F.col("budget") > 0, F.coalesce("actual_tokens", F.lit(0))).otherwise(0).cast("long"))
        .withColumn("actual_share", F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(all_tokens)))
    )
    return chosen, report
