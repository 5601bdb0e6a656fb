"""The two token-budget rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.functions.ordered import running_sum, with_carried


def budget_prefix(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: int, bucket: Column, descending: bool = False) -> DataFrame:
    """Rows in order until the first that does not fit (costs are never negative)."""
    out = with_carried(df, keys, order, [running_sum("used", F.col(cost))], bucket, descending)
    return out.filter(F.col("used") <= budget)


def budget_skip(df: DataFrame, keys: list[str], rank: str, cost: str, budget: int) -> DataFrame:
    """Greedy fill in rank order; a row that does not fit is skipped and later smaller ones may fit.

    Once a row of some cost is skipped every later row of that cost is too, so
    only the first budget/cost rows of each whole cost can matter.  That exact
    cut bounds the list each group folds by the budget, not by the data.
    """
    fits = df.filter((F.col(cost) > 0) & (F.col(cost) <= budget))
    w = W.partitionBy(*keys, cost).orderBy(rank)
    few = fits.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= budget).filter(F.col("__n") * F.col(cost) <= budget)
    item = F.struct(F.col(rank).alias("r"), F.col(cost).cast("bigint").alias("c"))
    rank_type = dict(df.dtypes)[rank]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{rank_type}>").alias("taken"))

    def step(acc, x):
        fit = acc["used"] + x["c"] <= budget
        return F.struct(
            F.when(fit, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"),
            F.when(fit, F.concat(acc["taken"], F.array(x["r"]))).otherwise(acc["taken"]).alias("taken"),
        )

    folded = few.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step).alias("f"))
    taken = folded.select(*keys, F.explode("f.taken").alias(rank))
    free = df.filter(F.col(cost) <= 0)
    return df.join(taken, [*keys, rank], "left_semi").unionByName(free)
