"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.session import work_path

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later uses neither recompute it nor depend
    on one executor's disk, and the planner knows its size."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a table below the shared folder that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long) as (node, component), the smallest node.

    Alternating large-star and small-star steps.  Each step aggregates by node on the map side first and
    writes its edges, never more than it read, to the shared folder; no group is ever gathered.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # now is (u, v) with u > v; large-star: everything above a node goes to the least of the node and its neighbours
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        large = now.join(least, "v").select("u", F.col("m").alias("v")).distinct()
        # small-star: a node and everything below it goes to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = saved(small.distinct(), "edges")
        # a forest of stars: every node has one parent, and no parent has one
        parents = now.groupBy("u").agg(F.count("*").alias("n"))
        if parents.where("n > 1").isEmpty() and now.select("v").join(parents.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def finite_vector(v: Column) -> Column:
    """True for a vector that is not null, not zero and holds neither nulls nor non-finite components."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def in_blocks(rows: DataFrame, probes: DataFrame, keys: list[str], row_id: str, probe_id: str, row_block: int, probe_block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with block numbers ``rb`` and ``pb`` such that each row meets each probe of its ``keys`` in
    exactly one block, of about ``row_block`` rows and ``probe_block`` probes: a hot key becomes many tasks.
    """
    need = rows.groupBy(*keys).agg(F.ceil(F.count("*") / row_block).cast("int").alias("rbs"))
    have = probes.groupBy(*keys).agg(F.ceil(F.count("*") / probe_block).cast("int").alias("pbs"))
    grid = saved(need.join(have, keys), "grid")
    rows = rows.join(grid, keys).withColumn("rb", F.pmod(F.xxhash64(row_id), F.col("rbs")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("pbs") - 1)))
    probes = probes.join(grid, keys).withColumn("pb", F.pmod(F.xxhash64(probe_id), F.col("pbs")).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rbs") - 1)))
    # new names for columns, as both sides may come from one table
    fresh = lambda df: df.drop("rbs", "pbs").select(*[F.col(c).alias(c) for c in df.columns if c not in ("rbs", "pbs")])
    return fresh(rows), fresh(probes)


def first_k(df: DataFrame, key: str, order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows of each key, with their rank from 1; tasks cut their own rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)
