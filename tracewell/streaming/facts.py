"""Durable facts picked while sessions go on: a session is read again once enough new text has come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.operators.facts import FactRules, extract_facts
from tracewell.session import written

# --- fixed values: characters of new text that make a session due, and facts kept of a session ---
DUE_CHARS, MOST_FACTS = 24_000, 30
BATCH = "batch"


def capture_facts(
    blocks: DataFrame, checkpoint: str, sink: str, rules: FactRules = FactRules(), due_chars: int = DUE_CHARS, most: int = MOST_FACTS, **kw
) -> DataFrame:
    """Takes the ``blocks`` (a stream with the columns of ``extract_facts``) that are new and returns all facts so far:
    (session_id, nth, kind, text, seq, standing), ``nth`` counting a session's facts as they were found.

    The new blocks of a session wait until their text and results have ``due_chars`` characters; then they are
    searched once, with the commands that ran before, so that a command that had failed earlier is known.  A
    fact whose text the session already has is left out, and so is what exceeds ``most``.  What waits is below
    ``due_chars`` for each session; of what was searched only commands and failed results are kept.  Each
    batch writes folders of its own number and reads those before it, so repeating a batch changes nothing.
    """
    spark = blocks.sparkSession
    shape = blocks.schema
    fact = "session_id {}, nth long, kind string, text string, seq {}, standing boolean".format(*(shape[c].dataType.simpleString() for c in ("session_id", "seq")))

    def before(name: str, batch_id: int, schema) -> DataFrame:
        """Rows that the batches before this one wrote."""
        if not batch_id:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", f"{sink}/{name}").parquet(*[f"{sink}/{name}/{BATCH}={i}" for i in range(batch_id)])

    def take(batch: DataFrame, batch_id: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{sink}/{name}/{BATCH}={batch_id}")
        waiting = spark.read.schema(shape).parquet(f"{sink}/waiting/{BATCH}={batch_id - 1}") if batch_id else spark.createDataFrame([], shape)
        here = written(waiting.unionByName(batch), "waiting")
        size = F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("result"), F.lit(0))
        due = here.groupBy("session_id").agg(F.sum(size).alias("__chars")).where(F.col("__chars") >= due_chars).select("session_id")
        put(here.join(due, "session_id", "left_anti"), "waiting")
        fresh = here.join(due, "session_id", "left_semi")
        failed = F.coalesce(F.col("is_error"), F.lit(False)) | F.coalesce(F.col("result").rlike(rules.failed), F.lit(False))
        kept = ((F.col("block_type") == "tool_use") & (F.col("tool") == "Bash")) | ((F.col("block_type") == "tool_result") & failed)
        put(fresh.where(F.coalesce(kept, F.lit(False))), "commands")
        earlier = before("commands", batch_id, shape).join(due, "session_id", "left_semi")
        found = extract_facts(fresh.unionByName(earlier.select(*fresh.columns)), rules, **kw)
        known = before("facts", batch_id, fact).join(due, "session_id", "left_semi")
        new = found.join(known.select("session_id", "text").distinct(), ["session_id", "text"], "left_anti")
        had = known.groupBy("session_id").agg(F.max("nth").alias("__had"))
        nth = F.coalesce("__had", F.lit(0)) + F.row_number().over(W.partitionBy("session_id").orderBy("rank"))
        new = new.join(had, "session_id", "left").withColumn("nth", nth.cast("long")).where(F.col("nth") <= most)
        put(new.select("session_id", "nth", "kind", "text", "seq", "standing"), "facts")

    blocks.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(fact).parquet(f"{sink}/facts").select("session_id", "nth", "kind", "text", "seq", "standing")
