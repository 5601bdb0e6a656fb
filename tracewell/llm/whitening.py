"""Whitening of vectors by distributed block matrices (Spark MLlib ``BlockMatrix``).

Rows are numbered once in the order they were written and centred on exact means.  Runs of rows become the
blocks of a tall matrix; its transpose times itself is the scatter, summed over as many tasks as there are
slices of the middle dimension; the eigenvectors of that small matrix are local numpy work, and one more
block multiplication projects all rows on them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import saved

#: Numbers in a block; MLlib lists all blocks on the driver, so they are not small.
BLOCK_NUMBERS = 1 << 17
COMPONENTS = 8
#: Eigenvalues below this share of the largest count as none: the vectors do not vary that way.
FLAT = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<long>, row) with x = floor(1024 * c) + 100000 (c held within +-4e15), written and numbered.

    Vectors that are null or empty, hold nulls or non-finite entries, or are not of the most frequent length
    (ties: the longest) are left out.  ``row`` is the task that wrote the row (high bits) and its place there.
    """
    odd = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = vectors.where(F.col("embedding").isNotNull() & ~odd & (F.size("embedding") > 0))
    long = sound.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    held = lambda c: F.floor(F.lit(1024.0) * F.least(F.greatest(c.cast("double"), F.lit(-4e15)), F.lit(4e15))) + F.lit(100000)
    x = sound.where(F.size("embedding") == (long.d if long else 0)).select("vec_id", F.transform("embedding", held).alias("x"))
    return saved(x.withColumn("row", F.monotonically_increasing_id()), "vectors")


def exact_sums(x: DataFrame) -> list[int]:
    """The sum of each entry over all rows."""
    entries = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"))
    return [int(r.s) for r in entries.orderBy("i").collect()]


def _numbered(x: DataFrame, rows: int) -> DataFrame:
    """``x`` with ``index``: the rows of a writing task follow each other, from a multiple of ``rows`` on."""
    parts = x.groupBy(F.shiftright("row", 33).alias("part")).agg(F.ceil(F.count("*") / rows).alias("blocks"))
    first, parts_ = 0, []
    for r in parts.orderBy("part").collect():  # a row per writing task
        parts_.append((r.part, first))
        first += r.blocks * rows
    places = x.sparkSession.createDataFrame(parts_, "part long, first long")
    index = F.col("first") + F.col("row").bitwiseAND((1 << 33) - 1)
    return x.join(F.broadcast(places), F.shiftright("row", 33) == F.col("part")).select("vec_id", "x", index.alias("index"))


def _centred_blocks(x: DataFrame, sums: list[int], n: int, rows: int) -> BlockMatrix:
    """The rows x - sums / n as blocks of ``rows`` rows; places without a row are zero."""
    d, whole = len(sums), np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])

    def block(key, t):
        values = np.zeros((rows, d))
        at = t.column("index").to_numpy() % rows
        values[at] = (t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, d) - whole) - rest
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "numbers": pa.array([values.tobytes()], pa.binary())})

    blocks = x.select(F.floor(F.col("index") / rows).cast("int").alias("i"), "index", "x").groupBy("i").applyInArrow(block, "i int, numbers binary")
    blocks = saved(blocks, "blocks")
    return BlockMatrix(blocks.rdd.map(lambda r: ((r.i, 0), DenseMatrix(rows, d, np.frombuffer(r.numbers), True))), rows, d)


def _times(a: BlockMatrix, b: BlockMatrix, slices: int = 1) -> BlockMatrix:
    """a * b, its sums over the middle dimension dealt over ``slices`` tasks."""
    product = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, slices)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _scatter(m: BlockMatrix, slices: int) -> np.ndarray:
    return _times(m.transpose(), m, slices).toLocalMatrix().toArray()


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding).

    A row per remaining vector and component, components numbered from 1 by falling eigenvalue of the
    covariance.  ``whitened`` is null in a component that the vectors do not vary along, and such components
    do not count in ``identity_error``.  ``deviation``, exact, is null beyond the range of a long.  Repeated
    rows and ids and null ids keep their rows; a table without a sound vector gives no rows.
    """
    spark = vectors.sparkSession
    x = whole_vectors(vectors.select("vec_id", "embedding"))
    n = x.count()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    sums = exact_sums(x)
    d = len(sums)
    rows = max(1, BLOCK_NUMBERS // d)
    numbered = _numbered(x, rows)
    # every product reads the blocks; if they are lost with an executor they are read again from the table
    centred = _centred_blocks(numbered, sums, n, rows).persist(StorageLevel.MEMORY_AND_DISK)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))

    values, axes = np.linalg.eigh(_scatter(centred, slices) / n)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(values.sum())
    k = min(components, d)
    used = values[:k] > FLAT * max(values[0], 0) if values[0] > 0 else np.zeros(k, bool)
    scale = np.where(used, axes[:, :k] / np.sqrt(np.where(used, values[:k], 1)), 0)
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, k, scale.ravel(order="F")))], 1), d, k)
    projected = _times(centred, weights)
    covariance = _scatter(projected, slices) / n
    error = np.abs(covariance - np.eye(k))[np.ix_(used, used)]
    error = float(error.max()) if used.any() else 0.0

    white = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    white = MLUtils.convertVectorColumnsToML(white, "vector").select("index", vector_to_array("vector").alias("white"))

    def deviations(batches):
        for b in batches:
            at = b.column("x").flatten().to_numpy().reshape(-1, d)
            rough = ((n * at.astype(float) - np.array(sums, float)) ** 2).sum(axis=1)
            if len(at) and (rough.max() > 2**61 or n * float(np.abs(at).max()) > 2**62):
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in at]
                exact = [e if e < 2**63 else None for e in exact]
            else:
                exact = ((n * at - np.array([int(s) for s in sums], np.int64)) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("index"), pa.array(exact, pa.int64())], ["vec_id", "index", "deviation"])

    own = numbered.mapInArrow(deviations, "vec_id long, index long, deviation long")
    out = own.join(white, "index").select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    explained, flat = [float(v / trace) if trace > 0 else 0.0 for v in values[:k]], [bool(u) for u in used]
    explained, flat = F.array(*map(F.lit, explained)), F.array(*map(F.lit, flat))
    whitened = F.when(F.element_at(flat, F.col("i") + 1), F.col("whitened")).alias("whitened")
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", whitened, F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"))
