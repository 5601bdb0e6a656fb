"""Approximate nearest neighbours by p-stable hashing with query-directed probes.

Each of ``TABLES`` hash tables puts a vector in a bucket of ``k`` values floor((a.x + b) / w) with Gaussian a.
A query visits, in each table, its own bucket and perturbed ones in order of their estimated success: a
perturbation's cost is the sum of squared distances from the query's projections to the slots it moves to.
Buckets and the queries that visit them meet in blocks; each block returns its best few by exact distance in
double precision, and the tables' candidates are merged and ranked.  The queries' own buckets come first: once
these give a query enough candidates, its other blocks return only what is no farther than the last of them,
so that what a query's blocks return does not grow with their number.

``k`` grows with the logarithm of the number of rows, so that a bucket holds about ``BUCKET`` of them; a
bucket that is larger is cut in blocks, none of its rows is left out.  ``w`` and the number of probes are
fitted on a bounded sample so that its recall reaches ``recall``, with a smaller ``k`` where 4,096 probes do not; the neighbours of a sample are farther
away than those of the whole table, so this is on the safe side.  A query that the probes bring too few
candidates is compared with every row, in blocks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import finite_vector, first_k, in_blocks, saved

TABLES, BUCKET, SAMPLE, SAMPLE_QUERIES = 6, 1024, 4096, 200
#: Rows and queries of one block, and the slots that a probe can move in one direction.
ROWS, QUERIES, REACH = 4096, 1024, 2


def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, k, dim) directions, orthogonal within a table where there are enough dimensions, and offsets in 0..1."""
    g = np.random.default_rng([seed, dim, k])
    a = g.standard_normal((tables, k, dim))
    if 0 < k <= dim:
        a = np.stack([np.linalg.qr(x.T)[0].T for x in a]) * math.sqrt(dim)
    return a, g.random((tables, k))


def buckets(slots: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of slots."""
    rows = np.ascontiguousarray(slots, np.int64)
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows.reshape(-1, rows.shape[-1])], np.uint64).view(np.int64) if rows.shape[-1] else np.zeros(len(rows), np.int64)


def probe_order(place: np.ndarray, probes: int) -> list[np.ndarray]:
    """Slots to visit for one query and table, best first; ``place`` is the query's position in units of slots."""
    home = np.floor(place).astype(np.int64)
    inside = place - home
    moves = [sorted([(0.0, 0)] + [((inside[i] + d - 1) ** 2, -d) for d in range(1, REACH + 1)] + [((d - inside[i]) ** 2, d) for d in range(1, REACH + 1)]) for i in range(len(place))]
    found, heap, seen = [], [(0.0, (0,) * len(place))], {(0,) * len(place)}
    while heap and len(found) < probes:
        cost, at = heapq.heappop(heap)
        found.append(home + np.array([moves[i][j][1] for i, j in enumerate(at)], np.int64))
        for i, j in enumerate(at):
            if j + 1 < len(moves[i]):
                then = (*at[:i], j + 1, *at[i + 1 :])
                if then not in seen:
                    seen.add(then)
                    heapq.heappush(heap, (cost - moves[i][j][0] + moves[i][j + 1][0], then))
    return found


def fit(sample: np.ndarray, k: int, tables: int, top: int, recall: float, seed: int) -> tuple[float, int, bool]:
    """(w, probes, reached): slots as wide as the projected distance to the ``top``-th neighbour, probes that reach ``recall``, and whether the most that are allowed do."""
    if len(sample) < 2:
        return 1.0, 1, True
    queries = sample[:SAMPLE_QUERIES]
    far = ((sample**2).sum(1)[None] + (queries**2).sum(1)[:, None] - 2 * queries @ sample.T).clip(0)
    far[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    top = min(top, len(sample) - 1)
    near = np.argsort(far, 1, kind="stable")[:, :top]
    w = 1.5 * float(np.sqrt(np.median(far[np.arange(len(queries)), near[:, -1]]))) or 1.0
    if not k or not top:
        return w, 1, True
    a, b = projections(sample.shape[1], k, tables, seed)
    place = np.einsum("tkd,nd->tnk", a, sample) / w + b[:, None]
    slots = np.floor(place).astype(np.int64)
    most = (2 * REACH + 1) ** k
    first = np.full((len(queries), top), most + 1)
    for t in range(tables):
        for q in range(len(queries)):
            order = {tuple(s): i for i, s in enumerate(probe_order(place[t, q], min(most, 4096)))}
            first[q] = np.minimum(first[q], [order.get(tuple(s), most + 1) for s in slots[t, near[q]]])
    ranks = np.sort(first.reshape(-1))
    need = int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))] + 1)
    return w, min(most, 4096, need), need <= min(most, 4096)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest(rows: DataFrame, probes: DataFrame, keys: list[str], top: int) -> DataFrame:
    """(query_id, vec_id, score): the ``top`` nearest of each block for each of its queries, none beyond its ``bound`` (null: no bound)."""
    rows, probes = in_blocks(rows, probes, keys, "vec_id", "query_id", ROWS, QUERIES)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(left) and len(right):
            ids, x = left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()).astype(np.float64)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            repeats = len(np.unique(ids)) < len(ids)
            for q, v, bound in zip(right["query_id"].to_numpy(), right["v"].to_numpy(), right["bound"].to_numpy(np.float64, na_value=np.nan)):
                d = np.sqrt(((x - np.asarray(v, np.float64)) ** 2).sum(1))
                other = np.flatnonzero(ids != q)
                if repeats:  # the nearest row of each id
                    other = other[np.lexsort((d[other], ids[other]))]
                    other = other[np.unique(ids[other], return_index=True)[1]]
                best = other[np.argsort(d[other], kind="stable")[:top]]  # ties go to the smaller id
                best = best[~(d[best] > bound)]
                out += zip([q] * len(best), ids[best], d[best])
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    on = [*keys, "rb", "pb"]
    return rows.groupBy(*on).cogroup(probes.groupBy(*on)).applyInPandas(score, "query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 10, tables: int = TABLES, recall: float = 0.97, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` its ``top`` nearest found among ``vectors`` (vec_id, embedding).

    Nearest first by Euclidean distance, ties to the smaller id; a query's own id is no candidate.  Vectors
    that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors are
    compared with those of the same length.  Rows that repeat an id count once for a query.
    """
    clean = lambda df, name: df.select(F.col("vec_id").cast("long").alias(name), F.col("embedding").alias("v")).where(finite_vector(F.col("v")) & F.col(name).isNotNull()).withColumn("dim", F.size("v"))
    rows, asked = clean(vectors, "vec_id"), clean(queries, "query_id")
    fitted = {}
    for dim, n in [tuple(r) for r in rows.groupBy("dim").count().collect()]:
        k = max(0, round(math.log2(max(1, n / BUCKET)) / 1.6))
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
        sample = np.stack(sample.to_numpy()).astype(np.float64)
        while not (found := fit(sample, k, tables, top, recall, seed))[2]:
            k -= 1  # fewer and larger buckets; one bucket reaches all
        fitted[dim] = (k, *found[:2])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in set(batch.column("dim").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("dim"), dim))
                k, w, _ = fitted[dim]
                a, b = projections(dim, k, tables if k else 1, seed)
                place = np.einsum("tkd,nd->tnk", a, _vectors(part.column("v"))) / w + b[:, None]
                for t, p in enumerate(place):
                    yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(np.full(len(part), t, np.int32)), pa.array(buckets(np.floor(p))), part.column("vec_id"), part.column("v")], ["dim", "t", "bucket", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = batch.slice(i, 1)
                dim = part.column("dim")[0].as_py()
                if dim not in fitted:
                    continue
                k, w, probes = fitted[dim]
                a, b = projections(dim, k, tables if k else 1, seed)
                place = np.einsum("tkd,nd->tnk", a, _vectors(part.column("v"))) / w + b[:, None]
                for t, p in enumerate(place):
                    to = buckets(np.array(probe_order(p[0], probes)).reshape(-1, k)) if k else np.zeros(1, np.int64)
                    n = len(to)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(to), pa.array(np.full(n, part.column("query_id")[0].as_py(), np.int64)), part.column("v").take(pa.array(np.zeros(n, np.int32))), pa.array(np.arange(n) == 0)], ["dim", "t", "bucket", "query_id", "v", "own"])

    kind = rows.schema["v"].dataType.simpleString()
    indexed = rows.mapInArrow(index, f"dim int, t int, bucket bigint, vec_id bigint, v {kind}")
    probed = saved(asked.mapInArrow(probe, f"dim int, t int, bucket bigint, query_id bigint, v {kind}, own boolean"), "probes")
    keys, free = ["dim", "t", "bucket"], F.lit(None).cast("double").alias("bound")
    first = saved(_merged(_nearest(indexed, probed.where("own").select(*keys, "query_id", "v", free), keys, top), top), "first")
    bounds = first.where(F.col("rank") == top).select("query_id", F.col("score").alias("bound"))
    others = probed.where("not own").drop("own").join(bounds, "query_id", "left")
    found = saved(_merged(first.drop("rank").unionByName(_nearest(indexed, others, keys, top)), top), "found")
    # queries with too few candidates
    enough = found.groupBy("query_id").agg(F.count("*").alias("n"))
    sizes = {dim: n for dim, n in [tuple(r) for r in rows.groupBy("dim").agg(F.count_distinct("vec_id")).collect()]}
    want = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(top, n - 1))) for d, n in sizes.items()], F.lit(0)) if sizes else F.lit(0)
    short = asked.join(enough, "query_id", "left").where(F.coalesce("n", F.lit(0)) < want).select("dim", "query_id", "v", free)
    rest = _merged(_nearest(rows, short, ["dim"], top), top)
    return found.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(rest)


def _merged(found: DataFrame, top: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return first_k(once, "query_id", [F.col("score"), F.col("vec_id")], top, "rank").select("query_id", "rank", "vec_id", "score")
