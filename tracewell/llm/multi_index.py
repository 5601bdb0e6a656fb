"""Near-duplicate embeddings by an inverted multi-index.

The two halves of the unit vectors have a codebook each; a pair of codewords is a cell, and a vector is filed
in the cell of its nearest codewords.  A vector then visits cells in the order of the multi-sequence
algorithm: by the sum of what the two halves need at least to reach them, that is their squared distances to
the bisector planes between the codeword and the vector's own.  Two vectors in different cells lie on both
sides of one such plane in each half whose codewords differ, so their distance is at least the sum of what
both need there: at least one of them needs a quarter of the squared distance of linked vectors at most if one
half differs, and half of it if both do.  The traversal stops at these bounds, and no link is lost.  A pair
that both sides reach counts from the smaller id only; a pair that one side reaches counts for both.  A target
recall below 1 stops earlier: at a quantile, with a margin, of what neighbours of sampled vectors made at
exactly the threshold need.  Visits are verified by cosine in double precision, in blocks.

Codebooks come from a bounded sample.  Exact copies are one vector with a weight.  A block returns per vector
its number of links and a spanning forest of the links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components, finite_vector, in_blocks, saved

#: Vectors to fit on, codewords per half, rows and visitors of one block.
SAMPLE, CODEWORDS, ROWS, VISITORS = 8192, 16, 4096, 2048
#: Target recall of neighbours at the threshold (1: all), and the margin on where the traversal stops below 1.
RECALL, MARGIN = 1.0, 1.5


def codebook(x: np.ndarray, words: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Codewords by k-means."""
    distinct = np.unique(x, axis=0)
    g = np.random.default_rng([seed, len(distinct)])
    c = distinct[g.permutation(len(distinct))[:words]]
    for _ in range(rounds):
        near = np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def needs(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own codeword, squared distance that each vector must move at least to reach each codeword's cell)."""
    far = (c**2).sum(1)[None] - 2 * x @ c.T
    own = np.argmin(far, 1)
    gap = np.sqrt(((c[own][:, None] - c[None]) ** 2).sum(2))
    plane = (far - far[np.arange(len(x)), own][:, None]) / (2 * np.where(gap > 0, gap, 1))
    return own, np.where(gap > 0, plane, 0).clip(0) ** 2


def traversal(first: np.ndarray, second: np.ndarray, own: tuple[int, int], stop: float, limit: float) -> Iterator[tuple[int, int]]:
    """Cells of one vector in order of the summed needs of their halves, up to ``stop`` and to the bound of ``limit``."""
    i, j = np.flatnonzero(first <= stop), np.flatnonzero(second <= stop)
    cost = first[i][:, None] + second[j][None]
    bound = np.minimum(stop, np.where((i == own[0])[:, None] | (j == own[1])[None], limit / 4, limit / 2))
    for k in np.argsort(cost, axis=None, kind="stable"):
        if cost.flat[k] <= bound.flat[k]:
            yield int(i[k // len(j)]), int(j[k % len(j)])


def geometric_limit(cosine: float) -> float:
    """The squared distance of two linked unit vectors at most."""
    return (2 - 2 * cosine) * (1 + 1e-9) + 1e-9


def fitted_stop(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float, recall: float, seed: int) -> float:
    """Where the traversal stops: half of the geometric limit, or for a target below 1 the quantile of neighbours made at exactly ``cosine``."""
    limit = geometric_limit(cosine) / 2
    if recall >= 1 or not len(x):
        return limit
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = cosine * x + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    half = x.shape[1] // 2
    cost = 0
    for part, book in zip((slice(None, half), slice(half, None)), books):
        cost = cost + needs(x[:, part], book)[1][np.arange(len(x)), needs(y[:, part], book)[0]]
    return min(limit, MARGIN * float(np.quantile(cost, recall)) + 1e-12)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a boolean matrix joins: every node with the smallest id of its part, one step of which is a link."""
    a, b = left.copy(), right.copy()
    big = np.iinfo(np.int64).max
    while True:
        up = np.minimum(a, np.where(linked, b[None], big).min(1, initial=big))
        down = np.minimum(b, np.where(linked, up[:, None], big).min(0, initial=big))
        if (up == a).all() and (down == b).all():
            break
        a, b = up, down
    ids, to = np.concatenate([left, right]), np.concatenate([a, b])
    return [(int(x), int(y)) for x, y in zip(ids, to) if x != y]


def near_copies(vectors: DataFrame, cosine: float = 0.98, recall: float = RECALL, codewords: int = CODEWORDS, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Two vectors link if their labels are equal and not null and their cosine is at least ``cosine``.  Vectors
    that are null, zero or hold null or non-finite components, and vectors of different lengths, link with
    nothing.  Rows that repeat an id are one vector if they are equal; a null id links with nothing.  An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"), "label")
    clean = rows.where(finite_vector(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # exact copies count as one
    held = clean.select(F.col("label"), F.transform("v", lambda x: x.cast("double")).alias("v"), "vec_id").distinct()
    held = held.withColumn("key", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    copies = saved(held.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v")), "copies")

    sizes = [r[0] for r in copies.select(F.size("v").alias("dim")).distinct().collect()]
    fitted = {}
    for dim in sizes:
        sample = copies.where(F.size("v") == dim).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toPandas()["v"]
        x = np.stack(sample.to_numpy())
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        books = tuple(codebook(part, codewords, seed) for part in (x[:, : dim // 2], x[:, dim // 2 :]))
        fitted[dim] = (books, fitted_stop(x, books, cosine, recall, seed))
    shared = spark.sparkContext.broadcast(fitted)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, limit = ["label", "dim", "cell", "rep", "n", "v", "home", "reach"], geometric_limit(cosine)
        for whole in batches:
            dims = pa.compute.list_value_length(whole.column("v"))
            for dim in set(dims.to_pylist()):
                of_dim = whole.filter(pa.compute.equal(dims, dim))
                (one, two), stop = shared.value[dim]
                for at in range(0, len(of_dim), 512):
                    batch = of_dim.slice(at, 512)
                    x = batch.column("v").flatten().to_numpy().reshape(len(batch), dim)
                    x = x / np.linalg.norm(x, axis=1, keepdims=True)
                    (own1, need1), (own2, need2) = needs(x[:, : dim // 2], one), needs(x[:, dim // 2 :], two)
                    row, cell, home, reach = [], [], [], []
                    for r in range(len(x)):
                        at_home = int(own1[r] * len(two) + own2[r])
                        cells = [i * len(two) + j for i, j in traversal(need1[r], need2[r], (own1[r], own2[r]), stop, limit)]
                        row += [r] * len(cells)
                        cell += cells
                        home += [at_home] * len(cells)
                        reach += [cells if c == at_home else None for c in cells]
                    take = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column("label").take(take), pa.array(np.full(len(row), dim, np.int32)), pa.array(cell, pa.int32()), batch.column("rep").take(take), batch.column("n").take(take), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), dim).cast(pa.list_(pa.float64())).take(take), pa.array(home, pa.int32()), pa.array(reach, pa.list_(pa.int32()))], names)

    kind = copies.schema["label"].dataType.simpleString()
    visits = copies.select("label", "rep", "n", "v").mapInArrow(visit, f"label {kind}, dim int, cell int, rep bigint, n bigint, v array<double>, home int, reach array<int>")
    keys = ["label", "dim", "cell"]
    filed = visits.where("cell = home").select(*keys, F.col("rep").alias("row_id"), "n", "v", "reach")
    visitors = visits.select(*keys, F.col("rep").alias("visitor_id"), "n", "v", "home")
    filed, visitors = in_blocks(filed, visitors, keys, "row_id", "visitor_id", ROWS, VISITORS)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list = []
        if len(left) and len(right):
            ids, n, asked = left["row_id"].to_numpy(), left["n"].to_numpy(), right["visitor_id"].to_numpy()
            x, y = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            linked = (y @ x.T) >= cosine
            # a pair that the other side reaches too counts from the smaller id, any other pair from here
            reach, home = left["reach"].to_numpy(), right["home"].to_numpy()
            reached = np.zeros((len(ids), 1 + max(home.max(), max(r.max() for r in reach))), bool)
            reached[np.repeat(np.arange(len(ids)), [len(r) for r in reach]), np.concatenate(reach)] = True
            linked &= (asked[:, None] < ids[None]) | (~reached[:, home].T & (asked[:, None] != ids[None]))
            hit, seen = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
            out = [(int(i), int(c), None) for i, c in zip(asked[hit], linked[hit] @ n)]
            out += [(int(i), int(c), None) for i, c in zip(ids[seen], linked[:, seen].T @ right["n"].to_numpy())]
            out += [(a, 0, b) for a, b in forest(linked[np.ix_(hit, seen)], asked[hit], ids[seen])]
        return pd.DataFrame({"vec_id": pd.array([r[0] for r in out], "Int64"), "links": pd.array([r[1] for r in out], "Int64"), "other": pd.array([r[2] for r in out], "Int64")})

    on = [*keys, "rb", "pb"]
    found = saved(filed.groupBy(*on).cogroup(visitors.groupBy(*on)).applyInPandas(compare, "vec_id bigint, links bigint, other bigint"), "links")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    member = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")))
    reps = copies.select("label", "key", "rep", "n").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(member.withColumnRenamed("node", "rep"), "rep", "left")
    least = reps.select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = held.select("vec_id", "label", "key").join(least, ["label", "key"]).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    whole = rows.select("vec_id").join(linked, "vec_id", "left").withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", "vec_id")})
    return whole.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
