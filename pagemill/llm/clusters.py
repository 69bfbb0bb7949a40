"""Centroid clustering by dimension-sharded Lloyd rounds, in exact integers.

Vectors are cut into column blocks.  A row of the sharded table is one block of the
columns of one chunk of vectors, so a task holds some dimensions of some vectors and
needs no more of the centroids than the same dimensions.  A round is

1. every block adds up the squared distances over its own dimensions, from each of
   its vectors to each centroid slice;
2. the blocks of a chunk are added (keyed by chunk), and each vector takes the smallest
   sum: equal distances go to the smaller number;
3. the labels go back to the blocks of the chunk; each block adds its columns by label,
   and these sums, added over the chunks with partial sums, give its new centroid slice.

A chunk has a fixed number of vectors and a block a fixed number of columns, so no task
or group grows with the data, and a cluster that holds all vectors is added up like any
other.  Centroids are tables of ``k`` rows by ``dims`` columns, which is the size bound of
everything that is broadcast.  Every round is a written table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import materialise

K, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
#: Columns of a block, and vectors of a chunk.
BLOCK_DIMS, CHUNK_ROWS = 16, 4096
#: Integer components beyond it would overflow 64-bit squared distances; such input is an error.
MAX_COMPONENT = 1 << 27

SHARDS = "chunk long, block int, n int, ids array<long>, cols binary"


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): vectors of ``dims`` finite components, as integers floor(scale * x)."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.where((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fits = F.forall("x", lambda v: F.abs(v) * scale <= MAX_COMPONENT)
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    return kept.select("vec_id", F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("vec"))


def first_centroids(vectors: DataFrame, k: int = K, prefix: str = "2:") -> DataFrame:
    """(cluster, vec): the ``k`` vectors of least sha256 of prefix and vec_id, in that order.

    Rows of one vec_id go by their components; rows without vec_id come last.
    """
    keyed = vectors.select(F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256).alias("h"), "vec")
    chosen = keyed.orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).agg(
        F.array_sort(F.collect_list(F.struct(F.col("h").isNull().alias("no"), "h", "vec"))).alias("all"))
    return chosen.select(F.posexplode("all").alias("cluster", "s")).select("cluster", "s.vec")


def shard(vectors: DataFrame, block_dims: int = BLOCK_DIMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The column blocks of chunks of vectors; the ids stand with block 0."""
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(part.num_rows, -1)
                cols = [np.ascontiguousarray(x[:, c:c + block_dims]).tobytes() for c in range(0, x.shape[1], block_dims)]
                ids = [part.column(0).to_pylist(), *[None] * (len(cols) - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(cols), pa.int64()), pa.array(range(len(cols)), pa.int32()), pa.array([part.num_rows] * len(cols), pa.int32()),
                     pa.array(ids, pa.list_(pa.int64())), pa.array(cols, pa.binary())], names=["chunk", "block", "n", "ids", "cols"])
                chunk += 1
    return vectors.select("vec_id", "vec").mapInArrow(run, SHARDS)


def _slices(centroids: DataFrame, block_dims: int) -> DataFrame:
    """(block, slice): the columns of all centroids (cluster, vec) that a block needs."""
    def run(groups):
        for p in groups:
            if len(p):
                all_ = np.array(p.sort_values("cluster")["vec"].tolist(), dtype="<i8")
                starts = range(0, all_.shape[1], block_dims)
                yield pd.DataFrame({"block": range(len(starts)), "slice": [np.ascontiguousarray(all_[:, c:c + block_dims]).tobytes() for c in starts]})
    return centroids.coalesce(1).mapInPandas(run, "block int, slice binary")


def _partial_distances(shards: DataFrame, slices: DataFrame, block_dims: int) -> DataFrame:
    """(chunk, n, part): squared distances of a chunk's vectors to all centroids over one block."""
    def run(batches):
        for p in batches:
            parts = []
            for cols, n, own in zip(p["cols"], p["n"], p["slice"], strict=True):
                x = np.frombuffer(cols, dtype="<i8").reshape(n, -1)
                c = np.frombuffer(own, dtype="<i8").reshape(-1, x.shape[1])
                parts.append(np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1).astype("<i8").tobytes())
            yield pd.DataFrame({"chunk": p["chunk"], "n": p["n"], "part": parts})
    return shards.select("chunk", "block", "n", "cols").join(F.broadcast(slices), "block").mapInPandas(run, "chunk long, n int, part binary")


def assign(shards: DataFrame, slices: DataFrame, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """(chunk, labels, distances): the nearest centroid of every vector, block sums added by chunk."""
    def nearest(p: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype="<i8").reshape(p["n"].iloc[0], -1) for x in p["part"])
        label = total.argmin(axis=1)
        return pd.DataFrame({"chunk": p["chunk"].iloc[:1], "labels": [label.astype("<i4").tobytes()],
                             "distances": [total[np.arange(len(total)), label].astype("<i8").tobytes()]})
    return _partial_distances(shards, slices, block_dims).groupBy("chunk").applyInPandas(nearest, "chunk long, labels binary, distances binary")


def update(shards: DataFrame, labels: DataFrame, centroids: DataFrame, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """Centroids (cluster, vec) after a round: floor(sum / count) of each cluster, empty ones as before."""
    def run(batches):
        for p in batches:
            out = []
            for block, n, cols, own in zip(p["block"], p["n"], p["cols"], p["labels"], strict=True):
                x, label = np.frombuffer(cols, dtype="<i8").reshape(n, -1), np.frombuffer(own, dtype="<i4")
                for one in np.unique(label):
                    mine = x[label == one]
                    out += [(int(one), int(block) * block_dims + j, int(s), len(mine)) for j, s in enumerate(mine.sum(axis=0))]
            yield pd.DataFrame(out, columns=["cluster", "dim", "total", "n"])
    parts = shards.select("chunk", "block", "n", "cols").join(labels.select("chunk", "labels"), "chunk").mapInPandas(
        run, "cluster int, dim int, total long, n long")
    sums = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mean = F.expr("CAST((total - pmod(total, n)) DIV n AS long)")
    # k rows of dims values: one cell for each of a centroid's components.
    new = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", mean.alias("x")))), lambda s: s["x"]).alias("new"))
    return centroids.join(F.broadcast(new), "cluster", "left").select("cluster", F.coalesce("new", "vec").alias("vec"))


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
                    block_dims: int = BLOCK_DIMS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Kept are vectors of ``dims`` components, none of them null or not finite; others get
    no row.  Rows that repeat a vec_id, or have none, are vectors of their own.  With
    fewer than ``k`` vectors there are so many centroids.  Other columns are ignored.
    """
    kept = materialise(kept_vectors(vectors, dims, scale), "vectors")
    shards = materialise(shard(kept, block_dims, chunk_rows), "shards")
    centroids = materialise(first_centroids(kept, k), "centroids")
    for _ in range(rounds):
        labels = materialise(assign(shards, _slices(centroids, block_dims), block_dims), "labels")
        centroids = materialise(update(shards, labels, centroids, block_dims), "centroids")
    labels = materialise(assign(shards, _slices(centroids, block_dims), block_dims), "labels")

    def rows(batches):
        for p in batches:
            yield pd.DataFrame({"vec_id": pd.array([x for i in p["ids"] for x in i], dtype="Int64"),
                                "cluster": np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(x, dtype="<i4") for x in p["labels"])]),
                                "distance": np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, dtype="<i8") for x in p["distances"])])})
    assigned = materialise(shards.where("block = 0").select("chunk", "ids").join(labels, "chunk").mapInPandas(
        rows, "vec_id long, cluster int, distance long"), "assigned")
    each = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    each = each.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # k rows
    said = F.sha2(F.concat_ws(",", F.transform("vec", lambda x: x.cast("string"))), 256)
    final = centroids.select("cluster", said.alias("centroid_sha256")).join(each, "cluster")
    return assigned.join(F.broadcast(final), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
