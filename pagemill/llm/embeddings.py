"""Embedding near-dedup as an exact metric range join.

Cosine >= c on vectors is a chord distance of at most r = sqrt(2 - 2c) on unit
vectors, a metric.  Pivots cut the vectors of a label into cells; a vector lives
in the cell of its nearest pivot and is replicated to every other cell whose
border may be within r of it, so each cell then finds all neighbours of the
vectors that live there, independently of the others.

Bounds used for replication of x (nearest pivot p) to the cell of q:
* triangle inequality: a neighbour y that lives with q has d(y,q) <= d(y,p), so
  d(x,q) <= d(y,q) + r <= d(y,p) + r <= d(x,p) + 2r;
* the plane between p and q: y lies on q's side of it, so x is at most r before it.

A cell of any size is joined block by block, so no task holds more than two blocks.
Equal vectors of a label are joined once, with their count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise
from pagemill.llm.components import connected_components

MIN_COSINE = 0.93
#: Vectors of a label per pivot; a label of at most as many rows is one cell.
CELL_ROWS = 2048
#: Pivots over all labels at most (they are broadcast): cells grow beyond that.
MAX_PIVOTS = 32_768
#: Rows of a block; a task joins two.
BLOCK_ROWS = 2048
#: Slack for rounding in the replication bounds; the link test itself has none.
SLACK = 1e-9


def _valid(vec: str) -> F.Column:
    """Vectors that can link: not null or empty, finite, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _units(packed: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    v = np.frombuffer(b"".join(packed), dtype="<f8").reshape(-1, dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps squares of extreme values finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pack_vectors(df: DataFrame) -> DataFrame:
    """(node, label, mult, dim, vec): vectors as bytes of doubles."""
    def run(batches):
        for b in batches:
            arrays = [np.asarray(v, dtype="<f8") for v in b["embedding"]]
            yield pd.DataFrame({"node": b["node"], "label": b["label"], "mult": b["mult"],
                                "dim": [len(a) for a in arrays], "vec": [a.tobytes() for a in arrays]})
    label = df.schema["label"].dataType.simpleString()
    return df.select("node", "label", "mult", "embedding").mapInPandas(run, f"node long, label {label}, mult long, dim int, vec binary")


def _assign(reps: DataFrame, pivots, reach: float) -> DataFrame:
    """Rows of ``reps`` with (cell, home): once where they live, once per cell that they border."""
    def run(batches):
        for b in batches:
            for (label, dim), g in b.groupby(["label", "dim"], sort=False):
                own = pivots.value.get((label, dim))
                if own is None:
                    yield g.assign(cell=np.int32(0), home=True)
                    continue
                u = _units(g["vec"], dim)
                dist = np.sqrt(np.maximum(2 - 2 * (u @ own.T), 0))
                nearest = dist.argmin(axis=1)
                least = dist[np.arange(len(u)), nearest]
                apart = np.sqrt(np.maximum(2 - 2 * (own @ own.T), 0))[nearest]
                near = dist <= least[:, None] + 2 * reach + SLACK
                near &= dist ** 2 - least[:, None] ** 2 <= 2 * reach * apart + SLACK
                row, cell = np.nonzero(near)
                yield g.iloc[row].assign(cell=cell.astype(np.int32), home=cell == nearest[row])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInPandas(run, f"{fields}, cell int, home boolean")


def _block_links(threshold: float):
    """Joins the home rows of one block with the other rows of its group."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        home, other = g[g["home"]], g[~g["home"]]
        none = pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        if home.empty or other.empty:
            return none
        dim = int(g["dim"].iloc[0])
        a, b = home["node"].to_numpy(), other["node"].to_numpy()
        linked = _units(home["vec"], dim) @ _units(other["vec"], dim).T >= threshold
        linked &= a[:, None] != b[None, :]
        i, j = np.nonzero(linked)
        if not len(i):
            return none
        links = np.bincount(i, weights=other["mult"].to_numpy()[j], minlength=len(a)).astype(np.int64)
        # Smallest node that links reach inside the block: a spanning star instead of all links.
        ra, rb = a.copy(), b.copy()
        while True:
            low = np.minimum(ra[i], rb[j])
            before = ra.sum() + rb.sum()
            np.minimum.at(ra, i, low)
            np.minimum.at(rb, j, low)
            if ra.sum() + rb.sum() == before:
                break
        ia, jb = np.unique(i), np.unique(j)
        return pd.concat([pd.DataFrame({"node": a[ia], "links": links[ia], "root": ra[ia]}),
                          pd.DataFrame({"node": b[jb], "links": 0, "root": rb[jb]})])
    return run


def range_links(reps: DataFrame, threshold: float = MIN_COSINE, cell_rows: int = CELL_ROWS,
                max_pivots: int = MAX_PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links, root) rows: summed ``links`` count a node's neighbours by their ``mult``,
    and the (node, root) pairs connect exactly what links connect."""
    spark = reps.sparkSession
    reps = materialise(pack_vectors(reps), "vectors")
    groups = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    cell_rows = max(cell_rows, -(-reps.count() // max_pivots))
    # Each pivot stands for at least cell_rows / 2 rows, so pivots stay within 2 * max_pivots.
    chance = F.col("n").cast("double") / cell_rows / F.col("n")
    picked = (reps.join(groups.where(F.col("n") > cell_rows), ["label", "dim"])
              .where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < chance * (1 << 30))
              .select("label", "dim", "vec").collect())
    by_group: dict = {}
    for r in picked:
        by_group.setdefault((r["label"], r["dim"]), []).append(bytes(r["vec"]))
    pivots = spark.sparkContext.broadcast({k: _units(pd.Series(v), k[1]) for k, v in by_group.items()})

    placed = materialise(_assign(reps, pivots, math.sqrt(2 - 2 * threshold)), "cells")
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count_if("home").alias("_h"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*cell, F.ceil(F.col("_h") / block_rows).cast("int").alias("_hb"),
                         F.ceil(F.col("_n") / block_rows).cast("int").alias("_nb")).where("_hb > 0")
    rows = placed.join(sizes, cell)
    mine, theirs = (F.pmod(F.hash("node"), F.col(c)) for c in ("_hb", "_nb"))
    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.where("home").withColumn("i", mine).withColumn("j", every("_nb"))
    others = rows.withColumn("home", F.lit(False)).withColumn("j", theirs).withColumn("i", every("_hb"))
    blocks = own.select("node", "mult", "vec", "home", *cell, "i", "j").unionByName(
        others.select("node", "mult", "vec", "home", *cell, "i", "j"))
    return blocks.groupBy(*cell, "i", "j").applyInPandas(_block_links(threshold), "node long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = MIN_COSINE, **sizes) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their dimensions are
    equal and their cosine in double precision is ``threshold`` or more.  Null,
    empty and zero vectors and those with null or non-finite parts link with
    nothing, nor do rows without vec_id.  ``n_links`` counts other rows, equal ones
    included; ``component_id`` is the smallest vec_id that links reach.  vec_id is
    taken to name one vector: rows that repeat it with another vector are counted
    together.  Other columns are ignored.
    """
    vec = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding"), "label")
    rows = rows.withColumn("_ok", _valid("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    keys = ["label", "_k1", "_k2"]
    keyed = rows.withColumn("_k1", F.xxhash64("embedding")).withColumn("_k2", F.xxhash64(F.lit(1), "embedding"))
    slim = materialise(keyed.select("vec_id", "_ok", *keys), "vector_keys")
    same = materialise(slim.where("_ok").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("mult")), "same_vectors")
    reps = (keyed.where("_ok").join(same, keys).where("vec_id = node")
            .dropDuplicates(["node", *keys]).select("node", "label", "mult", "embedding"))
    found = materialise(range_links(reps, threshold, **sizes), "range_links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    nodes = same.join(links, "node", "left").join(parts, "node", "left")
    out = slim.join(nodes, keys, "left")
    linked = F.when(F.col("_ok"), F.coalesce("links", F.lit(0)) + F.col("mult") - 1).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("_ok"), F.coalesce("component", "node")).otherwise(F.col("vec_id"))
    return out.select("vec_id", linked.alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
