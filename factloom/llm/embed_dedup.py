"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors with equal labels link when their cosine, in double precision, reaches the threshold. Equal vectors are one class
from the start. Unit vectors are turned to principal axes (a rotation, so products stay): a tile adds up leading dimensions
first, bounds the rest of each product by the norms of the two suffixes, and drops a pair as soon as its cosine can't reach
the threshold. The exact cosine of the vectors as given decides on survivors.

Tiles: unit vectors that link differ by at most sqrt(2 - 2 t) in any direction, so a grid of that width over the leading axes has
them in cells that are equal or touch, and only such cells are compared; a cell with many vectors is cut in tiles of TILE. How many
axes the grid has (up to AXES) is what would be cheapest for a sample: more axes mean fewer comparisons, and more copies of a vector.
A tile pair passes on a number of links for each vector and links that join what is linked, never all its pairs. Axes and sample
(SAMPLE vectors at most) decide speed, not results.

Nulls: vectors that are null, zero or hold null or non-finite numbers, and vectors with a null label, link with nothing. A vector
with a null vec_id counts as any other, and gives its links to others; its own component is the smallest vec_id reached, and null
if there is none. vec_ids lie below 2 ** 62. Vectors of different lengths don't link. Repeated rows are equal vectors. Empty table:
no row. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import ship, small_side, written
from .components import components

TILE, SAMPLE, LEADING, STEP, AXES = 1500, 4096, 16, 16, 4
#: A copy of a vector costs as much as so many comparisons.
COPY = 300
#: Bits for each axis of a cell's number, and the first number that stands for vectors without an id.
BITS, NO_ID = 15, 1 << 62
#: Above the error of a rotated product of unit vectors.
SLACK = 1e-9


def valid(embedding: str, label: str):
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(F.col(label).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _numbers(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cell places; a step along axis a adds 2 ** (BITS * a)."""
    return sum((cells[:, a] + (1 << BITS - 1)) << (BITS * a) for a in range(cells.shape[1])) if cells.shape[1] else np.zeros(len(cells), np.int64)


def offsets(axes: int) -> list[int]:
    """What lies between a cell's number and those of the cells that it touches, itself included."""
    return [sum(o << (BITS * a) for a, o in enumerate(step)) for step in product((-1, 0, 1), repeat=axes)]


def _cheapest(cells: np.ndarray, labels: np.ndarray, scale: float) -> int:
    """Along how many axes the grid should be cut: of one vector in `scale`, comparisons grow with its square, copies with it."""
    best = (math.inf, 1)
    for axes in range(1, cells.shape[1] + 1):
        at, n = np.unique(np.stack([labels, _numbers(cells[:, :axes])]), axis=1, return_counts=True)
        count = dict(zip(map(tuple, at.T.tolist()), n.tolist(), strict=True))
        near = [(m, [count.get((label, cell + o), 0) for o in offsets(axes)]) for (label, cell), m in count.items()]
        compared = scale * scale * sum(m * sum(x) / 2 for m, x in near)
        copied = scale * sum(m * sum(max(1.0, scale * y / TILE) for y in x if y) for m, x in near)
        best = min(best, (compared + COPY * copied, axes))
    return best[1]


def _axes(classes: DataFrame, width: float) -> tuple[dict[int, np.ndarray], int]:
    """Principal axes, as columns, for each length of vectors, and the number of axes of the grid."""
    out, axes = {}, 1
    sizes = {r["d"]: r["count"] for r in classes.groupBy("d").count().orderBy(F.desc("count"), "d").limit(64).collect()}  # other lengths stay as they are
    for at, (d, n) in enumerate(sizes.items()):
        rows = classes.filter(F.col("d") == d).orderBy(F.xxhash64("node")).limit(SAMPLE).select("embedding", F.xxhash64("label")).collect()
        x = _unit(np.array([r[0] for r in rows], np.float64))
        out[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
        if not at:  # the most frequent length decides
            axes = _cheapest(np.floor(x @ out[d][:, : min(d, AXES)] / width).astype(np.int64), np.array([r[1] for r in rows]), max(1.0, n / len(rows)))
    return out, axes


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _celled(axes: dict[int, np.ndarray], cut: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(v, np.float64) for v in batch.column(0).to_pylist()]
            cells = np.zeros((len(x), cut), np.int64)
            for i, v in enumerate(x):
                if len(v) in axes:
                    own = np.floor(_unit(v[None, :])[0] @ axes[len(v)][:, :cut] / width)
                    cells[i, : len(own)] = own
            yield pa.record_batch([*batch.columns, pa.array(_numbers(cells), pa.int64())], names=[*batch.schema.names, "cell"])

    return run


def _survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of turned unit vectors whose product may reach the threshold."""
    d = a.shape[1]
    cuts = [min(d, LEADING), *range(LEADING + STEP, d, STEP)]
    cuts = [c for c in dict.fromkeys([*cuts, d]) if c <= d]
    suffix = lambda x, c: np.sqrt(np.maximum(1 - (x[:, :c] ** 2).sum(axis=1), 0)) + SLACK
    sa, sb = [suffix(a, c) for c in cuts], [suffix(b, c) for c in cuts]
    first = a[:, : cuts[0]] @ b[:, : cuts[0]].T
    i, j = np.nonzero(first + sa[0][:, None] * sb[0][None, :] >= threshold - SLACK)
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        total = first[p, q]
        for n in range(1, len(cuts)):
            part = slice(cuts[n - 1], cuts[n])
            total = total + np.einsum("ij,ij->i", a[p, part], b[q, part])
            ok = total + sa[n][p] * sb[n][q] >= threshold - SLACK
            p, q, total = p[ok], q[ok], total[ok]
        yield p, q


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that pairs (i, j) reach from each of n."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _tile(axes: dict[int, np.ndarray], threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("side", kind="stable").reset_index(drop=True)
        raw = np.array(rows["embedding"].tolist(), np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        norm = np.linalg.norm(raw, axis=1)
        turned = (raw / norm[:, None]) @ axes[raw.shape[1]] if raw.shape[1] in axes else raw / norm[:, None]
        weight, node = rows["weight"].to_numpy(np.int64), rows["node"].to_numpy(np.int64)
        same = not (rows["side"] > 0).any()
        if same and (rows["whole"] == 0).any():  # the other tile of the pair has no row
            return pd.DataFrame({"node": node[:0], "links": weight[:0], "root": node[:0]})
        n = len(rows) if same else int((rows["side"] == 0).sum())
        at = 0 if same else n
        links, found_i, found_j = np.zeros(len(rows), np.int64), [], []
        for i, j in _survivors(turned[:n], turned[at:], threshold):
            j = j + at
            if same:
                i, j = i[i < j], j[i < j]
            sure = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= threshold
            i, j = i[sure], j[sure]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            # of these links, a star for each set that they join
            root = _roots(len(rows), i, j)
            own = np.flatnonzero(root != np.arange(len(rows)))
            found_i.append(own)
            found_j.append(root[own])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))
        root = _roots(len(rows), i, j)
        some = links > 0
        return pd.DataFrame({"node": node[some], "links": links[some], "root": node[root[some]]})

    return run


def near_vectors(df: DataFrame, threshold: float = 0.98, tile: int = TILE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = df.sparkSession
    ship(spark)
    own = df.select(df[vec_id].cast("long").alias("vec_id"), df[embedding].cast("array<double>").alias("embedding"), df[label].alias("label"))
    rows = own.withColumn("_valid", valid("embedding", "label"))
    # a class whose vectors have no id gets a number that no id has
    named = F.coalesce(F.min("vec_id"), F.lit(NO_ID) + F.pmod(F.xxhash64("label", "embedding"), F.lit(NO_ID)))
    classes = rows.filter("_valid").groupBy("label", "embedding").agg(named.alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("d", F.size("embedding"))
    classes = written(classes, "vectors")
    width = math.sqrt(max(2 - 2 * threshold, 1e-6)) * (1 + 1e-9) + SLACK
    axes, cut = _axes(classes, width)
    celled = classes.select("embedding", "label", "node", "weight", "d")
    celled = written(celled.mapInArrow(_celled(axes, cut, width), T.StructType([*celled.schema.fields, T.StructField("cell", T.LongType())])), "cells")
    # the tiles of each cell, and of the cells that it touches; at most as many rows as there are cells
    sizes = celled.groupBy("label", "d", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    near = sizes.select("label", "d", F.explode(F.array(*(F.lit(o).cast("long") for o in offsets(cut)))).alias("o"), F.col("cell").alias("to"), "tiles").withColumn("cell", F.expr("to - o"))
    around = near.groupBy("label", "d", "cell").agg(F.collect_list(F.struct("o", "to", "tiles")).alias("near"), F.max(F.when(F.col("o") == 0, F.col("tiles"))).alias("here"))
    around = written(around.filter("here is not null"), "around")
    placed = celled.join(small_side(around), ["label", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("here")).cast("int"))
    # a pair of tiles: (lower cell, its tile, higher cell, its tile); side 0 or 1, and whole for a tile's pair with itself
    pairs = F.expr("""
        flatten(transform(near, n -> transform(sequence(0, n.tiles - 1), t -> case
          when n.o = 0 then named_struct('c', cell, 's', least(t, tile), 'e', cell, 't', greatest(t, tile), 'side', if(t < tile, 1, 0), 'whole', if(t = tile, 1, 0))
          when n.o > 0 then named_struct('c', cell, 's', tile, 'e', n.to, 't', t, 'side', 0, 'whole', 0)
          else named_struct('c', n.to, 's', t, 'e', cell, 't', tile, 'side', 1, 'whole', 0) end)))
    """)
    dealt = placed.withColumn("p", F.explode(pairs)).select("label", "d", "p.*", "embedding", "node", "weight")
    found = written(dealt.groupBy("label", "d", "c", "s", "e", "t").applyInPandas(_tile(axes, threshold), "node long, links long, root long"), "near")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = F.coalesce("component", "node")
    told = classes.join(counts, "node", "left").join(joined, "node", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(component < NO_ID, component).alias("component_id")
    )
    linked = rows.filter("_valid").join(told, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not _valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
