"""Exact near-duplicate classes of vectors by a metric range join.

Vectors of one label and length are projected to the unit sphere, where cosine >= c means a
distance of at most r = sqrt(2 - 2c). Pivots split each label into cells by the nearest pivot. A
vector x of cell i can only reach cell j if it is within r of it: by the triangle inequality
d(x, p_j) <= d(x, p_i) + 2r, and in Euclidean space also (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j))
<= r. It is copied to the cells j < i that pass both, so each pair meets in one cell, and
cells join independently: a cell's own vectors with each other and with the copies, in pairs of
blocks; copies are never compared with copies. Equal vectors are one entry with a weight, and what
leaves a pair of blocks is a count and a representative for each vector, so results grow as the
vectors do.

In many dimensions vectors that aren't clustered are almost equally far from all pivots; the
copies then amount to comparing each label's vectors block by block once, which is what exactness
costs. Pivots are MOST_PIVOTS at most over all labels, however many vectors there are; cells that
grow beyond CELL_ROWS for it have more blocks.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, or
has a null label or a null id, links with nothing (a null id has a null component, too); equal
vectors link with each other; rows that share an id are one vector each, whose links count, in
one component; vectors of different lengths never link; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.llm.components import connected
from estimora.llm.shared import bounded, dropped, saved

#: Vectors of a cell that are aimed at, and of a block at most (about); pivots over all labels at most.
CELL_ROWS, BLOCK_ROWS, MOST_PIVOTS = 2000, 2000, 4096


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pivots(entries: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Unit vectors by label and length: one for every CELL_ROWS vectors, or of so many more that
    there are MOST_PIVOTS at most, by hash order."""
    w = W.Window.partitionBy("label", "dim").orderBy(F.xxhash64("rid"), "rid")
    sizes = {(r["label"], r["dim"]): r["n"] for r in entries.groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    each = max(CELL_ROWS, -(-sum(sizes.values()) // MOST_PIVOTS))
    sizes = {key: n for key, n in sizes.items() if n >= each}
    most = max([0, *sizes.values()]) // each
    if not most:
        return {}
    ranked = entries.select("label", "dim", "rid").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    wanted = F.create_map(*[F.lit(v) for (label, dim), n in sizes.items() for v in (f"{label}/{dim}", n // each)])
    ranked = ranked.filter(F.col("k") <= wanted[F.concat_ws("/", "label", "dim")]).select("rid")
    found: dict[tuple[int, int], list] = {}
    for r in entries.join(ranked, "rid").select("label", "dim", "x").toLocalIterator():
        found.setdefault((r["label"], r["dim"]), []).append(r["x"])
    return {k: unit(np.array(sorted(v))) for k, v in found.items()}


def cells(entries: DataFrame, radius: float) -> DataFrame:
    """entries with cell and home: the own cell of each, and copies in the cells it may reach."""
    shared = entries.sparkSession.sparkContext.broadcast(pivots(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "dim"))
            for key in {*zip(label.tolist(), dim.tolist(), strict=True)}:
                rows = np.flatnonzero((label == key[0]) & (dim == key[1]))
                part = batch.take(pa.array(rows))
                p = shared.value.get(key)
                if p is None or len(p) < 2:
                    take, cell, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
                else:
                    d2 = np.maximum(2 - 2 * unit(matrix(part.column("x"), key[1])) @ p.T, 0)
                    own = np.argmin(d2, axis=1)
                    d2_own = d2[np.arange(len(rows)), own][:, None]
                    used, which = np.unique(own, return_inverse=True)
                    between = np.sqrt(np.maximum(2 - 2 * p[used] @ p.T, 0))[which]
                    reach = (np.sqrt(d2) <= np.sqrt(d2_own) + 2 * radius + 1e-6) & (d2 - d2_own <= 2 * radius * between + 1e-6)
                    reach &= np.arange(len(p)) <= own[:, None]
                    reach[np.arange(len(rows)), own] = True
                    take, cell = np.nonzero(reach)
                    home = cell == own[take]
                out = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell.astype(np.int32)), pa.array(home)], [*out.schema.names, "cell", "home"])

    kind = dict(entries.dtypes)["x"]
    return bounded(entries).mapInArrow(run, f"rid long, label long, dim int, weight long, x {kind}, cell int, home boolean")


def block_links(least: float):
    """A function of one pair of blocks: for each vector with links, their weight and a representative."""

    def run(table: pa.Table) -> pa.Table:
        rid, weight, home, block = (table.column(c).to_numpy() for c in ("rid", "weight", "home", "block"))
        a, b, dim, met = (table.column(c)[0].as_py() for c in ("a", "b", "dim", "copies"))
        x = unit(matrix(table.column("x").combine_chunks(), dim))
        linked, total = np.zeros((len(x), len(x)), bool), np.zeros(len(x), np.int64)
        # the two sides: a cell's own vectors and copies, or two blocks of own ones, or one with itself
        rows, columns = (np.flatnonzero(home), np.flatnonzero(~home)) if met else (np.flatnonzero(block == a), np.flatnonzero(block == b))
        for at in range(0, len(rows), 512):
            some = rows[at : at + 512]
            part = (x[some] @ x[columns].T >= least) & (some[:, None] != columns)
            linked[np.ix_(some, columns)] = part
            total[some] += part @ weight[columns]
            if met or a != b:
                linked[np.ix_(columns, some)] = part.T
                total[columns] += weight[some] @ part
        head, left = np.full(len(x), -1), linked.any(axis=1)
        for k in np.flatnonzero(left):
            if head[k] < 0:
                edge = np.zeros(len(x), bool)
                edge[k] = True
                while edge.any():
                    head[edge] = k
                    edge = linked[edge].any(axis=0) & (head < 0)
        keep = np.flatnonzero(left)
        return pa.table({"rid": rid[keep], "links": total[keep], "head": rid[head[keep]]})

    return run


def near_classes(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors(vec_id, embedding, label)."""
    e = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & F.exists(e, lambda v: v != 0) & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    every = vectors.select("vec_id", F.col("label").cast("long").alias("label"), e.alias("x"), F.coalesce(sound, F.lit(False)).alias("sound"))
    every = every.withColumns({"dim": F.size("x"), "h1": F.when(F.col("sound"), F.xxhash64("x")), "h2": F.when(F.col("sound"), F.xxhash64(F.lit(1), "x"))})
    same = ["label", "dim", "h1", "h2"]
    entries = every.filter("sound").groupBy(*same).agg(F.min("vec_id").alias("rid"), F.count("*").alias("weight"), F.first("x").alias("x"))
    entries = saved(entries, "entries")

    placed = saved(cells(entries.select("rid", "label", "dim", "weight", "x"), (2 - 2 * least) ** 0.5), "cells")
    key = ["label", "dim", "cell"]
    blocks_of = lambda own: F.ceil(F.count(F.when(F.col("home") == own, 1)) / BLOCK_ROWS).cast("int")
    blocks = placed.groupBy(*key).agg(blocks_of(True).alias("own"), blocks_of(False).alias("others"))
    dealt = placed.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rid"), F.when(F.col("home"), F.col("own")).otherwise(F.col("others"))).cast("int"))
    # pairs of blocks: of a cell's own vectors (a <= b), and of own ones (a) and copies (b)
    pair = lambda a, b, copies: F.struct(a.alias("a"), b.alias("b"), F.lit(copies).alias("copies"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own, mine = F.transform(upto("own"), lambda k: pair(F.least(F.col("block"), k), F.greatest(F.col("block"), k), False)), F.col("block")
    across = F.transform(upto("others"), lambda k: pair(mine, k, True))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("home"), F.concat(own, across)).otherwise(F.transform(upto("own"), lambda k: pair(k, mine, True))))).select("*", "pair.*").drop("own", "others", "pair")
    met = saved(dealt.groupBy(*key, "a", "b", "copies").applyInArrow(block_links(least), "rid long, links long, head long"), "met")
    links = met.groupBy("rid").agg(F.sum("links").alias("links"))
    star = connected(met.select(F.col("rid").alias("a"), F.col("head").alias("b")))
    known = entries.select(*same, "rid", "weight").join(links, "rid", "left").join(star.withColumnRenamed("node", "rid"), "rid", "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rid").alias("c"))
    out = every.select("vec_id", *same).join(known, same, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"))
    dropped(placed)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
