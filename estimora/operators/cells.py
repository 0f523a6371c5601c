"""Exact nearest vectors by cosine with fewer comparisons: vectors lie in cells, each with a centre and a
radius, and a query visits only the cells that may hold one of its k nearest.

By the triangle inequality no vector of a cell is nearer to a query than the distance to the centre less
the radius. A query first visits the cells with the least such bound until they hold k vectors; its k-th
best distance there rules out all cells whose bound is larger, and it visits the rest. Cells are folders
of files of a bounded number of rows. A pair of query and file goes to the task of that file, which reads
it once for all queries that want it, so vectors aren't shuffled.

Centres come from a sample of SAMPLE vectors, drawn by a hash of the id, and serve speed alone: every
vector is in the index, and results are exact wherever the centres lie.

Defined results: as top_k(): null, zero and non-finite vectors and queries have no cosine, nor have
vectors of another length than the sample's most frequent one; ties go by id; vectors without an id
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.operators.retrieval import BLOCK_QUERIES, SCORES_AT_ONCE, best, unit_rows
from estimora.sources.shared import file_system, new_path

#: Vectors that centres are fitted to at most, centres at most, rounds of fitting, and rows of a file.
SAMPLE, MOST_CELLS, ROUNDS, FILE_ROWS = 20_000, 512, 8, 20_000
#: Distances within this of a bound aren't ruled out by it.
SLACK = 1e-6


@dataclass
class Index:
    """Where the cells lie; centres, radii and numbers of vectors by cell, and names of files with the
    cell of each, all of a bounded size but for the names, of which there is one for FILE_ROWS vectors."""

    path: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


def centres_of(x: np.ndarray, most: int) -> np.ndarray:
    """Unit centres of unit rows: k-means by cosine from rows spread over the sample."""
    n = max(1, min(most, int(np.sqrt(len(x)))))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances between unit rows and centres."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ centres.T)))


def build(vectors: DataFrame, most_cells: int = MOST_CELLS) -> Index:
    """An index of vectors(vec_id, embedding), written to the shared folder."""
    spark = vectors.sparkSession
    known = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    drawn = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
    found = unit_rows(drawn.column("vec_id").combine_chunks(), drawn.column("embedding").combine_chunks()) if drawn.num_rows else {}
    width = max(found, key=lambda w: (len(found[w][0]), w), default=0)
    if not width:
        return Index("", np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64))
    centres = centres_of(found[width][1], most_cells)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = unit_rows(batch.column(0), batch.column(1)).get(width, (None, None))
            if ids is None or not len(ids):
                continue
            d = apart(x, centres)
            cell = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), pa.array(ids, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], ["cell", "distance", "vec_id", "unit"])

    path = new_path(spark, "cells")
    rows = known.mapInArrow(assigned, "cell int, distance double, vec_id long, unit array<double>")
    rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(16))).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(path)
    radii, sizes = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in spark.read.parquet(path).groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():
        radii[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
    return Index(path, centres, radii, sizes)


def _files(spark: SparkSession, index: Index) -> DataFrame:
    """cell and file of the index."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(index.path)
    cell = F.regexp_extract("path", r"cell=(\d+)/[^/]*$", 1).cast("int")
    return found.select(cell.alias("cell"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"))


def _visited(wanted: DataFrame, files: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, vec_id and score of the k best of each file that wanted(query_id, unit, cell) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        store, base = file_system(index.path)
        now, data = None, None

        for batch in batches:
            names = list(zip(batch.column("cell").to_pylist(), batch.column("file").to_pylist(), strict=True))
            cuts = [j for j in range(len(names)) if not j or names[j] != names[j - 1]] + [len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != now:
                    now = names[a]
                    with store.open_input_file(f"{base}/cell={now[0]}/{now[1]}") as f:
                        table = parquet.ParquetFile(f).read(["vec_id", "unit"]).combine_chunks()
                    ids = table.column("vec_id").to_numpy()
                    order = np.argsort(ids, kind="stable")
                    data = ids[order], table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
                ids, x = data
                asked = batch.column("unit")[a:b].flatten().to_numpy().reshape(b - a, -1)
                query_ids = batch.column("query_id")[a:b].to_numpy()
                step = max(1, SCORES_AT_ONCE // max(1, len(ids)))
                for at in range(0, b - a, step):
                    scores = asked[at : at + step] @ x.T
                    rows, columns = best(scores, k)
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[at + rows]), pa.array(ids[columns]), pa.array(scores[rows, columns])], ["query_id", "vec_id", "score"])

    each = wanted.join(F.broadcast(files) if index.sizes.sum() < FILE_ROWS * 10_000 else files, "cell")
    dealt = each.repartition("cell", "file").sortWithinPartitions("cell", "file").select("cell", "file", "query_id", "unit")
    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): query_id, vec_id, score and rank of the k nearest vectors to each of
    queries(query_id, query); and query_id, cell and n, the vectors of each cell that was visited."""
    spark = queries.sparkSession
    hits, visits = "query_id long, vec_id long, score double, rank int", "query_id long, cell int, n long"
    if not index.path:
        return spark.createDataFrame([], hits), spark.createDataFrame([], visits)
    width, centres, radii, sizes = index.centres.shape[1], index.centres, index.radii, index.sizes

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_QUERIES):
                some = batch.slice(at, BLOCK_QUERIES)
                ids, x = unit_rows(some.column(0), some.column(1)).get(width, (None, None))
                if ids is None or not len(ids):
                    continue
                bound = np.where(sizes > 0, np.maximum(0, apart(x, centres) - radii), np.inf)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                first = np.zeros_like(bound, bool)
                np.put_along_axis(first, order, before < k, axis=1)
                rows = [pa.array(ids, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))]
                rows += [pa.array(list(bound), pa.list_(pa.float64())), pa.array(list(first), pa.list_(pa.bool_()))]
                yield pa.RecordBatch.from_arrays(rows, ["query_id", "unit", "bounds", "first"])

    asked = new_path(spark, "asked")
    queries.filter("query_id IS NOT NULL").select("query_id", "query").mapInArrow(bounded, "query_id long, unit array<double>, bounds array<double>, first array<boolean>").write.parquet(asked)
    rows, files = spark.read.parquet(asked), _files(spark, index)
    every = rows.select("query_id", "unit", F.posexplode(F.arrays_zip("bounds", "first")).alias("cell", "c")).filter(F.col("c.bounds") < float("inf"))
    nearest = new_path(spark, "nearest")
    _ranked(_visited(every.filter("c.first").select("query_id", "unit", "cell"), files, index, k), k).write.parquet(nearest)
    found = spark.read.parquet(nearest)
    last = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    reach = last.select("query_id", F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0) - F.col("s") * 2)) + SLACK).alias("reach"))
    further = every.filter("NOT c.first").join(reach, "query_id").filter(F.col("reach").isNull() | (F.col("c.bounds") <= F.col("reach")))
    more = _visited(further.select("query_id", "unit", "cell"), files, index, k)
    known = spark.createDataFrame([(c, int(n)) for c, n in enumerate(sizes)], "cell int, n long")
    seen = every.filter("c.first").select("query_id", "cell").unionByName(further.select("query_id", "cell"))
    return _ranked(found.drop("rank").unionByName(more), k), seen.join(F.broadcast(known), "cell").select("query_id", "cell", "n")
