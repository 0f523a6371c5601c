"""Similarity search over vectors, and the context that is made of what it finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.sources.shared import file_system, new_path

#: Queries that a task reads at once, bytes of vectors that it holds, and scores that it computes at once.
BLOCK_QUERIES, HELD_BYTES, SCORES_AT_ONCE = 1024, 8_000_000, 1_000_000


def unit_rows(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: ids in ascending order, and rows of unit length in double precision.
    Vectors that are null, zero, or hold a null or non-finite component aren't among them."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        flat = vectors.take(pa.array(at)).flatten()
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        norms = np.linalg.norm(x, axis=1)
        sound = np.isfinite(norms) & (norms > 0)
        known = ids.to_numpy(zero_copy_only=False)[at][sound]
        order = np.argsort(known, kind="stable")
        rows = np.flatnonzero(sound)[order]
        x = x[rows]
        x /= norms[rows, None]  # in place: a task holds few copies of its vectors
        out[width] = known[order], x
    return out


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, of equal ones those of the first columns."""
    if scores.shape[1] > k:
        rows, columns = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k, None])
    else:
        rows, columns = np.divmod(np.arange(scores.size), max(1, scores.shape[1]))
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], columns[rank < k]


def held(batches: Iterator[pa.RecordBatch], most: int = HELD_BYTES) -> Iterator[pa.Table]:
    """Tables of some `most` bytes: small batches are put together, large ones are cut."""
    some, size = [], 0
    for whole in batches:
        step = max(1, whole.num_rows * most // max(1, whole.nbytes))
        for a in range(0, max(1, whole.num_rows), step):
            batch = whole.slice(a, step)
            some.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(some).combine_chunks()
                some, size = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks()


def read_queries(folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs, parquet

    store, base = file_system(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                yield from parquet.ParquetFile(file).iter_batches(BLOCK_QUERIES, columns=["query_id", "query"])


def top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score and rank of the k nearest vectors(vec_id, embedding) by cosine to each
    of queries(query_id, query); ties by id. A stated set of queries against all rows: it is written
    to the shared folder, and each task reads it block by block for the vectors that it holds, keeps
    k of them for a query, and only these are moved. Neither side passes through the driver. Null,
    zero and non-finite vectors and queries, and vectors of another length, have no cosine."""
    folder = new_path(queries.sparkSession, "queries")
    queries.select("query_id", "query").write.parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in held(batches):
            if not table.num_rows:
                continue
            known = unit_rows(table.column("vec_id").combine_chunks(), table.column("embedding").combine_chunks())
            for block in read_queries(folder):
                for width, (query_ids, asked) in unit_rows(block.column("query_id"), block.column("query")).items():
                    vec_ids, x = known.get(width, (None, None))
                    if vec_ids is None or not len(vec_ids):
                        continue
                    step = max(1, SCORES_AT_ONCE // len(vec_ids))
                    for a in range(0, len(query_ids), step):
                        scores = asked[a : a + step] @ x.T
                        rows, at = best(scores, k)
                        yield pa.RecordBatch.from_arrays([pa.array(query_ids[a + rows]), pa.array(vec_ids[at]), pa.array(scores[rows, at])], ["query_id", "vec_id", "score"])
            del table, known
            pa.default_memory_pool().release_unused()

    found = vectors.filter("vec_id IS NOT NULL").select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double")
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def context(hits: DataFrame) -> DataFrame:
    """query_id, context and sources of hits(query_id, rank, text, category, filename): numbered
    passages in rank order, and the distinct sources in order. Groups hold k rows."""
    category, name = F.coalesce("category", F.lit("General")), F.coalesce("filename", F.lit("Unknown"))
    found = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", category.alias("category"), name.alias("filename"), "text"))).alias("found"),
        F.array_sort(F.collect_set(F.concat(F.lit("["), category, F.lit("] "), name))).alias("sources"),
    )
    passage = lambda x, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(" — "), x["category"], F.lit(": "), x["filename"], F.lit("]\n"), x["text"])
    return found.select("query_id", F.array_join(F.transform("found", passage), "\n\n---\n\n").alias("context"), "sources")
