"""Documents ranked by BM25, with blocks of documents ruled out by what they can score at most.

The index is two tables: postings (term, block, doc_id, impact) and the greatest impact of each term in
each block of BLOCK_DOCS documents. A query's rarest terms are scored first; the k-th best of those sums
is a score that the k-th result has at least. Blocks whose greatest impacts sum to less are ruled out, and
only postings of the others are read and summed. All of that is joins and aggregates.

top_k() answers a stated set of queries at once and builds no index: see there.

Impacts are whole numbers (millionths), so that sums don't depend on their order and ties are ties.

Defined results: a null text has no terms; terms are runs of letters and digits, in lower case; a query's
term counts once; documents without an id are left out, and rows with one id are one document; a query
without a known term finds nothing; ties go by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.operators.retrieval import BLOCK_QUERIES, held
from estimora.sources.shared import file_system, new_path

K1, B = 1.2, 0.75
#: Documents of a block, millionths of an impact, and postings that a query's first terms have at least, in units of k.
BLOCK_DOCS, UNIT, FIRST_POSTINGS = 64, 1e6, 8
#: Bytes of numbered documents that a task of top_k() holds, cells of a matrix, and what a found term adds to an
#: impact, so that a sum of impacts that are 0 differs from no term: sums below 2^32 stay exact.
HELD_BYTES, CELLS, FOUND = 4_000_000, 4_000_000, 2.0**-20


@dataclass
class Index:
    """Paths of the tables: postings, maxima and terms (with the number of each one's documents)."""

    postings: str
    maxima: str
    terms: str


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def build(docs: DataFrame) -> Index:
    """An index of docs(doc_id, text), written to the shared folder."""
    spark = docs.sparkSession
    each = docs.filter("doc_id IS NOT NULL").select("doc_id", F.explode(terms_of(F.col("text"))).alias("term"))
    counted = new_path(spark, "counts")
    each.groupBy("doc_id", "term").agg(F.count("*").alias("tf")).write.parquet(counted)
    counts = spark.read.parquet(counted)
    lengths = counts.groupBy("doc_id").agg(F.sum("tf").alias("length"))
    n, total = lengths.agg(F.count("*"), F.sum("length")).first()
    mean = (total or 0) / max(n, 1)
    index = Index(*(new_path(spark, x) for x in ("postings", "maxima", "terms")))
    counts.groupBy("term").agg(F.count("*").alias("df")).write.parquet(index.terms)
    df = F.col("df")
    idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(mean or 1.0)))
    impact = F.round(idf * weight * UNIT).cast("long")
    rows = counts.join(lengths, "doc_id").join(spark.read.parquet(index.terms), "term")
    rows = rows.select("term", F.floor(F.col("doc_id") / BLOCK_DOCS).alias("block"), "doc_id", impact.alias("impact"))
    # files hold runs of terms, so that a query's terms leave most of them out
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.parquet(index.postings)
    spark.read.parquet(index.postings).groupBy("term", "block").agg(F.max("impact").alias("most")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(index.maxima)
    return index


def _summed(postings: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score and rank of the k best sums of impacts."""
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    sums = postings.groupBy("query_id", "doc_id").agg(F.sum("impact").alias("score"))
    return sums.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def open_blocks(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """query_id and block of those that may hold one of the k best for wanted(query_id, term, df)."""
    spark = wanted.sparkSession
    postings, maxima = spark.read.parquet(index.postings), spark.read.parquet(index.maxima)
    before = W.Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.Window.unboundedPreceding, -1)
    first = wanted.withColumn("before", F.coalesce(F.sum("df").over(before), F.lit(0))).filter(F.col("before") < FIRST_POSTINGS * k)
    kth = _summed(postings.join(first.select("query_id", "term"), "term"), k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("least"))
    can = maxima.join(wanted.select("query_id", "term"), "term").groupBy("query_id", "block").agg(F.sum("most").alias("most"))
    return can.join(kth, "query_id").filter("most >= least").select("query_id", "block")


def wanted_terms(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, term and df of the known terms of queries(query_id, text)."""
    asked = queries.filter("query_id IS NOT NULL").select("query_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    return asked.join(queries.sparkSession.read.parquet(index.terms), "term")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score (in millionths) and rank of the k documents with the highest BM25 scores."""
    spark = queries.sparkSession
    kept, blocks = new_path(spark, "wanted"), new_path(spark, "blocks")
    wanted_terms(index, queries).write.parquet(kept)
    wanted = spark.read.parquet(kept)
    open_blocks(index, wanted, k).write.parquet(blocks)
    postings = spark.read.parquet(index.postings).join(wanted.select("query_id", "term"), "term").join(spark.read.parquet(blocks), ["query_id", "block"], "left_semi")
    return _summed(postings, k)


def _tables(folder: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of the Parquet files of a shared folder, in the order of their names."""
    from pyarrow import fs, parquet

    store, base = file_system(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                yield from parquet.ParquetFile(file).iter_batches(BLOCK_QUERIES, columns=columns)


def _ordered(folder: str) -> pa.Array:
    """The asked terms in their order: a term's number is its place."""
    return pa.Table.from_batches(list(_tables(folder, ["term"])), pa.schema([("term", pa.string())])).sort_by("term").column("term").combine_chunks()


def _blocks(folder: str, terms: pa.Array, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, the numbers of the terms that a block of queries asks for, and a matrix of 1 where a
    query (column) asks for a term (row)."""
    for block in _tables(folder, ["query_id", "terms"]):
        step = max(1, cells // max(1, len(terms)))
        for a in range(0, block.num_rows, step):
            part = block.slice(a, step)
            asked = part.column("terms")
            at = pc.index_in(asked.flatten(), value_set=terms).to_numpy(zero_copy_only=False)
            numbers, row = np.unique(at, return_inverse=True)
            wanted = np.zeros((len(numbers), part.num_rows))
            wanted[row, np.repeat(np.arange(part.num_rows), pc.list_value_length(asked).to_numpy())] = 1
            yield part.column("query_id").to_numpy(), numbers, wanted


def _numbered(docs: DataFrame, asked: str) -> DataFrame:
    """doc_id, the number of all its terms, and the places in `asked` of those that are asked for, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _ordered(asked)
        for batch in batches:
            words = batch.column("terms")
            lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            at = pc.index_in(words.flatten(), value_set=terms)
            found = pc.is_valid(at).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(found)])[np.concatenate([[0], np.cumsum(lengths)])]
            kept = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), at.drop_null())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), kept], ["doc_id", "length", "terms"])

    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), terms_of(F.col("text")).alias("terms")).mapInArrow(run, "doc_id long, length long, terms array<int>")


def _scored(batches: Iterator[pa.RecordBatch], asked: str, known: str, queries: str, mean: float, k: int, most: int, cells: int) -> Iterator[pa.RecordBatch]:
    """query_id, doc_id and score of what may be among a query's k best: a document that scores less
    than k others of the task is left out."""
    terms = _ordered(asked)
    idf = np.zeros(len(terms))
    for batch in _tables(known, ["number", "idf"]):
        idf[batch.column("number").to_numpy()] = batch.column("idf").to_numpy()
    best: list[np.ndarray] = []  # of each block: the k best scores of its queries so far, ascending
    for table in held(batches, most):
        table = table.sort_by("doc_id")
        doc_ids, lengths = table.column("doc_id").to_numpy(), table.column("length").to_numpy().astype(np.float64)
        lists = table.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(doc_ids)), pc.list_value_length(lists).to_numpy())
        pair, tf = np.unique(doc * max(1, len(terms)) + lists.flatten().to_numpy(), return_counts=True)
        doc, term = np.divmod(pair, max(1, len(terms)))
        weight = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * lengths[doc] / mean))
        exact = idf[term] * weight * UNIT
        impact = np.floor(exact)
        impact += (exact - impact >= 0.5) + FOUND
        for b, (query_ids, numbers, wanted) in enumerate(_blocks(queries, terms, cells)):
            if b == len(best):
                best.append(np.zeros((k, len(query_ids))))
            row = np.full(len(terms), -1)
            row[numbers] = np.arange(len(numbers))
            mine = np.flatnonzero(row[term] >= 0)
            at, of, worth = doc[mine], row[term[mine]], impact[mine]
            step = max(1, cells // max(1, *wanted.shape))
            for a in range(0, len(doc_ids), step):
                lo, hi = np.searchsorted(at, (a, a + step))
                if lo == hi:
                    continue
                some, place = np.unique(at[lo:hi], return_inverse=True)  # documents with an asked term
                matrix = np.zeros((len(some), len(numbers)))
                matrix[place, of[lo:hi]] = worth[lo:hi]
                scores = matrix @ wanted
                least = np.maximum(best[b][0], FOUND / 2)
                can = scores >= least
                if np.count_nonzero(can) > 4 * k * len(query_ids) and len(some) > k:
                    can = scores >= np.maximum(least, np.floor(np.partition(scores, -k, axis=0)[-k]))
                query, hit = np.nonzero(can.T)
                score = np.floor(scores[hit, query])
                order = np.lexsort((hit, -score, query))
                query, hit, score = query[order], hit[order], score[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                query, hit, score, rank = (x[rank < k] for x in (query, hit, score, rank))
                if len(query):
                    new = np.zeros((k, len(query_ids)))
                    new[rank, query] = score
                    best[b] = np.sort(np.concatenate([best[b], new]), axis=0)[k:]
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[query]), pa.array(doc_ids[some[hit]]), pa.array(score.astype(np.int64))], ["query_id", "doc_id", "score"])


def top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What search() finds for a stated set of queries(query_id, text) among all docs(doc_id, text),
    without an index of the other terms. Terms are numbered once, where the documents lie; each task
    then sums impacts of its own documents and sends k of them for a query, and fewer once it has k. So
    what moves grows with tasks and queries, not with pairs of a query and a posting. Every task reads
    the queries' terms; neither side passes through the driver."""
    spark = docs.sparkSession
    asked, terms, numbered, known = (new_path(spark, x) for x in ("asked", "terms", "numbered", "known"))
    each = queries.filter("query_id IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.explode(terms_of(F.col("text"))).alias("term"))
    each.groupBy("query_id").agg(F.collect_set("term").alias("terms")).write.parquet(asked)
    spark.read.parquet(asked).select(F.explode("terms").alias("term")).distinct().write.parquet(terms)
    _numbered(docs, terms).write.parquet(numbered)
    rows = spark.read.parquet(numbered)
    if rows.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id").agg(F.sum("length").alias("length"), F.flatten(F.collect_list("terms")).alias("terms"))
    n, total = rows.filter("length > 0").agg(F.count("*"), F.sum("length")).first()
    df = F.col("df")
    idf = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5) + 1)
    counts = rows.select(F.explode(F.array_distinct("terms")).alias("number")).groupBy("number").agg(F.count("*").alias("df"))
    counts.select("number", idf.alias("idf")).write.parquet(known)
    mean = (total or 0) / max(n, 1) or 1.0
    most, cells = HELD_BYTES, CELLS
    found = rows.filter("size(terms) > 0").mapInArrow(lambda batches: _scored(batches, terms, known, asked, mean, k, most, cells), "query_id long, doc_id long, score long")
    w = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
