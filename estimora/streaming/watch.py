"""A watched folder: changes of its files go to the table of vectors as they happen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from estimora.operators.chunking import chunked
from estimora.operators.embedding import hashed
from estimora.sources import document_files, vectors

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "source string, filename string, category string, page int, text string, error string, vanished boolean"


class Digests(StatefulProcessor):
    """Keeps the digest of each file, and hands on what has another one: a file that was only touched is
    no change. Of a file that vanished only that is handed on, and its state goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.digest = handle.getValueState("digest", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))  # the pages of one file
        if found["vanished"].any():
            known = self.digest.exists()
            self.digest.clear()
            found = found.head(1) if known else found.head(0)
        else:
            now = found["digest"].iloc[0] or ""
            if self.digest.exists() and self.digest.get()[0] == now:
                found = found.head(0)
            else:
                self.digest.update((now,))
        if len(found):
            out = found[["filename", "category", "page", "text", "error", "vanished"]].copy()
            out.insert(0, "source", key[0])
            out["page"] = out["page"].astype("Int32")
            yield out

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str, state: str, loaders=None, **options) -> DataFrame:
    """A stream of the files under `root` whose contents have changed; `state` is a folder for listings."""
    document_files.register(spark, loaders)
    rows = spark.readStream.format("document_files").options(state=state, **options).load(root)
    return rows.groupBy("source").transformWithStateInPandas(Digests(), SCHEMA, "Append", "None")


def chunks_of(documents: DataFrame) -> DataFrame:
    """doc_id, chunk_no, text, source, category and filename of documents' pages."""
    paged = documents.withColumn("doc_id", F.concat_ws("#", "source", "page"))
    cut = chunked(paged).withColumnRenamed("chunk", "text")
    return cut.join(paged.select("doc_id", "source", "category", "filename"), "doc_id")


def ingested(spark: SparkSession, root: str, path: str, embed: Callable[[DataFrame], DataFrame] = hashed, loaders=None, **where) -> dict[str, int]:
    """Make the vectors at `path` those of the files under `root`, embedding only chunks that are new."""
    documents, _ = document_files.read_documents(spark, root, loaders)
    return vectors.upsert(chunks_of(documents), path, embed, **where)


def watched(spark: SparkSession, root: str, path: str, state: str, embed: Callable[[DataFrame], DataFrame] = hashed, loaders=None, trigger: dict | None = None, told: Callable[[dict], None] | None = None) -> StreamingQuery:
    """Follow the files under `root`: chunks of changed files take the place of their old ones, those of
    files that vanished or can't be read any more go. A batch that runs again changes nothing more, as
    equal chunks aren't embedded twice. State is kept in RocksDB, which the session is set to."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            counts = vectors.upsert(chunks_of(rows.filter("text IS NOT NULL")), path, embed, sources=rows.select("source").distinct())
            if told:
                told(counts)
        finally:
            rows.unpersist()

    out = changes(spark, root, f"{state}/listings", loaders).writeStream.foreachBatch(batch)
    return out.option("checkpointLocation", f"{state}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
