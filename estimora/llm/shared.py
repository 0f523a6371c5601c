"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.sources.shared import file_system, new_path, shared_dir

__all__ = ["bounded", "dropped", "file_system", "joined_by_id", "new_path", "saved", "scope", "shared_dir", "unused"]


_scopes: list[list[DataFrame]] = []


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Tables that saved() writes within are deleted at the end, but for those taken off the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.pop()
        for df in made:
            dropped(df)


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: the lineage ends there, and a
    lost executor costs a read instead of the work before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete what saved() wrote, once nothing reads it any more."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_saved_path", None)
    if path:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of texts that go to Python at once, at most: a batch is held several times over on its way.
ARROW_ROWS = 1000


def bounded(texts: DataFrame) -> DataFrame:
    """The same rows, for a step in Python. The session's batches are cut to ARROW_ROWS rows where they
    are longer: Spark's own bound of 64 MB a batch would be held several times over by each worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(texts.sparkSession.conf.get(key))
    if not 0 < now <= ARROW_ROWS:
        texts.sparkSession.conf.set(key, str(ARROW_ROWS))
    return texts


#: Ids that are sent to all executors at most, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def joined_by_id(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """A left semi or anti join with a saved table of distinct ids, broadcast only if it is small."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, key, how)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    known = {c.lower() for c in docs.columns}
    while name in known:
        name += "_"
    return name
