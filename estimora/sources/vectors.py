"""A namespace of vectors that is changed in place of being written anew.

Rows lie in buckets by the hash of their source. A version is a small file that names the folder of
each bucket; the highest number counts. An upsert compares digests of chunks with those that are there,
embeds only the chunks that are new or changed, writes the buckets that hold a change to a new folder,
and adds a version last. So readers see the version before or the one after, and a run that fails
leaves folders that no version names, which vacuum() deletes. Of two writers at once, one raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estimora.sources.corpus import vector_table
from estimora.sources.shared import file_system, new_path

#: Buckets of a namespace.
BUCKETS = 64
COLUMNS = ("id", "doc_id", "chunk_no", "text", "source", "category", "filename", "digest", "embedding")
SCHEMA = "id string, doc_id string, chunk_no int, text string, source string, category string, filename string, digest string, embedding array<float>"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folder(path: str, namespace: str) -> str:
    return f"{path}/namespace={quote(namespace, safe='')}"


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, at = _hadoop(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def version(spark: SparkSession, path: str, namespace: str = "knowledge-base") -> tuple[int, dict[str, str]]:
    """The number of the last version, 0 if there is none, and the folder of each bucket."""
    last, _, buckets = _versions(spark, path, namespace)
    return last, buckets


def _versions(spark: SparkSession, path: str, namespace: str) -> tuple[int, int, dict[str, str]]:
    """The last version, the one that counts, and its folders. A file that isn't whole is of a run that
    broke off, or that isn't ready: the version before counts."""
    folder = _folder(path, namespace)
    numbers = sorted((int(n.removeprefix("version-")) for n in _names(spark, folder) if n.startswith("version-")), reverse=True)
    for number in numbers:
        fs, at = _hadoop(spark, f"{folder}/version-{number:010d}")
        stream = fs.open(at)
        try:
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("}\n"):
            return numbers[0], number, json.loads(text)
    return max(numbers, default=0), 0, {}


def _published(spark: SparkSession, folder: str, number: int, buckets: dict[str, str]) -> None:
    fs, at = _hadoop(spark, f"{folder}/version-{number:010d}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as e:
        raise RuntimeError("another run has changed the namespace meanwhile") from e
    out.write(bytearray((json.dumps(buckets) + "\n").encode()))
    out.close()


def _read(spark: SparkSession, folder: str, buckets: dict[str, str]) -> DataFrame:
    paths = [f"{folder}/{where}/bucket={k}" for k, where in sorted(buckets.items())]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def current(spark: SparkSession, path: str, namespace: str = "knowledge-base") -> DataFrame:
    """The rows of a namespace as they are now, whatever runs change later on."""
    return _read(spark, _folder(path, namespace), version(spark, path, namespace)[1])


def _bucket():
    return F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")


def _without(rows: DataFrame, stale: str) -> DataFrame:
    """rows with their bucket, but for the ids that the folder `stale` has of it. Rows stay where they are
    read, which is by bucket: a task holds the ids of one bucket at a time."""

    def ids(bucket: int) -> pa.ChunkedArray:
        from pyarrow import fs, parquet

        store, base = file_system(f"{stale}/bucket={bucket}")
        found = [f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.path.endswith(".parquet")]
        return pa.chunked_array([c for f in found for c in parquet.ParquetFile(store.open_input_file(f)).read(columns=["id"]).column("id").chunks], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for bucket in batch.column("bucket").unique().to_pylist():
                if bucket != at:
                    at, held = bucket, ids(bucket)
                mine = batch.filter(pc.equal(batch.column("bucket"), bucket))
                yield mine.filter(pc.invert(pc.is_in(mine.column("id"), value_set=held)))

    return rows.mapInArrow(run, f"{SCHEMA}, bucket int")


def upsert(chunks: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], namespace: str = "knowledge-base", sources: DataFrame | None = None) -> dict[str, int]:
    """Make the namespace hold chunks(doc_id, chunk_no, text, source, category, filename) in place of
    what it has of `sources`(source), or of anything if that is None. `embed` adds an embedding to rows
    with a text. Returns how many rows were embedded, removed and left as they are."""
    spark, folder = chunks.sparkSession, _folder(path, namespace)
    number, buckets = version(spark, path, namespace)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws("\x1f", *(text(c) for c in ("text", "source", "category", "filename"))), 256)
    written, changed, left = (new_path(spark, x) for x in ("chunks", "fresh", "stale"))
    vector_table(chunks).select("id", F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_no").cast("int").alias("chunk_no"), "text", "source", "category", "filename", digest.alias("digest")).write.parquet(written)
    new, known = spark.read.parquet(written), _read(spark, folder, buckets).select("id", "source", "digest")
    if new.groupBy("id").count().filter("count > 1").limit(1).count():  # only ids are moved to know that
        once = new_path(spark, "chunks")
        new.dropDuplicates(["id"]).write.parquet(once)
        new = spark.read.parquet(once)
    fresh = new
    if buckets:
        new.select("id", "source", "digest").join(known, ["id", "digest"], "left_anti").select("id", "source").write.parquet(changed)
        fresh = new.join(spark.read.parquet(changed).select("id"), "id", "left_semi")
    ids = spark.read.parquet(changed) if buckets else new.select("id", "source")
    scope = known if sources is None else known.join(sources.select("source").distinct(), "source", "left_semi")
    gone = scope.join(new, "id", "left_anti").select("id", "source", F.lit(True).alias("gone"))
    # a chunk that has changed is both embedded and removed; a moved one leaves its old bucket
    stale = gone.union(known.join(ids.select("id"), "id", "left_semi").select("id", "source", F.lit(False))).withColumn("bucket", _bucket())
    stale.repartition("bucket").write.partitionBy("bucket").parquet(left)
    stale = spark.read.schema("id string, source string, gone boolean, bucket int").parquet(left)
    touched = sorted(r["b"] for r in ids.select(_bucket().alias("b")).union(stale.select("bucket")).distinct().collect())
    counts = {"embedded": ids.count(), "removed": stale.filter("gone").count()}
    counts["kept"] = known.count() - stale.count()
    if not touched:
        return counts
    where = f"data-{uuid.uuid4().hex}"
    mine = _read(spark, folder, {k: v for k, v in buckets.items() if int(k) in touched})
    kept = _without(mine.select(*COLUMNS).withColumn("bucket", _bucket()), left)
    # tasks by bucket and part of it, so that a bucket with a hot source isn't one task; vectors are made
    # where their rows are written, as they are longer than texts
    parts = F.pmod(F.xxhash64("id"), F.lit(8))
    dealt = fresh.repartition(_bucket(), parts)
    kept.unionByName(embed(dealt).select(*COLUMNS).withColumn("bucket", _bucket())).write.partitionBy("bucket").parquet(f"{folder}/{where}")
    filled = {n.partition("=")[2] for n in _names(spark, f"{folder}/{where}") if n.startswith("bucket=")}
    after = {k: v for k, v in buckets.items() if int(k) not in touched} | {k: where for k in filled}
    _published(spark, folder, number + 1, after)
    return counts


def vacuum(spark: SparkSession, path: str, namespace: str = "knowledge-base") -> int:
    """Delete what the version that counts doesn't name, once nothing reads it; the number of entries."""
    folder = _folder(path, namespace)
    _, number, buckets = _versions(spark, path, namespace)
    old = [n for n in _names(spark, folder) if n.startswith("data-") and n not in buckets.values() or n.startswith("version-") and int(n.removeprefix("version-")) < number]
    for name in old:
        fs, at = _hadoop(spark, f"{folder}/{name}")
        fs.delete(at, True)
    return len(old)
