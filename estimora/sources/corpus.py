"""Documents from a folder, and the table of vectors that they become."""

from __future__ import annotations

import os
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes that have a loader, and the category of a folder name (fixed values).
TEXT_SUFFIXES = ("md", "txt")
CATEGORIES = (("standards", "Standard"), ("methodologies", "Methodology"), ("articles", "Article"), ("expert_knowledge", "Expert Knowledge"))
SCHEMA = "id string, doc_id string, chunk_no int, text string, source string, category string, filename string, embedding array<float>"


def category_of(path: Column) -> Column:
    """The category of the first folder in a path that has one, else General."""
    names = F.create_map(*(F.lit(x) for pair in CATEGORIES for x in pair))
    found = F.filter(F.transform(F.split(path, "/"), lambda p: names[p]), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("General"))


@F.pandas_udf(T.BooleanType())
def _linked(paths: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a local path below the root is a symbolic link, or goes through one."""

    def linked(path: str, top: str) -> bool:
        while len(path) > len(top):
            if os.path.islink(path):
                return True
            path = os.path.dirname(path)
        return False

    plain = lambda x: "/" + unquote(x.removeprefix("file:")).strip("/")
    return pd.Series([p.startswith("file:") and linked(plain(p), plain(r)) for p, r in zip(paths, root, strict=True)], dtype=bool)


def files(spark: SparkSession, root: str, suffixes=TEXT_SUFFIXES + ("pdf",)) -> DataFrame:
    """All files under `root` with these suffixes: source (path below it), filename, suffix, category
    and content. Files whose name begins with a dot and symbolic links are none of them; the content
    of other files isn't read."""
    named = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{named}}}").load(root)
    raw = raw.filter(~_linked("path", F.lit(root)))
    base = root.rstrip("/").split("://")[-1]
    source = F.regexp_replace("path", r"^.*?" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select(source.alias("source"), name.alias("filename"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("suffix"), "content")
    return out.filter(~F.col("filename").startswith(".")).withColumn("category", category_of(F.col("source")))


def documents(spark: SparkSession, root: str, pdf_pages=None) -> tuple[DataFrame, DataFrame]:
    """(documents, skipped) under `root`: texts of supported files, and the names of those that fail.

    `pdf_pages` turns the bytes of a PDF into a list of texts, one document for each page; without
    it PDF files are skipped.
    """
    found = files(spark, root)
    text = found.filter(F.col("suffix").isin(*TEXT_SUFFIXES)).withColumn("text", F.expr("try_validate_utf8(CAST(content AS STRING))"))
    if pdf_pages is None:
        pages = found.filter("suffix = 'pdf'").withColumn("text", F.lit(None).cast("string"))
    else:

        @F.pandas_udf("array<string>")
        def split(contents: pd.Series) -> pd.Series:
            def pages_of(content):
                try:
                    return pdf_pages(bytes(content))
                except Exception:  # noqa: BLE001  a file that can't be read is listed as skipped
                    return None

            return contents.map(pages_of)

        pages = found.filter("suffix = 'pdf'").withColumn("text", F.explode_outer(split("content")))
    every = text.unionByName(pages).drop("content", "suffix")
    return every.filter("text IS NOT NULL"), every.filter("text IS NULL").select("filename").distinct()


def vector_table(chunks: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk_no, text, source, category, filename, embedding) with an id of document
    and number, which no order of scanning changes."""
    return chunks.withColumn("id", F.concat_ws("_", F.lit("chunk"), F.col("doc_id").cast("string"), F.col("chunk_no").cast("string")))


def write_vectors(vectors: DataFrame, path: str, namespace: str = "knowledge-base") -> None:
    """Replace a namespace of the table at `path` with these rows, be they none; other namespaces stay."""
    vectors.drop("namespace").write.mode("overwrite").parquet(f"{path}/namespace={quote(namespace, safe='')}")


def read_vectors(spark: SparkSession, path: str, namespace: str = "knowledge-base") -> DataFrame:
    """The rows of a namespace; an empty one is an error, as nothing could be found in it."""
    folder = f"{path}/namespace={quote(namespace, safe='')}"
    try:
        found = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no vectors in namespace {namespace}; ingest documents first") from None
    if not found.limit(1).count():
        raise ValueError(f"no vectors in namespace {namespace}; ingest documents first")
    return found


def upserted(vectors: DataFrame, send, batch: int = 100) -> DataFrame:
    """Send vectors to an external index in batches; a row with the count for each partition. `send`
    is built once in a task and gets lists of rows as dictionaries; ids make repeats harmless."""

    def run(frames):
        put, n = send(), 0
        for f in frames:
            rows = f.to_dict("records")
            for k in range(0, len(rows), batch):
                put(rows[k : k + batch])
            n += len(rows)
        yield pd.DataFrame({"n": [n]})

    return vectors.mapInPandas(run, "n long")
