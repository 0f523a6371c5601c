"""Queries on files: documents written with a commit and read as a source, and vectors changed in place."""

from __future__ import annotations

from pyspark.sql import functions as F

from estimora.operators import chunking, embedding, feedback, report
from estimora.plans.registry import query
from estimora.sources import document_files, vectors
from estimora.sources.shared import new_path
from estimora.sources.tables import table

_HEAD = "concat('---', chr(10), 'generated_by: estimora', chr(10), 'date: 2026-02-23 12:00', chr(10), 'project: ', project, chr(10), 'document_type: test_plan', chr(10), '---', chr(10), chr(10), text)"


@query("documents_written", f"""WITH p AS (SELECT concat(source, ' ', doc_id) AS project, text FROM documents WHERE text IS NOT NULL)
  SELECT concat('test_plan_', regexp_replace(replace(project, ' ', '_'), '[^\\p{{L}}\\p{{N}}_\\-.]', '_', 'g'), '_20260223_120000.md') AS source, 'General' AS category, {_HEAD} AS text FROM p""")
def documents_written(spark, sf_dir):
    """Each document as a file with its front matter, written twice and read back."""
    docs = table(spark, sf_dir, "documents").select(F.lit("test_plan").alias("document_type"), F.concat_ws(" ", "source", "doc_id").alias("project_name"), F.to_timestamp(F.lit("2026-02-23 12:00:00")).alias("generated_at"), F.col("text").alias("body"))
    folder = new_path(spark, "written")
    for _ in range(2):  # a run that is repeated leaves the same files
        report.write_documents(report.named(docs), folder)
    return document_files.read_documents(spark, folder)[0].select("source", "category", "text")


def _turns(content: bytes) -> list[str]:
    return content.decode("utf-8").split("\f")


@query("files_read", r"""SELECT concat('conv_', conv_id, '.txt') AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS page, text FROM conversations WHERE conv_id % 10 <> 3
  UNION ALL SELECT concat('conv_', conv_id, '.md'), 0, string_agg(text, chr(12) ORDER BY turn) FROM conversations WHERE conv_id % 10 = 3 GROUP BY conv_id""")
def files_read(spark, sf_dir):
    """Each conversation as a file, read by the loader of its suffix: a page for each turn, or a whole text."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\f")
    suffix = F.when(F.col("conv_id") % 10 == 3, ".md").otherwise(".txt")
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("body")).select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), suffix).alias("file_name"), "body")
    folder = new_path(spark, "conversations")
    report.write_documents(files, folder)
    return document_files.read_documents(spark, folder, {"txt": _turns})[0].select("source", "page", "text")


_WINDOWS = "unnest(range(0, greatest(0, CAST(ceil((length(text) - 200) / 800e0) AS BIGINT) - 1) + 1))"


@query("vectors_upserted", f"""WITH after AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 5 = 0 THEN concat('changed ', text) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 1),
  c AS (SELECT doc_id, source, lang, text, {_WINDOWS} AS k FROM after WHERE length(text) > 0)
  SELECT concat('chunk_', doc_id, '_', k) AS id, CAST(k AS INTEGER) AS chunk_no, substring(text, CAST(k * 800 + 1 AS BIGINT), 1000) AS text, concat(source, '/', doc_id) AS source, lang AS category FROM c""")
def vectors_upserted(spark, sf_dir):
    """A namespace of all documents, in which a fifth then change and a seventh go: only chunks that
    are new are embedded, and only buckets with a change are written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "doc_id").alias("source"), F.col("lang").alias("category"), F.lit(None).cast("string").alias("filename"))
    path = new_path(spark, "namespace")

    def chunks(rows):
        return chunking.fixed_windows(rows, keep=("source", "category", "filename")).withColumnRenamed("chunk", "text")

    vectors.upsert(chunks(docs), path, embedding.hashed)
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))
    after = docs.filter("doc_id % 7 <> 1").withColumn("text", changed)
    touched = docs.filter("doc_id % 7 = 1 OR doc_id % 5 = 0").select("source")
    vectors.upsert(chunks(after.join(touched, "source", "left_semi")), path, embedding.hashed, sources=touched)
    return vectors.current(spark, path).select("id", "chunk_no", "text", "source", "category")


@query("feedback_ingested", """WITH f AS (SELECT d.doc_id, d.text, CASE WHEN quality = 1 AND toxic = 0 THEN 'yes' WHEN quality = 1 THEN 'partially' ELSE 'no' END AS feedback FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
  SELECT concat('generated_strategies/test_strategy_', doc_id, '.md') AS source, 'General' AS category, concat('---', chr(10), 'feedback: ', feedback, chr(10), 'notes: checked', chr(10), '---', chr(10), chr(10), text) AS text FROM f WHERE feedback IN ('yes', 'partially')""")
def feedback_ingested(spark, sf_dir):
    """Accepted documents as files of the corpus, which the next ingest finds."""
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "yes").when(F.col("quality") == 1, "partially").otherwise("no")
    given = table(spark, sf_dir, "labels").select("doc_id", verdict.alias("feedback"))
    rows = given.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id")
    rows = rows.withColumns({"strategy_id": F.col("doc_id"), "notes": F.lit("checked"), "file_name": F.concat(F.lit("test_strategy_"), F.col("doc_id").cast("string"), F.lit(".md"))})
    root = new_path(spark, "corpus")
    feedback.kept(rows, root)
    return document_files.read_documents(spark, root)[0].select("source", "category", "text")

