"""Chunks of texts: fixed windows as columns, and recursive splitting at separators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP = 1000, 200
#: Separators, the strongest first (fixed values).
SEPARATORS = ("\n## ", "\n### ", "\n---", "\n\n", "\n", " ")


def fixed_windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, chunk_no and chunk: windows of `size` characters, each `overlap` into the one before; and
    the columns `keep` of its document."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - overlap) / step) - 1).cast("int")
    starts = docs.filter(F.length("text") > 0).select("doc_id", "text", *keep, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return starts.select("doc_id", "chunk_no", F.col("text").substr(F.col("chunk_no") * step + 1, F.lit(size)).alias("chunk"), *keep)


def pieces(text: str, size: int, separators=SEPARATORS) -> list[str]:
    """The text cut before the first separator that it has, and oversize pieces again by the next."""
    for k, s in enumerate(separators):
        if s in text:
            head, *rest = text.split(s)
            found = [p for p in [head, *(s + r for r in rest)] if p]
            return [q for p in found for q in ([p] if len(p) <= size else pieces(p, size, separators[k + 1 :]))]
    return [text]


def recursive_chunks(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Pieces joined up to `size` characters; a chunk starts with the last pieces of the one before,
    `overlap` characters at most. A piece without a separator may be longer than `size`."""
    chunks, held, length = [], [], 0
    for piece in pieces(text, size) if text else []:
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        chunks.append("".join(held))
    return [c for c in map(str.strip, chunks) if c]


def chunked(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, chunk_no and chunk of docs(doc_id, text), split recursively."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, c) for i, t in zip(f["doc_id"], f["text"], strict=True) for k, c in enumerate(recursive_chunks(t or "", size, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "chunk"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunk_no int, chunk string")


class ChunksOf:
    """Rows of SQL for each text: `LATERAL recursive_chunks(text)`, once register() was called; a null
    text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(recursive_chunks(text or ""))


def register(spark: SparkSession) -> None:
    """Make recursive_chunks known to the session's SQL."""
    spark.udtf.register("recursive_chunks", F.udtf(ChunksOf, returnType="chunk_no int, chunk string"))
