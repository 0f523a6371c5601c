"""Embedding of texts: any model as a function on batches; hashed words by default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of the vectors (fixed value).
DIMENSIONS = 384
#: A model: built once in a Python worker, then called on lists of texts.
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]


def hashed(texts: DataFrame, column: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """texts with `embedding`: hashed counts of words, of unit length; zero for a text without words."""
    words = Tokenizer(inputCol="_t", outputCol="_w").transform(texts.withColumn("_t", F.coalesce(F.col(column), F.lit(""))))
    counts = HashingTF(inputCol="_w", outputCol="_c", numFeatures=dimensions).transform(words)
    out = Normalizer(inputCol="_c", outputCol="_n").transform(counts)
    return out.withColumn("embedding", vector_to_array("_n", "float32")).drop("_t", "_w", "_c", "_n")


def embedded(texts: DataFrame, model: Embedder, column: str = "text") -> DataFrame:
    """texts with `embedding` by a model that is loaded once for each task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = model()
        for batch in batches:
            yield pd.Series(embed(batch.fillna("").tolist()))

    return texts.withColumn("embedding", run(F.col(column)))
