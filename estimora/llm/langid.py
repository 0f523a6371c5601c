"""Language identification by hierarchical discrimination.

A text's features are hashed two- and three-byte grams of its lower-cased letters. Linear
support vector machines first choose the language family (one against the rest), then each pair
of languages within that family is separated by a machine of its own and the votes decide.

Defined results: a null text or one without a letter (of Unicode's category L) is `und` with
score 0; without labelled rows every text is `und`; with a single language nothing needs deciding
and the score is 1; of equal votes the language that sorts first wins; repeated rows are predicted
alike, texts of any length whole; an empty table gives no rows. Columns beyond doc_id, text and
lang never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from estimora.llm.arrays import row_chunks, text_bytes
from estimora.llm.shared import bounded

#: Hashed features, and labelled rows to learn from at most, over all languages.
FEATURES, SAMPLE_ROWS = 4096, 2000
#: Languages of a family (fixed values); a language of none of them is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "turkic": "az kk tr tk uz",
    "uralic": "et fi hu",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family(lang: str) -> str:
    code = re.split("[-_]", lang.lower())[0]
    return _FAMILY.get(code, lang)


def features(texts: pa.Array) -> np.ndarray:
    """A row of unit length for each text: square roots of its counts of hashed grams."""
    data, offsets = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offsets) - 1
    letter = (data >= 128) | ((data >= 97) & (data <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    rows = np.repeat(np.arange(n), np.diff(offsets))[keep]
    codes = np.where(letter, data, 32)[keep].astype(np.uint32)
    counts = np.zeros(n * FEATURES, np.float32)
    for size, odd in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        m = max(0, len(codes) - size + 1)
        gram = np.zeros(m, np.uint32)
        for k in range(size):
            gram = gram * np.uint32(256) + codes[k : k + m]
        at = (gram * np.uint32(odd)) >> np.uint32(20)
        same = rows[:m] == rows[size - 1 :]
        counts += np.bincount(rows[:m][same] * FEATURES + at[same], minlength=n * FEATURES)
    found = np.sqrt(counts).reshape(n, FEATURES)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def machine(x: np.ndarray, rows: np.ndarray, positive: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine with squared hinge loss on some
    rows of x, by coordinate descent on its dual; both classes weigh alike. Rows are widened one at
    a time, so that x, the largest thing that the driver holds, is held once."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, positive.mean(), 1 - positive.mean())
    slack = share / cost
    alpha, w, bias, order = np.zeros(len(rows)), np.zeros(x.shape[1]), 0.0, np.random.default_rng(7)
    norms = np.array([np.dot(x[k], x[k]) for k in rows], np.float64) + 1 + slack
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            v = x[rows[i]].astype(np.float64)
            step = max(-alpha[i], -(y[i] * (v @ w + bias) - 1 + slack[i] * alpha[i]) / norms[i])
            if step:
                alpha[i] += step
                w += step * y[i] * v
                bias += step * y[i]
    return np.append(w, bias)


@dataclass
class Model:
    """All machines' weights side by side, and which columns decide what."""

    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES + 1, 0), np.float32))
    pairs: list[tuple[int, int]] = field(default_factory=list)


def learned(x: np.ndarray, order: list[int], labels: list[str]) -> Model:
    """Machines for the families, and for each pair of languages of one family; order: the row of x
    of each label."""
    y = np.array(labels, dtype=object)
    langs = sorted(set(labels))
    groups = sorted({family(k) for k in langs})
    of, every = np.array([family(k) for k in labels], dtype=object), np.array(order)
    columns = [machine(x, every, of == g) for g in groups] if len(groups) > 1 else []
    pairs = [(a, b) for a, b in combinations(range(len(langs)), 2) if family(langs[a]) == family(langs[b])]
    for a, b in pairs:
        use = np.flatnonzero((y == langs[a]) | (y == langs[b]))
        columns.append(machine(x, every[use], y[use] == langs[a]))
    return Model(langs, groups, np.array(columns, np.float32).reshape(len(columns), x.shape[1] + 1).T, pairs)


def decided(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language and the score of each row: the logistic value of the least margin that was decided by."""
    n = len(x)
    margins = x @ model.weights[:-1] + model.weights[-1]
    k = len(model.families) if len(model.families) > 1 else 0
    chosen = np.argmax(margins[:, :k], axis=1) if k else np.zeros(n, int)
    least = np.full(n, np.inf)
    if k:
        best = np.sort(margins[:, :k], axis=1)
        least = (best[:, -1] - best[:, -2]) / 2
    votes, lost = np.zeros((n, len(model.langs))), np.full((n, len(model.langs)), np.inf)
    member = np.array([[family(lang) == g for lang in model.langs] for g in model.families])
    for (a, b), m in zip(model.pairs, margins[:, k:].T, strict=True):
        votes[:, a] += m > 0
        votes[:, b] += m <= 0
        lost[:, a], lost[:, b] = np.minimum(lost[:, a], m), np.minimum(lost[:, b], -m)
    votes[~member[chosen]] = -1
    lang = np.argmax(votes, axis=1)
    least = np.minimum(least, lost[np.arange(n), lang])
    return lang, 1 / (1 + np.exp(-4 * np.clip(least, -10, 10)))


def remainder(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from docs(doc_id, text, lang): from about `sample_rows` of the labelled rows that
    aren't held out, as many of each language where there are so many. Rows are drawn by a hash of id
    and text, equal ones once, and of those drawn a language has at most its share of sample_rows by
    that hash, so the bound holds whatever repeats. Their hashed features, of one size whatever the
    text, are all that reaches the driver."""
    known = bounded(docs).select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(remainder(), F.lit(0)) != 2))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    each = max(1, sample_rows // len(counts))
    rate = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    key = F.xxhash64("doc_id", "text")
    likely = known.withColumn("key", key).filter(F.pmod("key", F.lit(1 << 20)) < rate[F.col("lang")] * float(1 << 20))
    first = W.Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 20)), "key")
    drawn = likely.dropDuplicates(["lang", "key"]).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= each)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text", rows=500):
            x = features(chunk.column("text"))
            yield pa.RecordBatch.from_pydict({"lang": chunk.column("lang"), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    found = bounded(drawn.select("text", "lang")).mapInArrow(vectors, "lang string, x binary").toArrow().combine_chunks()
    if not found.num_rows:
        return Model()
    data, _ = text_bytes(found.column("x").chunk(0))
    x, langs = data.view(np.float32).reshape(-1, FEATURES), found.column("lang").to_pylist()
    # an order that doesn't depend on how the rows were dealt; among equal rows it makes no difference
    order = sorted(range(len(langs)), key=lambda k: (langs[k], xxhash.xxh64_intdigest(x[k].tobytes())))
    return learned(x, order, [langs[k] for k in order])


def predicted(docs: DataFrame, model: Model, lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score, which take the place of columns so named."""
    docs = docs.drop(lang_pred, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text", rows=500):
            found = [bool(model.langs) and any(map(str.isalpha, t or "")) for t in chunk.column("text").to_pylist()]
            lang, sure = decided(model, features(chunk.column("text"))) if model.langs else (np.zeros(chunk.num_rows, int), np.zeros(chunk.num_rows))
            names = [model.langs[k] if ok else "und" for k, ok in zip(lang, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*chunk.columns, pa.array(names, pa.string()), pa.array(np.where(found, sure, 0.0))], [*chunk.schema.names, lang_pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return bounded(docs).mapInArrow(run, schema)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs(doc_id, text, lang)."""
    found = predicted(docs.select("doc_id", "text"), fit(docs, sample_rows))
    return found.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
