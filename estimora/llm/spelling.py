"""Spelling variants: words that differ by one code point, found by range reporting in two dimensions.

Words of one length are points: their rank in forward order and their rank in reverse order. A word
with one code point replaced or deleted at position i shares with the other word the prefix before i,
an interval of the forward order, and the suffix behind i, an interval of the reverse order. A wavelet
tree over the reverse ranks in forward order reports the points in both intervals, for all words and
positions of a batch level by level.

Trees are built in cells that tasks deal with independently. A cell (m, a, b) holds words of m code
points, and words of m - 1 that they may become, which agree before position a and from b on; each
word is in the two cells of its halves, as the longer and as the shorter one. Cells of more than
CELL_WORDS words are cut at the middle of their open part, again and again: with one open position a
cell can hold no more words than the alphabet has letters, so no cell stays large.

Defined results: a null text has no words; a null doc_id is written as nothing before the colon;
repeated rows count each; texts and words of any length are read whole; ties of n go to the word that
is first in code-point order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.llm.shared import bounded, joined_by_id, saved

LEAST_LENGTH, LEAST_COUNT, DELETE_EVERY, FORM_RATIO = 6, 5, 199, 5
#: Words of a cell beyond which it is cut; rows and code points of a task's cells on average.
CELL_WORDS, TASK_WORDS, TASK_CHARS = 20_000, 100_000, 8_000_000
#: Code points of words that a task counts before it hands them on, and queries of a tree at once.
HELD_CHARS, QUERIES_AT_ONCE = 4_000_000, 200_000

_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = {k: k + 32 for k in range(65, 91)}
_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    size = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, k in Counter(_RUN.findall(text or "")).items():
                word = run.lower() if run.isascii() else run.translate(_LOWER)
                h = zlib.crc32(word.encode(), start)
                if h % DELETE_EVERY == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                size += 0 if word in counts else len(word)
                counts[word] += k
            if size >= HELD_CHARS:
                yield out()
                counts.clear()
                size = 0
    yield out()


def words(docs: DataFrame) -> DataFrame:
    """word and n of docs(doc_id, text): all words of LEAST_LENGTH code points that occur LEAST_COUNT times."""
    some = bounded(docs.select("doc_id", "text")).mapInArrow(counted, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def with_cell(cells: DataFrame) -> DataFrame:
    """cells with `cell`, a hash of m, a, b and of what their words agree in."""
    after = F.when(F.col("longer"), F.col("b") + 1).otherwise(F.col("b"))
    agreed = F.concat(F.substring("word", F.lit(1), F.col("a")), F.substring("word", after, F.length("word")))
    return cells.withColumn("cell", F.xxhash64("m", "a", "b", agreed))


def cells_of(known: DataFrame) -> DataFrame:
    """word, n, longer, m, a, b and cell: two cells for each word as the longer and as the shorter one."""
    halves = []
    for longer, m in ((True, F.length("word")), (False, F.length("word") + 1)):
        h = F.floor(m / 2).cast("int")
        halves += [F.struct(F.lit(longer).alias("longer"), m.alias("m"), a.alias("a"), b.alias("b")) for a, b in ((F.lit(0), h), (h, m))]
    return with_cell(known.select("word", "n", F.inline(F.array(*halves))))


def cut(cells: DataFrame, most: int) -> DataFrame:
    """The cells, where those of more than `most` words are cut. The number of rounds is at most the
    logarithm of the longest word of a large cell."""
    cells = saved(cells, "cells")
    while True:
        large = saved(cells.filter("b - a > 1").groupBy("cell").count().filter(F.col("count") > most).select("cell"), "large")
        if not large.limit(1).count():
            return cells
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        parts = F.inline(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b"))))
        split = joined_by_id(cells.filter("b - a > 1"), large, "cell", "left_semi").select("word", "n", "longer", "m", parts)
        rest = joined_by_id(cells.filter("b - a > 1"), large, "cell", "left_anti").unionByName(cells.filter("b - a <= 1"))
        cells = saved(rest.unionByName(with_cell(split)), "cells")


def matrix(group: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(group), np.uint8).reshape(len(group), width)


def row_order(x: np.ndarray) -> np.ndarray:
    """The order of rows of letters, none of which is zero."""
    return np.argsort(np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel(), kind="stable")


def intervals(rows: np.ndarray, asked: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 0, 1, .. depth leading letters: the interval of `rows`, which are in order, that begin as
    each row of `asked` does. The letters so far are known by the number of their run of rows, so that
    one more letter is a search for a pair of run and letter."""
    run, at = np.zeros(len(rows), np.int64), np.zeros(len(asked), np.int64)
    lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(rows), np.int64)
    yield lo, hi
    for i in range(depth):
        key = run << 8 | rows[:, i]
        want = np.where(hi > lo, at << 8 | asked[:, i], -1)
        lo, hi = np.searchsorted(key, want), np.searchsorted(key, want, "right")
        run = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        at = run[np.minimum(lo, len(rows) - 1)]
        yield lo, hi


class WaveletTree:
    """A sequence that holds 0 .. n-1 once each, by bits: at each level zeros go before ones."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for bit in range(self.bits - 1, -1, -1):
            ones = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~ones)]))
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, lo, hi, least, end) -> tuple[np.ndarray, np.ndarray]:
        """Query and value of all values of [least, end) at places of [lo, hi), queries being arrays."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for bit, before in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = before[lo], before[hi]
            sides = ((a, b, value << 1), (lo - a + before[-1], hi - b + before[-1], value << 1 | 1))
            found = []
            for l, r, v in sides:
                open_ = (r > l) & (v << bit < end[query]) & (v + 1 << bit > least[query])
                found.append((query[open_], l[open_], r[open_], v[open_]))
            query, lo, hi, value = (np.concatenate(x) for x in zip(*found, strict=True))
        return query, value


def hits(asked: np.ndarray, rows: np.ndarray, a: int, b: int, mine: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in asked, place in rows) of pairs where a row equals an asked word but for its letter at
    a position of [a, b): replaced if `mine`, as asked are the rows, else deleted. rows are in order."""
    m, width = asked.shape[1], rows.shape[1]
    back = row_order(rows[:, ::-1])
    rank = np.empty(len(rows), np.int64)
    rank[back] = np.arange(len(rows))
    tree = WaveletTree(rank)
    suffix = {}
    for k, found in enumerate(intervals(np.ascontiguousarray(rows[back, ::-1]), asked[:, ::-1], min(m - 1 - a, width))):
        if k >= m - b:
            suffix[m - 1 - k] = tuple(x.astype(np.int32) for x in found)
    for i, (lo, hi) in enumerate(intervals(rows, asked, min(b - 1, width))):
        if i < a:
            continue
        least, end = suffix.pop(i)
        # of a run of equal letters the last stands for all; a word is among its own replacements
        open_ = (hi - lo > mine) & (end - least > mine)
        if not mine and i + 1 < m:
            open_ &= asked[:, i] != asked[:, i + 1]
        places = np.flatnonzero(open_)
        for k in range(0, len(places), QUERIES_AT_ONCE):
            some = places[k : k + QUERIES_AT_ONCE]
            query, value = tree.report(lo[some], hi[some], least[some], end[some])
            left, right = some[query], back[value]
            yield (left[left != right], right[left != right]) if mine else (left, right)


def told(left, right, ns, texts, other_ns, other_texts) -> pa.RecordBatch:
    """Of each place in left: its word, the number of its near words, and the best of them by n, then order."""
    order = np.lexsort((right, -other_ns[right], left))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    n = np.diff(np.concatenate([first, [len(left)]]))
    best = right[first]
    return pa.RecordBatch.from_arrays([pa.array([texts[x].decode("latin-1") for x in left[first]], pa.string()), pa.array(n, pa.int64()), pa.array(other_ns[best], pa.int64()), pa.array([other_texts[x].decode("latin-1") for x in best], pa.string())], schema=_FOUND)


def near_in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n_near, best_n and best of the words of whole cells; a pair is in one cell only."""
    cells: dict[tuple, tuple[list[bytes], list[int]]] = {}
    for batch in batches:
        for word, n, longer, m, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            some = cells.setdefault((m, a, b, longer), ([], []))
            some[0].append(word.encode("latin-1"))
            some[1].append(n)
    none = ([], [])
    for m, a, b in sorted({k[:3] for k in cells}):
        sides = {}
        for longer in (True, False):
            group, ns = cells.pop((m, a, b, longer), none)
            if group:
                x = matrix(group, m - 1 + longer)
                order = row_order(x)
                sides[longer] = x[order], np.array(ns, np.int64)[order], [group[k] for k in order]
        if True not in sides:
            continue
        long_, ns, texts = sides[True]
        pairs = [p for p in hits(long_, long_, a, b, True) if len(p[0])] if len(long_) > 1 else []
        if pairs:
            yield told(*(np.concatenate(x) for x in zip(*pairs, strict=True)), ns, texts, ns, texts)
        if False in sides:
            short, short_ns, short_texts = sides[False]
            pairs = [p for p in hits(long_, short, a, b, False) if len(p[0])]
            if pairs:
                left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield told(left, right, ns, texts, short_ns, short_texts)
                yield told(right, left, short_ns, short_texts, ns, texts)


def near(known: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """word, n_near, best_n and best (the near word of largest n) of known(word, n) that have near words."""
    cells = cut(cells_of(known), most)
    rows, chars = cells.agg(F.count("*"), F.sum(F.length("word"))).first()
    parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_WORDS, (chars or 0) // TASK_CHARS)
    dealt = cells.repartition(parts, "cell").select("word", "n", "longer", "m", "a", "b")
    found = dealt.mapInArrow(near_in_cells, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of forms(word, form), by steps that double; a form is FORM_RATIO times as frequent
    as its word, so that there is no circle, and the steps grow with the logarithm of the counts' logarithm."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = saved(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not after.filter("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(docs: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs(doc_id, text)."""
    known = saved(words(docs), "words")
    found = known.join(near(known, most), "word", "left")
    is_form = F.col("best_n") >= F.col("n") * FORM_RATIO
    each = saved(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    last = roots(each.filter("form IS NOT NULL"))
    return each.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
