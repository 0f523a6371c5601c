"""Unigram token counts by dynamic programming shared along a trie.

The distinct new pre-tokens of a chunk are put into a trie, laid out level by level: a node is a
distinct prefix. A node keeps the best score of any segmentation of its prefix into pieces and
the number of pieces of it, computed once from the nodes above by the pieces that end there, so
pre-tokens with a common prefix share that work; all nodes of a level are computed at once. The
node where a pre-token ends is its count, which is stored by pre-token, so that only new ones
need a trie. Among equal scores the fewer pieces win. A document's count is the sum over its
pre-tokens.

A piece scores the logarithm of its share under Zipf's law for its rank in the vocabulary; a
character that no piece holds is written as its bytes, at the score of the last rank for each.
Pieces are found in prefixes by 64-bit hashes.

Defined results: null, empty and blank texts have no tokens; repeated rows are counted alike; an
empty table gives no rows; a pre-token longer than LEVELS goes on without sharing, character by
character, in memory that doesn't grow with it. Other columns are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from estimora.llm.arrays import constants, mixed, row_chunks
from estimora.llm.shared import bounded

SCHEMA = "doc_id long, n_pretokens long, n_tokens long, score double"
#: Levels of a trie, pre-tokens whose counts a worker stores (beyond it they start anew), and bytes
#: of text that are taken at once.
LEVELS, STORED, CHUNK = 48, 400_000, 3_000_000
#: The sign that a pre-token of the vocabulary begins with (fixed value).
MARK = "▁"
_BASE = int(constants(1, 404)[0])


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece model file, but for control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / k for k in range(1, n + 1)))
    return {model.id_to_piece(k): -math.log(k + 1) - total for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Counter:
    """Counts of pre-tokens by the pieces of a vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.lowest = min(pieces.values(), default=-1.0)
        # the longest piece that ends in a character: no more characters need be looked at there
        self.reach: dict[str, int] = {}
        for p in pieces:
            self.reach[p[-1]] = max(self.reach.get(p[-1], 0), len(p))
        self.longest = max(self.reach.values(), default=0)
        self.powers = np.array([pow(_BASE, k, 1 << 64) for k in range(max(1, self.longest))], np.uint64)
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array(list(pieces.values()))[order]
        self.maybe = np.zeros(1 << 22, bool)  # what most hashes of no piece fail
        self.maybe[hashes >> np.uint64(42)] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.counts, self.scores = array("q"), array("d")

    def _hash(self, piece: str) -> int:
        with np.errstate(over="ignore"):
            return int((mixed(code_points(piece)[::-1].astype(np.uint64) + np.uint64(1)) * self.powers[: len(piece)]).sum())

    def store(self, words: set[str]) -> None:
        """Count those of the words that aren't stored."""
        new = sorted(words.difference(self.known))
        short = [w for w in new if len(w) < LEVELS]
        counts, scores = self.forward([MARK + w for w in short])
        for w in new:
            if len(w) >= LEVELS:
                n, s = self.along(MARK + w)
                short.append(w)
                counts.append(n)
                scores.append(s)
        self.known.update(zip(short, range(len(self.counts), len(self.counts) + len(short)), strict=True))
        self.counts.extend(counts)
        self.scores.extend(scores)

    def forward(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Pieces and scores of sorted words, by a trie of all of them."""
        sizes = np.array([len(w) for w in words], np.int64)
        starts, codes = np.cumsum(sizes) - sizes, code_points("".join(words))
        kinds, kind = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in kinds]
        reach, single = np.array([self.reach.get(c, 0) for c in chars], np.int64), np.array([c in self.pieces for c in chars], bool)
        as_bytes = np.array([len(c.encode()) for c in chars], np.int64)
        values = mixed(kinds.astype(np.uint64) + np.uint64(1))[kind]
        counts, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        # by level: the node of each word, and the best score and its pieces of each node
        node, best, parts = [np.zeros(len(words), np.int32)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for k in range(1, int(sizes.max(initial=0)) + 1):
            alive = np.flatnonzero(sizes >= k)
            at, above = starts[alive] + k - 1, node[-1][alive]
            fresh = np.ones(len(alive), bool)
            fresh[1:] = (above[1:] != above[:-1]) | (kind[at[1:]] != kind[at[:-1]])
            now = np.zeros(len(words), np.int32)
            now[alive] = np.cumsum(fresh) - 1
            node.append(now)
            some = alive[fresh]
            last = kind[starts[some] + k - 1]
            top, least = np.full(len(some), -np.inf), np.zeros(len(some), np.int64)
            hashed, left = np.zeros(len(some), np.uint64), np.arange(len(some))
            with np.errstate(over="ignore"):
                for size in range(1, min(k, self.longest) + 1):
                    left = left[reach[last[left]] >= size]
                    hashed[left] += values[starts[some[left]] + k - size] * self.powers[size - 1]
                    hit = left[self.maybe[hashed[left] >> np.uint64(42)]]
                    place = np.minimum(np.searchsorted(self.hashes, hashed[hit]), len(self.hashes) - 1)
                    found = self.hashes[place] == hashed[hit]
                    hit, place = hit[found], place[found]
                    origin = node[k - size][some[hit]]
                    score, n = best[k - size][origin] + self.values[place], parts[k - size][origin] + 1
                    better = (score > top[hit]) | (score == top[hit]) & (n < least[hit])
                    top[hit[better]], least[hit[better]] = score[better], n[better]
            origin, n = node[k - 1][some], as_bytes[last]
            score = best[k - 1][origin] + n * self.lowest
            better = ~single[last] & (score > top)
            top[better], least[better] = score[better], parts[k - 1][origin[better]] + n[better]
            best.append(top)
            parts.append(least)
            done = np.flatnonzero(sizes == k)
            counts[done], scores[done] = least[now[done]], top[now[done]]
        return counts.tolist(), scores.tolist()

    def along(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word, with no more of its prefixes at hand than pieces are long."""
        held = [(0.0, 0)]  # of the last prefixes, the shortest first
        for k, c in enumerate(word, 1):
            best, parts = -math.inf, 0
            for size in range(1, min(k, self.reach.get(c, 0)) + 1):
                s = self.pieces.get(word[k - size : k])
                if s is not None:
                    before = held[-size]
                    if (t := before[0] + s) > best or t == best and before[1] + 1 < parts:
                        best, parts = t, before[1] + 1
            if c not in self.pieces:
                n = len(c.encode())
                if (t := held[-1][0] + n * self.lowest) > best:
                    best, parts = t, held[-1][1] + n
            held.append((best, parts))
            if len(held) > self.longest + 1:
                del held[0]
        return held[-1][1], held[-1][0]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One per Python worker."""
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, numbers of pre-tokens and tokens, and score of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = counter(model)
        for chunk in row_chunks(batches, "text", CHUNK):
            if len(shared.known) > STORED:
                shared.clear()
            texts = [(t or "").split() for t in chunk.column("text").to_pylist()]
            sizes = np.array([len(words) for words in texts], np.int64)
            every = list(chain.from_iterable(texts))
            shared.store(set(every))
            at = np.fromiter(map(shared.known.__getitem__, every), np.int64, len(every))
            some = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[some]
            tokens, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if len(some):
                tokens[some] = np.add.reduceat(np.array(shared.counts)[at], starts)
                scores[some] = np.add.reduceat(np.array(shared.scores)[at], starts)
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(sizes), pa.array(tokens), pa.array(scores)], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
