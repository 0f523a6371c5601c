"""Benchmark decontamination by the CGK embedding of edit distance into Hamming distance.

Texts and benchmark items are sequences of words (runs of letters and digits, A-Z as a-z). A
window of a document as long as an item is walked by the CGK rule: at each step the current
word is written, and a random bit that depends on step and word says whether the walk goes on to
the next word. Close sequences walk in step again soon after an edit, so that their embeddings
agree at most places. Each of several rounds samples a few places of the embeddings of items and
windows alike and looks for equal samples; candidates are then verified by the edit distance
between the whole item and the nearest part of the words in and around the window.

Windows start where an item could start: at each word whose run of SEED words also stands in an
item, less its place there, and up to as many words around as may be edited, provided that as
many such runs lie close by as a window within the limit must hold. An item of L words with k edits keeps
L - k of them in k + 1 runs at most, one of which is as long as their mean: no seed is longer than
that (3 words for a fifth of edits and L >= 6, fewer for more), so this leaves out no window that
verification would accept.

The number of rounds follows from the recall asked for, for each length of items: items are
edited at random up to the limit, their embeddings are compared, and the rounds are what the
agreement seen needs. Lengths that would need more than MOST_ROUNDS are verified at every window.

The benchmark is dealt into parts of a bounded size, prepared by tasks and written to the shared
folder, from where the tasks that hold documents read them part by part: the corpus is read once,
and the driver holds neither side.

Defined results: null and empty texts and items hold nothing, and so do items without an id; equal
items are all reported; repeated documents are reported each, those without an id under null; of
places of equal distance the first is reported; texts of any length are searched whole; an empty
table on either side gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estimora.llm.arrays import constants, grams, mixed, row_chunks, text_bytes, words
from estimora.llm.shared import bounded, file_system, new_path

SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double"
#: Words of a seed, embeddings (of independent walks) and places that a round samples.
SEED, WALKS, PLACES = 3, 4, 2
#: Rounds at most, beyond which every window is verified, and items of a length that are edited to know.
MOST_ROUNDS, TRIED = 160, 30
#: Benchmark rows of a part (about), bytes of texts that a task holds while it goes through one part, and
#: times as many that it holds at most if there are more, so that they are read less often.
ITEMS_AT_ONCE, HELD_BYTES, HELD_TIMES = 20_000, 8_000_000, 6


def edit_distance(item: np.ndarray, text: np.ndarray, limit: int) -> int:
    """Insertions, deletions and replacements between an item and the part of a text that is the
    nearest to it; limit + 1 if more."""
    at = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, x in enumerate(item, 1):
        change = np.minimum(row[:-1] + (text != x), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate([[i], change]) - at) + at
        if row.min() > limit:
            return limit + 1
    return int(row.min())


def embed(windows: np.ndarray, length: int, walk: int) -> np.ndarray:
    """CGK embeddings, 3 * length long, of sequences padded to one length (0: past the end)."""
    n, steps = len(windows), 3 * length
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    place, rows = np.zeros(n, np.int64), np.arange(n)
    salt = constants(steps, 1000 + walk)
    out = np.zeros((n, steps), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(steps):
            out[:, j] = now = padded[rows, place]
            place = np.minimum(place + (mixed(now * salt[j]) >> np.uint64(63)).astype(np.int64), windows.shape[1])
    return out


@dataclass
class Items:
    """Benchmark items of an equal number of words, their embeddings' samples by round, and seeds."""

    ids: list[int]
    texts: list[np.ndarray]
    limits: list[int]
    least: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    samples: dict[int, list[tuple[np.ndarray, np.ndarray]]]  # by length and round: sorted, with the item of each
    places: dict[int, np.ndarray]
    exact: set[int]  # lengths without rounds


def sampled(embedded: np.ndarray, places: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(embedded), np.uint64)
        for p, c in zip(places, constants(len(places), 31), strict=True):
            out += mixed(embedded[:, p] + np.uint64(int(p))) * c
    return out


def rounds_for(texts: list[np.ndarray], share: float, recall: float) -> int:
    """Rounds that find `recall` of the items that are edited at random up to the limit."""
    rng, pairs = np.random.default_rng(3), []
    for text in [texts[k] for k in np.resize(rng.permutation(len(texts)), TRIED)] if texts else []:
        n = len(text)
        edited = list(text)
        for _ in range(int(share * n)):
            at, kind = int(rng.integers(len(edited))), int(rng.integers(3))
            if kind:
                edited.insert(at, np.uint64(rng.integers(1 << 62)))
            if kind < 2:
                edited.pop(at + (kind > 0) if at + (kind > 0) < len(edited) else at)
        pairs.append((text, edited[:n] + [np.uint64(0)] * (n - len(edited))))
    if not pairs:
        return 4
    whole, changed = (np.array(side, np.uint64) for side in zip(*pairs, strict=True))
    low = float(np.quantile([np.mean(embed(whole, n, w) == embed(changed, n, w), axis=1) for w in range(WALKS)], 0.05))
    once = min(max(low**PLACES, 1e-6), 1 - 1e-9)
    return int(max(4, np.ceil(np.log(1 - recall) / np.log(1 - once))))


def prepared(ids: list[int], texts: list[str], share: float, recall: float) -> Items:
    hashes, rows, _, _ = words(*text_bytes(pa.array(texts, pa.string())), "letters")
    cut = np.searchsorted(rows, np.arange(len(texts) + 1))
    held = [(i, hashes[a:b]) for i, a, b in zip(ids, cut[:-1], cut[1:], strict=True) if b > a]
    ids, parts = [i for i, _ in held], [t for _, t in held]
    limits = [int(share * len(t)) for t in parts]
    least = np.ones(len(parts), np.int64)
    by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, t in enumerate(parts):
        size = max(1, min(SEED, -(-(len(t) - limits[k]) // (limits[k] + 1))))
        least[k] = max(1, len(t) - size + 1 - size * limits[k])
        found, at = grams(t, np.zeros(len(t), np.int64), size, 9)
        by_size[size] += [(int(h), k, int(p)) for h, p in zip(found, at, strict=True)]
    seeds = {}
    for size, found in by_size.items():
        found.sort()
        seeds[size] = tuple(np.array(x, t) for x, t in zip(zip(*found, strict=True), (np.uint64, np.int64, np.int64), strict=True))
    samples: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    places: dict[int, np.ndarray] = {}
    exact: set[int] = set()
    for n in sorted({len(t) for t in parts}):
        own = [k for k, t in enumerate(parts) if len(t) == n]
        rounds = rounds_for([parts[k] for k in own], share, recall)
        if rounds > MOST_ROUNDS:
            exact.add(n)
            continue
        places[n] = np.random.default_rng(n).integers(0, 3 * n, (rounds, PLACES))
        whole = [embed(np.array([parts[k] for k in own]), n, w) for w in range(WALKS)]
        samples[n] = []
        for r in range(rounds):
            values = sampled(whole[r % WALKS], places[n][r])
            order = np.argsort(values, kind="stable")
            samples[n].append((values[order], np.array(own)[order]))
    return Items(ids, parts, limits, least, seeds, samples, places, exact)


def crowded(row: np.ndarray, item: np.ndarray, seed: np.ndarray, least: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which seeds lie in a stretch as long as the item with as many seeds of that item as a window
    within the limit must hold (each edit spoils no more seeds than a seed has words)."""
    spot, back = np.unique(np.stack([row, item, seed], axis=1), axis=0, return_inverse=True)
    back = back.ravel()
    need, room = np.zeros(len(spot), np.int64), np.zeros(len(spot), np.int64)
    need[back], room[back] = least, size
    at = np.arange(len(spot))
    end = np.minimum(at + need - 1, len(spot) - 1)
    full = (at + need - 1 < len(spot)) & (spot[end, 0] == spot[:, 0]) & (spot[end, 1] == spot[:, 1]) & (spot[end, 2] - spot[:, 2] < room)
    change = np.zeros(len(spot) + 1, np.int64)
    np.add.at(change, at[full], 1)
    np.add.at(change, end[full] + 1, -1)
    return (np.cumsum(change)[:-1] > 0)[back]


def windows_of(items: Items, hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(length, first word, item) of the windows that an item could fill, each once; the item is -1
    where rounds find it."""
    sizes, found = np.array([len(t) for t in items.texts]), []
    limits = np.array(items.limits)
    for size, (known, item, place) in items.seeds.items():
        have, at = grams(hashes, rows, size, 9)
        a, b = np.searchsorted(known, have, "left"), np.searchsorted(known, have, "right")
        hit = np.flatnonzero(b > a)
        if len(hit):
            n = (b - a)[hit]
            entry = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = np.repeat(at[hit], n)
            found.append(np.stack([item[entry], where - place[entry], where], axis=1))
    if not found:
        return np.zeros((0, 3), np.int64)
    k, start, seed = np.unique(np.concatenate(found), axis=0).T
    dense = crowded(rows[seed], k, seed, items.least[k], sizes[k])
    k, start, seed = k[dense], start[dense], seed[dense]
    wide = limits[k]
    n = 2 * wide + 1
    each = np.repeat(np.arange(len(k)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) - wide[each]
    start, seed, length = (start[each] + shift), seed[each], sizes[k][each]
    row = rows[seed]
    first = np.searchsorted(rows, row)
    start = np.maximum(start, first)
    own = start < np.searchsorted(rows, row, "right")  # others would begin in the next row
    item = np.where(np.isin(length, list(items.exact)), k[each], -1)
    return np.unique(np.stack([length[own], start[own], item[own]], axis=1), axis=0)


def candidates(items: Items, n: int, starts: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
    """(window, item) of windows of n words that agree with an item in all places of a round."""
    at = starts[:, None] + np.arange(n)
    inside = at < len(hashes)
    at = np.minimum(at, len(hashes) - 1)
    windows = np.where(inside & (rows[at] == rows[starts][:, None]), hashes[at], np.uint64(0))
    pairs: set[tuple[int, int]] = set()
    walked = [embed(windows, n, w) for w in range(WALKS)]
    for r, (values, item) in enumerate(items.samples[n]):
        found = sampled(walked[r % WALKS], items.places[n][r])
        low, high = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
        for j in np.flatnonzero(high > low).tolist():
            pairs.update((j, k) for k in item[low[j] : high[j]].tolist())
    return pairs


def found_in(items: Items, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, distance) of the best window of each row and item."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    seen: dict[tuple[int, int], list[int]] = defaultdict(list)
    todo = windows_of(items, hashes, rows)
    for n in np.unique(todo[:, 0]).tolist():
        starts, wanted = todo[todo[:, 0] == n, 1], todo[todo[:, 0] == n, 2]
        for a in range(0, len(starts), 20_000):
            some = starts[a : a + 20_000]
            pairs = candidates(items, n, some, hashes, rows) if n not in items.exact else enumerate(wanted[a : a + 20_000].tolist())
            for j, k in sorted(pairs):
                start, limit = int(some[j]), items.limits[k]
                key = (int(rows[start]), k)
                if any(abs(start - x) <= limit for x in seen[key]):
                    continue  # the words around that were compared hold this window's too
                seen[key].append(start)
                low, high = max(0, start - 2 * limit), start + n + 2 * limit
                around = hashes[low:high][rows[low:high] == key[0]]
                d = edit_distance(items.texts[k], around, limit)
                if d <= limit and (d, start) < best.get(key, (1 << 30, 0)):
                    best[key] = (d, start)
    return [(row, k, start, d) for (row, k), (d, start) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.2, recall: float = 0.99) -> DataFrame:
    """A row for each document of docs(doc_id, text) that holds an item of benchmark(item_id, text)
    with edits of max_share of its words at most, which is below 1: where about, and how many edits."""
    if not 0 <= max_share < 1:
        raise ValueError("max_share is from 0 to below 1")
    folder = new_path(docs.sparkSession, "benchmark")
    known = benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    parts = -(-known.count() // ITEMS_AT_ONCE)

    def prepare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = prepared(table.column("item_id").to_pylist(), table.column("text").to_pylist(), max_share, recall)
        return pa.table({"data": pa.array([pickle.dumps(items)], pa.binary())})

    dealt = known.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(max(1, parts))))
    dealt.groupBy("part").applyInArrow(prepare, "data binary").write.parquet(folder)
    return bounded(docs).select("doc_id", "text").mapInArrow(_searcher(folder, HELD_BYTES * max(1, min(parts, HELD_TIMES))), SCHEMA)


_last: dict[str, Items] = {}


def read_parts(folder: str) -> Iterator[Items]:
    """The parts of a prepared benchmark; a worker keeps the last one that it read."""
    from pyarrow import fs, parquet

    store, base = file_system(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                whole = parquet.ParquetFile(file)
                for k in range(whole.num_row_groups):
                    for n in range(whole.metadata.row_group(k).num_rows):
                        key = f"{f.path}/{k}/{n}"
                        if key not in _last:
                            data = whole.read_row_group(k).column("data")[n].as_py()
                            _last.clear()
                            _last[key] = pickle.loads(data)
                        yield _last[key]


def held(chunks: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    some, size = [], 0
    for chunk in chunks:
        some.append(chunk)
        size += chunk.nbytes
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _searcher(folder: str, most: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in held(row_chunks(batches, "text"), most):
            texts = [(chunk, *words(*text_bytes(chunk.column("text")), "letters")[:2]) for chunk in some]
            for items in read_parts(folder):
                for chunk, hashes, rows in texts:
                    if not len(hashes) or not items.ids:
                        continue
                    firsts, ids = np.searchsorted(rows, np.arange(chunk.num_rows)), chunk.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_pylist(
                        [
                            {"doc_id": ids[row], "item_id": items.ids[k], "start_word": int(start - firsts[row]), "n_words": len(items.texts[k]), "distance": d, "similarity": 1 - d / len(items.texts[k])}
                            for row, k, start, d in found_in(items, hashes, rows)
                        ],
                        schema,
                    )

    return run
