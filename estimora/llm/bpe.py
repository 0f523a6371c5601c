"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct new words of a chunk of documents are laid out as one list of symbols. Every pair
of neighbours that has a rank goes into a list of its positions; the active ranks are taken in
ascending order, each merge is applied at all positions of its pair, and the lists of the pairs
that this makes are extended. A merge can only make pairs of the same word, so that each word
sees its merges lowest rank first, as one by one.

Letters and digits are what the library takes for them: of the characters that its tables may
not know yet each is tried once, and texts with such characters are normalised by the library.

Defined results: null and empty texts have no ids and decode to the empty text; the strings of
special tokens become their ids; repeated rows are kept; a very long text is encoded whole; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from estimora.llm.arrays import row_chunks
from estimora.llm.shared import bounded

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of a worker's cache of encoded pieces; beyond it the cache starts anew.
CACHE_ENTRIES = 300_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class PairIndex:
    """Merges by rank over many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.ranks: dict[int, int] = {}  # by both ids in one number
        self.made: list[int] = []
        self.parts: list[tuple[int, int]] = []
        for pair in merges:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], len(self.made))
            self.parts.append((vocab[a], vocab[b]))
            self.made.append(vocab[a + b])
        names = byte_symbols()
        self.inner = [vocab[c] for c in names]
        self.last = [vocab[c + suffix] for c in names]

    def encode(self, words: list[str]) -> list[list[int]]:
        symbols: list[int] = []
        after: list[int] = []
        before: list[int] = []
        starts: list[int] = []
        inner, last, rank_of = self.inner, self.last, self.ranks.get
        where: dict[int, list[int]] = {}
        for word in words:
            raw, at = word.encode(), len(symbols)
            starts.append(at)
            symbols += [inner[b] for b in raw[:-1]]
            symbols.append(last[raw[-1]])
            end = at + len(raw)
            after += range(at + 1, end)
            after.append(-1)
            before.append(-1)
            before += range(at, end - 1)
            a = symbols[at]
            for p in range(at, end - 1):
                b = symbols[p + 1]
                r = rank_of(a << 32 | b)
                if r is not None:
                    if r in where:
                        where[r].append(p)
                    else:
                        where[r] = [p]
                a = b
        active = list(where)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            (a, b), made = self.parts[r], self.made[r]
            for p in sorted(where.pop(r)):
                q = after[p]
                if symbols[p] != a or q < 0 or symbols[q] != b:
                    continue  # another merge took one of the two
                symbols[p], symbols[q] = made, -1
                after[p] = n = after[q]
                if n >= 0:
                    before[n] = p
                    s = rank_of(made << 32 | symbols[n])
                    if s is not None:
                        if s in where:
                            where[s].append(p)
                        else:
                            where[s] = [p]
                            heapq.heappush(active, s)
                m = before[p]
                if m >= 0:
                    s = rank_of(symbols[m] << 32 | made)
                    if s is not None:
                        if s in where:
                            where[s].append(m)
                        else:
                            where[s] = [m]
                            heapq.heappush(active, s)
        starts.append(len(symbols))
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def ranges(codes: list[int]) -> str:
    """Code points in ascending order as ranges of a pattern's set."""
    found: list[list[int]] = []
    for c in codes:
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def latin(text: str) -> bool:
    """Whether all characters are among the first 256, which all Unicode versions know."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Bpe:
    """Encoder and decoder of a word-end vocabulary file."""

    #: The file's own pattern of words (fixed value).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pairs = PairIndex(self.vocab, model["merges"], model["end_of_word_suffix"] or "")
        self.names = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for name, k in [*self.vocab.items(), *self.special.items()]:
            self.names[k] = name
        self._classes(path)
        self.blank = regex.compile(r"\s+")
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _classes(self, path: str) -> None:
        """Patterns of words: the file's own, and one for pieces with characters of Unicode versions
        later than that of unicodedata, each of which the library is asked about."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalized = library.normalizer.normalize_str
        parts = library.pre_tokenizer.pre_tokenize_str
        every = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(128, 0xD800), *range(0xE000, sys.maxunicode + 1)])))
        kinds: dict[str, list[int]] = {"letter": [], "other": [], "digit": []}
        for c in every:
            if unicodedata.category(c) == "Cn":
                kinds["letter" if len(parts(f"a{c}")) == 1 else "other" if len(parts(f"!{c}")) == 1 else "digit"].append(ord(c))
        letter, other, digit = map(ranges, kinds.values())
        later = "".join((letter, other, digit))
        self.words = regex.compile(self.PATTERN)
        self.later = regex.compile(f"[{later}]" if later else r"(?!)")
        own = self.PATTERN.replace(r"[\p{L}]", rf"[[\p{{L}}--[\x00{later}]]||[{letter or 'a'}]]").replace(r"[\p{N}]", rf"[[\p{{N}}--[\x00{later}]]||[{digit or '0'}]]")
        self.later_words = regex.compile(own.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{other or '!'}]]"), regex.V1)

    def _pieces(self, text: str) -> list[str]:
        """Parts between white space, in composed form and lower case."""
        if not text.isascii():
            if not latin(text) and self.later.search(text):
                return [p for p in self.normalized(text).split(" ") if p]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split alone
            return [p for p in self.blank.split(text) if p]
        return text.split()

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        found = [(self.words if latin(p) or not self.later.search(p) else self.later_words).findall(p) for p in new]
        distinct = list(dict.fromkeys(w for ws in found for w in ws))
        ids = dict(zip(distinct, self.pairs.encode(distinct), strict=True))
        for p, ws in zip(new, found, strict=True):
            self.known[p] = np.array([k for w in ws for k in ids[w]], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        parts = []
        for text in texts:
            if "<|" in text and self.split_special:
                parts.append([p if p in self.special else self._pieces(p) for p in self.split_special.split(text)])
            else:
                parts.append([self._pieces(text)])
        self._learn(set().union(*(p for ps in parts for p in ps if not isinstance(p, str))))
        get = self.known.__getitem__
        return [b"".join(np.array([self.special[p]], "<u4").tobytes() if isinstance(p, str) else b"".join(map(get, p)) for p in ps) for ps in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids: the vocabulary file names no decoder, so its tokens with a space between."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    """One per Python worker."""
    if path not in _codecs:
        _codecs[path] = Bpe(path)
    return _codecs[path]


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the ids of docs(doc_id, text), as an array of integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            found = codec(tokenizer).encode([t or "" for t in chunk.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.frombuffer(b"".join(found), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), ids], ["doc_id", "ids"])

    return bounded(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text of ids(doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(tokenizer).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode docs(doc_id, text), decode the ids again, and return digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in row_chunks(batches, "text"):
            bpe = codec(tokenizer)
            found = bpe.encode([t or "" for t in chunk.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column("doc_id"),
                    pa.array([len(b) // 4 for b in found], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in found]),
                    pa.array([hashlib.sha256(bpe.decode(b).encode()).hexdigest() for b in found]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec(tokenizer).known.clear()  # the worker lives on, and what it does next needs the memory

    return bounded(docs).select("doc_id", "text").mapInArrow(run, SCHEMA)
