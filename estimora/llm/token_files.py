"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped reading.

Documents are ordered by id over all partitions, each partition writes one file of ids and one
index, and the place of a file among all ids is a prefix sum over the files' totals. Defined
results: a null text is an empty one and has the end id alone; rows of equal or null ids are all
written (nulls first, ties by text); texts of any length are encoded whole; an empty table makes no
file. Other columns are ignored.

Layout of NAME.idx, little-endian: uint64 number of documents n, n+1 uint64 offsets in ids from
the start of NAME.bin, n int64 document ids, n bytes that are 1 where the id is null.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from estimora.llm.arrays import row_chunks
from estimora.llm.shared import bounded, file_system, new_path, saved

MANIFEST = "part int, name string, n_docs long, n_ids long"
#: Entries of a worker's cache of encoded pieces; beyond it a new one starts, which takes over from
#: the one before what is met again.
CACHE_ENTRIES = 350_000
#: New pieces that the library is given as one text.
PIECES_AT_ONCE = 500


class PieceEncoder:
    """The library's ids of a text, from the ids of its pieces between spaces.

    A space before a piece is part of its first token, and no token crosses such a space unless
    white space stands on both of its sides, so pieces can be encoded apart and kept. Texts with
    such a space or with a special token's string are encoded whole.
    """

    _alone = re.compile(r"\s \s")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        # tokens that begin with a space, which is where a piece begins if no other white space is near
        self.opens = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.opens[[k for t, k in self.tokenizer.get_vocab().items() if t[0] == "Ġ"]] = True
        self.later: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.type.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _after_space(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece with a space before it. Pieces without white space at their ends are
        encoded many at once and told apart by the tokens that begin with a space."""
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        alone, found = list(set(pieces).difference(plain)), {}
        groups = [plain[a : a + PIECES_AT_ONCE] for a in range(0, len(plain), PIECES_AT_ONCE)]
        for group, raw in zip(groups, self._whole([" " + " ".join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.opens[np.frombuffer(raw, self.type)]) * self.type.itemsize
            if len(at) == len(group):
                at = [*at.tolist(), len(raw)]
                found.update((p, raw[a:b]) for p, a, b in zip(group, at, at[1:], strict=False))
            else:
                alone += group
        found.update(zip(alone, self._whole([" " + p for p in alone]), strict=True))
        return found

    def _learn(self, known: dict[str, bytes], past: dict[str, bytes], pieces: set[str]) -> None:
        new = pieces.difference(known)
        again = past.keys() & new
        known.update((p, past[p]) for p in again)
        known.update(self._after_space(list(new - again)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.later) > CACHE_ENTRIES:
            self.later, self.past = {}, self.later
        if len(self.first) > CACHE_ENTRIES:
            self.first.clear()
        out: list[bytes] = [b""] * len(texts)
        split, whole = {}, []
        for k, text in enumerate(texts):
            if self._alone.search(text) or any(s in text for s in self.special):
                whole.append(k)
            elif text:
                split[k] = text.split(" ")
        new = list({p[0] for p in split.values()}.difference(self.first))
        self.first.update(zip(new, self._whole(new), strict=True))
        self._learn(self.later, self.past, set().union(*(p[1:] for p in split.values())))
        for k, pieces in split.items():
            out[k] = self.first[pieces[0]] + b"".join(map(self.later.__getitem__, pieces[1:]))
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One per Python worker: reading the vocabulary takes longer than many a task."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the ids of docs(doc_id, text) to `folder`; a row for each file, with its place among all.

    A task names its files anew at each attempt, and only those of the attempt that the manifest
    holds are read, so a task that is run twice does no harm.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, store = encoder(tokenizer), file_system(folder)
        name, end = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", np.array([end_id], encoder(tokenizer).type).tobytes()
        store[0].create_dir(store[1], recursive=True)
        ids, nulls, sizes, out = [], [], [], None
        for chunk in row_chunks(batches, "text"):
            out = out or store[0].open_output_stream(f"{store[1]}/{name}.bin")
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            for b in enc.encode(texts):
                out.write(b + end)
                sizes.append(len(b) // enc.type.itemsize + 1)
            ids.append(chunk.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
            nulls.append(chunk.column("doc_id").is_null().to_numpy(zero_copy_only=False))
        if out:
            out.close()
            offsets = np.concatenate([[0], np.cumsum(sizes, dtype="<u8")]).astype("<u8")
            with store[0].open_output_stream(f"{store[1]}/{name}.idx") as index:
                for x in (np.array([len(sizes)], "<u8"), offsets, np.concatenate(ids).astype("<i8"), np.concatenate(nulls).astype("u1")):
                    index.write(x.tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n_docs": [len(sizes)], "n_ids": [int(offsets[-1])]})

    ordered = bounded(docs).select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    manifest = saved(ordered.mapInArrow(write, MANIFEST), "manifest")
    # a row for each file: few, however many documents there are
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def mapped(store, path: str) -> np.ndarray:
    """The bytes of a file: memory-mapped where it is local, read otherwise."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), np.uint8)


def read_token_files(manifest: DataFrame, folder: str, itemsize: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of a manifest."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            for file in batch.to_pylist():
                index = mapped(store, f"{base}/{file['name']}.idx")
                ids = mapped(store, f"{base}/{file['name']}.bin").view(f"<u{itemsize}")
                n = int(index[:8].view("<u8")[0])
                offsets = index[8 : 16 + 8 * n].view("<u8").astype(np.int64)
                doc_ids, nulls = index[16 + 8 * n : 16 + 16 * n].view("<i8"), index[16 + 16 * n :].astype(bool)
                for a in range(0, n, 10_000):
                    b = min(n, a + 10_000)
                    crc = [zlib.crc32(ids[offsets[k] : offsets[k + 1]].astype("<u4")) for k in range(a, b)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:b], mask=nulls[a:b]), pa.array(offsets[a:b] + file["base"]), pa.array(np.diff(offsets[a : b + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number of its own: rows of a manifest are small, and their size says nothing of the work
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(tasks, "part").mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs(doc_id, text) as token-id files to the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, tokenizer, folder, end_id)
    return read_token_files(manifest, folder, encoder(tokenizer).type.itemsize)
