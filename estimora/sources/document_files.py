"""A folder of documents as a data source: `spark.read.format("document_files").load(root)` and
`df.write.format("document_files").mode("append").save(folder)`, once register() was called.

Reading. Partitions are planned by bytes from a listing of the tree. Symbolic links and files whose
name begins with a dot are no documents, nor are files without a loader for their suffix. A loader
turns bytes into a text or a list of texts (pages); a file whose loader fails is a row with an error
and no text. The options suffix, category and filename (values with commas between them) leave other
files out of the plan; partition_bytes and partition_files bound a partition.

Writing. Rows are (file_name, body). A task writes to a folder of its attempt; when all tasks have
ended, the commit notes the attempts that count in a file, moves their files to their names and
removes the note and the rest. So a task that fails or runs twice leaves nothing behind, and a commit
that breaks off is completed by the next one, or by recovered(). Mode append replaces files of equal
names, overwrite also removes all others.

Defined results: rows with a null name or body are not written; of rows of one task with one name the
last counts, so write_documents() makes names unique first; a name with a slash, or that begins with a
dot or with what notes and attempts are called, is an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from estimora.sources.shared import file_system

#: Category of a folder name (fixed values).
CATEGORIES = (("standards", "Standard"), ("methodologies", "Methodology"), ("articles", "Article"), ("expert_knowledge", "Expert Knowledge"))
SCHEMA = "source string, filename string, suffix string, category string, page int, text string, error string"
#: Bytes and files of a partition, at most unless it is one file, and bytes of texts of a batch of rows.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 64_000_000, 10_000, 8_000_000
#: How attempts and notes are called, moves at once, and those of one call.
ATTEMPTS, NOTE, MOVES_AT_ONCE, MOVES_IN_A_RUN = "_attempts-", "_commit-", 16, 200

Loader = Callable[[bytes], "str | list[str]"]


def utf8(content: bytes) -> str:
    return content.decode("utf-8")


LOADERS: dict[str, Loader] = {"md": utf8, "txt": utf8}


def category_of(source: str) -> str:
    """The category of the first folder in a path that has one, else General."""
    known = dict(CATEGORIES)
    return next((known[p] for p in source.split("/") if p in known), "General")


def listed(root: str) -> list[tuple[str, int, int]]:
    """(path below root, bytes, time of change) of all files under root in order, without links."""
    from pyarrow import fs

    store, base = file_system(root)
    base = base.rstrip("/")
    if not isinstance(store, fs.LocalFileSystem):
        found = store.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f.path[len(base) + 1 :], f.size, f.mtime_ns) for f in found if f.is_file)
    out = []
    for top, folders, names in os.walk(base):
        folders[:] = [d for d in folders if not os.path.islink(f"{top}/{d}")]
        for name in names:
            path = f"{top}/{name}"
            if not os.path.islink(path):
                about = os.stat(path)
                out.append((path[len(base) + 1 :], about.st_size, about.st_mtime_ns))
    if not os.path.isdir(base):
        raise FileNotFoundError(base)
    return sorted(out)


@dataclass
class Files(InputPartition):
    sources: list[str]


def dealt(files: list[tuple[str, int]], most_bytes: int, most_files: int) -> list[list[str]]:
    """Runs of files in order, cut before they hold more than so many bytes or files."""
    out: list[list[str]] = []
    size = 0
    for name, n in files:
        if not out or size + n > most_bytes or len(out[-1]) == most_files:
            out.append([])
            size = 0
        out[-1].append(name)
        size += n
    return out


class FilesReader(DataSourceReader):
    def __init__(self, root: str, loaders: dict[str, Loader], most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES, wanted: dict[str, list[str]] | None = None):
        self.root, self.loaders, self.most_bytes, self.most_files, self.wanted = root, loaders, most_bytes, most_files, wanted or {}

    def about(self, source: str) -> tuple[str, str, str, str]:
        """Source, filename, suffix and category."""
        name = source.rpartition("/")[2]
        return source, name, name.rpartition(".")[2].lower() if "." in name else "", category_of(source)

    def found(self) -> Iterator[tuple[str, int, int]]:
        """The listed files that are documents, and that no option leaves out."""
        for source, size, time in listed(self.root):
            _, name, suffix, category = self.about(source)
            have = {"suffix": suffix, "category": category, "filename": name}
            if suffix in self.loaders and not name.startswith(".") and not source.startswith((ATTEMPTS, NOTE)) and all(have[k] in values for k, values in self.wanted.items()):
                yield source, size, time

    def partitions(self) -> list[Files]:
        return [Files(x) for x in dealt([f[:2] for f in self.found()], self.most_bytes, self.most_files)]

    def rows(self, sources: list[str]) -> Iterator[tuple]:
        """The columns of SCHEMA, and the digest of the file."""
        store, base = file_system(self.root)
        for source in sources:
            about, digest = self.about(source), None
            try:
                with store.open_input_file(f"{base.rstrip('/')}/{source}") as f:
                    content = f.read()
                digest = hashlib.sha256(content).hexdigest()
                texts = self.loaders[about[2]](content)
                found = [(*about, k, t, None, digest) for k, t in enumerate([texts] if isinstance(texts, str) else texts)]
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row that says so
                found = [(*about, None, None, f"{type(e).__name__}: {e}", digest)]
            yield from found

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.string()) for x in SCHEMA.split(", ")])
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for row in self.rows(partition.sources):
            held.append(row[:7])
            size += len(row[5] or "")
            if size >= BATCH_BYTES or len(held) >= 10_000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    n_files: int


def _moved(store, source: str, target: str) -> None:
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        os.replace(source, target)
        return
    if store.get_file_info(target).is_file:
        store.delete_file(target)
    store.move(source, target)


def _complete(store, base: str, note: str, attempts: list[str], overwrite: bool) -> None:
    """What a commit does once its note is written; to do it again, or from the middle on, does no harm."""
    from pyarrow import fs

    moves, names = [], set()
    for a in attempts:
        for f in store.get_file_info(fs.FileSelector(a, allow_not_found=True)):
            moves.append((f.path, f"{base}/{f.base_name}"))
            names.add(f.base_name)
    if overwrite:
        # files of this commit that were moved before are in the note's list
        with store.open_input_file(f"{base}/{note}") as f:
            names |= set(json.loads(f.read())["names"])
        for f in store.get_file_info(fs.FileSelector(base)):
            if f.is_file and f.base_name not in names and not f.base_name.startswith(NOTE):
                store.delete_file(f.path)
    with ThreadPoolExecutor(MOVES_AT_ONCE) as pool:
        # a run of moves is one call: a call for each costs more than a move
        list(pool.map(lambda a: [_moved(store, *m) for m in moves[a : a + MOVES_IN_A_RUN]], range(0, len(moves), MOVES_IN_A_RUN)))
    if attempts:
        store.delete_dir(attempts[0].rpartition("/")[0])
    store.delete_file(f"{base}/{note}")


def recovered(folder: str) -> int:
    """Complete the commits to a folder that broke off; their number."""
    from pyarrow import fs

    store, base = file_system(folder)
    base = base.rstrip("/")
    notes = [f.base_name for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith(NOTE) and f.base_name.endswith(".json")]
    for note in notes:
        with store.open_input_file(f"{base}/{note}") as f:
            what = json.loads(f.read())
        _complete(store, base, note, what["attempts"], what["overwrite"])
    return len(notes)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, base = file_system(self.folder)
        attempt = f"{base.rstrip('/')}/{ATTEMPTS}{self.job}/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        n = 0
        try:
            for batch in iterator:
                for name, body in zip(batch.column("file_name").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    if name is None or body is None:
                        continue
                    if not name or "/" in name or name.startswith((".", ATTEMPTS, NOTE)):
                        raise ValueError(f"no name of a document: {name!r}")
                    with store.open_output_stream(f"{attempt}/{name}") as out:
                        out.write(body.encode())
                    n += 1
        except BaseException:
            store.delete_dir(attempt)
            raise
        return Attempt(attempt, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow import fs

        recovered(self.folder)
        store, base = file_system(self.folder)
        base = base.rstrip("/")
        attempts = [m.folder for m in messages if m]
        names = [f.base_name for a in attempts for f in store.get_file_info(fs.FileSelector(a, allow_not_found=True))] if self.overwrite else []
        # the note gets its name when it is whole
        note, draft = f"{NOTE}{self.job}.json", f"{NOTE}{self.job}.draft"
        with store.open_output_stream(f"{base}/{draft}") as out:
            out.write(json.dumps({"attempts": attempts, "overwrite": self.overwrite, "names": names}).encode())
        store.move(f"{base}/{draft}", f"{base}/{note}")
        _complete(store, base, note, attempts, self.overwrite)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = file_system(self.folder)
        folder = f"{base.rstrip('/')}/{ATTEMPTS}{self.job}"
        if store.get_file_info(folder).type.name == "Directory":
            store.delete_dir(folder)


@dataclass
class Change(InputPartition):
    sources: list[str]
    vanished: bool


CHANGES = SCHEMA + ", vanished boolean, digest string"


class FilesWatcher(DataSourceStreamReader):
    """A stream of changes of a tree: rows of files that are new or have another size or time, and a row
    for each that has vanished. An offset is the number of a listing, which lies in the folder `state`
    until the batch that it ends is committed; what a batch holds is the difference of two listings."""

    def __init__(self, reader: FilesReader, state: str):
        self.reader, self.state = reader, state
        self.now: int | None = None

    def _listing(self, number: int) -> dict[str, list]:
        store, base = file_system(self.state)
        if not number:
            return {}
        with store.open_input_file(f"{base}/listing-{number:010d}.json") as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, base = file_system(self.state)
        store.create_dir(base, recursive=True)
        if self.now is None:
            have = [f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("listing-") and f.base_name.endswith(".json")]
            self.now = max((int(x[8:18]) for x in have), default=0)
        found = {source: [size, time] for source, size, time in self.reader.found()}
        if found != self._listing(self.now):
            draft = f"{base}/draft-{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(json.dumps(found).encode())
            store.move(draft, f"{base}/listing-{self.now + 1:010d}.json")
            self.now += 1
        return {"listing": self.now}

    def partitions(self, start: dict, end: dict) -> list[Change]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        changed = [(s, x[0]) for s, x in sorted(after.items()) if before.get(s) != x]
        gone = [(s, 0) for s in sorted(before) if s not in after]
        cut = lambda files: dealt(files, self.reader.most_bytes, self.reader.most_files)
        return [Change(x, False) for x in cut(changed)] + [Change(x, True) for x in cut(gone)]

    def read(self, partition: Change) -> Iterator[tuple]:
        if partition.vanished:
            for source in partition.sources:
                yield (*self.reader.about(source), None, None, None, True, None)
        else:
            for row in self.reader.rows(partition.sources):
                yield (*row[:7], False, row[7])

    def commit(self, end: dict) -> None:
        from pyarrow import fs

        store, base = file_system(self.state)
        for f in store.get_file_info(fs.FileSelector(base)):
            if f.base_name.startswith("listing-") and int(f.base_name[8:18]) < end["listing"]:
                store.delete_file(f.path)


class DocumentFiles(DataSource):
    loaders = LOADERS

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return CHANGES if "state" in self.options else SCHEMA

    def streamReader(self, schema) -> FilesWatcher:
        return FilesWatcher(self.reader(schema), self.options["state"])

    def reader(self, schema) -> FilesReader:
        wanted = {k: self.options[k].split(",") for k in ("suffix", "category", "filename") if k in self.options}
        return FilesReader(self.options["path"], self.loaders, int(self.options.get("partition_bytes", PARTITION_BYTES)), int(self.options.get("partition_files", PARTITION_FILES)), wanted)

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession, loaders: dict[str, Loader] | None = None) -> None:
    """Make the format known to a session, with further loaders by suffix; a suffix's last loader counts."""
    kind = type("DocumentFiles", (DocumentFiles,), {"loaders": {**LOADERS, **(loaders or {})}}) if loaders else DocumentFiles
    spark.dataSource.register(kind)


def read_documents(spark: SparkSession, root: str, loaders: dict[str, Loader] | None = None, **options):
    """(documents, skipped) under root: source, filename, suffix, category, page and text of what loads,
    and filename and error of what doesn't."""
    register(spark, loaders)
    rows = spark.read.format("document_files").options(**options).load(root)
    return rows.filter("text IS NOT NULL").drop("error"), rows.filter("error IS NOT NULL").select("filename", "error")
