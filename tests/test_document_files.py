"""Folders of documents as a data source: reading, and writing with a commit."""

import pytest
from pyspark.sql import functions as F

from estimora.operators import report
from estimora.sources import corpus, document_files


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "kb"
    for name, text in (("standards/a.md", "# A"), ("articles/x/b.TXT", "B é"), ("other/c.md", "C" * 3000), ("other/d.html", "<p>"), ("other/.e.md", "E"), ("other/f.pdf", "%PDF"), ("other/_g.md", "G"), ("h.md", "")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "other/bad.txt").write_bytes(b"\xff\xfe\xff")
    (root / "other/link.md").symlink_to(root / "standards/a.md")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/h.md").write_text("H")
    (root / "linked").symlink_to(tmp_path / "out")
    return root


@pytest.fixture
def pages():
    def loader(content):
        if content == b"%PDF":
            return ["page 1", "page 2"]
        raise ValueError("broken")

    return loader


@pytest.mark.parametrize("options", [{}, {"partition_bytes": "4"}, {"partition_files": "1"}])
def test_reader(spark, tree, pages, options):
    docs, skipped = document_files.read_documents(spark, str(tree), {"pdf": pages}, **options)
    want = {("standards/a.md", "Standard", 0, "# A"), ("articles/x/b.TXT", "Article", 0, "B é"), ("other/c.md", "General", 0, "C" * 3000), ("other/f.pdf", "General", 0, "page 1"), ("other/f.pdf", "General", 1, "page 2"), ("other/_g.md", "General", 0, "G"), ("h.md", "General", 0, "")}
    assert {(r["source"], r["category"], r["page"], r["text"]) for r in docs.collect()} == want
    assert [(r["filename"], r["error"][:18]) for r in skipped.collect()] == [("bad.txt", "UnicodeDecodeError")]
    # the scan of columns finds the same texts, but for empty files and names with an underscore, which Spark hides
    scan, _ = corpus.documents(spark, str(tree), pages)
    columns = ("source", "filename", "category", "text")
    assert {tuple(r) for r in scan.select(*columns).collect()} == {tuple(r) for r in docs.filter("filename NOT IN ('_g.md', 'h.md')").select(*columns).collect()}
    assert docs.rdd.getNumPartitions() == (7 if "partition_files" in options else docs.rdd.getNumPartitions())


def test_reader_leaves_files_out(spark, tree, pages):
    """What options leave out isn't in the plan, so it isn't read."""
    docs, skipped = document_files.read_documents(spark, str(tree), {"pdf": pages}, suffix="pdf,md", category="General,Article")
    assert {r["source"] for r in docs.collect()} == {"other/c.md", "other/f.pdf", "other/_g.md", "h.md"} and not skipped.count()
    reader = document_files.FilesReader(str(tree), document_files.LOADERS, wanted={"suffix": ["txt"]})
    assert [p.sources for p in reader.partitions()] == [["articles/x/b.TXT", "other/bad.txt"]]
    with pytest.raises(Exception, match="FileNotFoundError"):
        document_files.read_documents(spark, str(tree / "none"))[0].collect()


def contents(folder):
    return {p.name: p.read_text() for p in folder.iterdir()}


def test_writer(spark, tmp_path):
    at = F.to_timestamp(F.lit("2026-02-23 12:00:00"))
    docs = spark.createDataFrame([("risk_register", "A b/c", "Risks"), ("test_plan", "é", "Plan"), ("test_plan", "none", None)], "document_type string, project_name string, body string").withColumn("generated_at", at)
    out = tmp_path / "out"
    for _ in range(2):  # a repeated run equals one run
        report.write_documents(report.named(docs), str(out))
        found = contents(out)
        assert found.keys() == {"risk_register_A_b_c_20260223_120000.md", "test_plan_é_20260223_120000.md"}
        assert found["test_plan_é_20260223_120000.md"] == "---\ngenerated_by: estimora\ndate: 2026-02-23 12:00\nproject: é\ndocument_type: test_plan\n---\n\nPlan"
    report.write_documents(spark.createDataFrame([("x.md", "X")], "file_name string, body string"), str(out), "overwrite")
    assert contents(out) == {"x.md": "X"}
    back, _ = document_files.read_documents(spark, str(out))
    assert [(r["source"], r["text"]) for r in back.collect()] == [("x.md", "X")]


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, mode):
    out = tmp_path / "out"
    report.write_documents(spark.createDataFrame([("x.md", "old")], "file_name string, body string"), str(out))
    rows = spark.createDataFrame([(f"{k}.md" if k != 7 else "a/b.md", "new") for k in range(9)] + [("x.md", "new")], "file_name string, body string").repartition(5)
    with pytest.raises(Exception, match="no name of a document"):
        report.write_documents(rows, str(out), mode)
    assert contents(out) == {"x.md": "old"}


@pytest.mark.parametrize("overwrite", [False, True])
@pytest.mark.parametrize("done", [0, 1, 3])
def test_a_commit_that_broke_off_is_completed(tmp_path, monkeypatch, overwrite, done):
    """The driver is lost after some moves: the note lets the next commit do the rest."""
    import pyarrow as pa

    out = tmp_path / "out"
    out.mkdir()
    (out / "old.md").write_text("old")
    (out / "0.md").write_text("old")
    writer, moved = document_files.FilesWriter(str(out), overwrite), []
    of = lambda a, b: pa.RecordBatch.from_pydict({"file_name": [f"{k}.md" for k in range(a, b)], "body": ["new"] * (b - a)})
    attempts = [writer.write(iter([of(0, 2)])), writer.write(iter([of(2, 4)]))]
    writer.write(iter([of(0, 9)]))  # an attempt that doesn't count
    real = document_files._moved

    def some(store, source, target):
        if len(moved) >= done:
            raise OSError("lost")
        moved.append(target)
        real(store, source, target)

    monkeypatch.setattr(document_files, "MOVES_AT_ONCE", 1)
    monkeypatch.setattr(document_files, "_moved", some)
    with pytest.raises(OSError):
        writer.commit([*attempts, None])
    monkeypatch.setattr(document_files, "_moved", real)
    assert document_files.recovered(str(out)) == 1 and document_files.recovered(str(out)) == 0
    want = {f"{k}.md": "new" for k in range(4)} | ({} if overwrite else {"old.md": "old"})
    assert contents(out) == want


def test_partitions_by_bytes():
    files = [(f"f{k}", n) for k, n in enumerate([5, 5, 20, 1, 1, 1, 0])]
    assert document_files.dealt(files, 10, 100) == [["f0", "f1"], ["f2"], ["f3", "f4", "f5", "f6"]]
    assert document_files.dealt(files, 100, 3) == [["f0", "f1", "f2"], ["f3", "f4", "f5"], ["f6"]]
    assert document_files.dealt([], 10, 10) == []


def test_moves_of_a_commit_are_few_calls(tmp_path, monkeypatch):
    calls = []

    class Pool(document_files.ThreadPoolExecutor):
        def map(self, f, runs):
            calls.extend(runs := list(runs))
            return super().map(f, runs)

    monkeypatch.setattr(document_files, "ThreadPoolExecutor", Pool)
    attempt = tmp_path / "_attempts-j/a"
    attempt.mkdir(parents=True)
    for k in range(1001):
        (attempt / f"{k}.md").write_text(str(k))
    (tmp_path / "5.md").write_text("old")
    (tmp_path / "_commit-j.json").write_text('{"names": []}')
    store, base = document_files.file_system(str(tmp_path))
    document_files._complete(store, base, "_commit-j.json", [str(attempt)], False)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {f"{k}.md": str(k) for k in range(1001)} and len(calls) < 10
