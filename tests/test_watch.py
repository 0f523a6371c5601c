"""A watched folder against a batch ingest of it."""

import os

from estimora.sources import vectors
from estimora.streaming import watch


def test_three_triggers(spark, tmp_path):
    root, path, state = tmp_path / "kb", str(tmp_path / "v"), str(tmp_path / "state")
    (root / "articles").mkdir(parents=True)
    (root / "articles/a.md").write_text("# A\n" + "word " * 500)
    (root / "b.txt").write_text("B")
    (root / "touched.md").write_text("same")
    (root / "d.html").write_text("<p>")
    counts, batch = [], str(tmp_path / "batch")

    def run():
        q = watch.watched(spark, str(root), path, state, told=counts.append)
        q.awaitTermination(120)
        assert q.exception() is None
        watch.ingested(spark, str(root), batch)
        rows = lambda p: sorted(tuple(r) for r in vectors.current(spark, p).select("id", "text", "source", "category", "filename", "digest", "embedding").collect())
        assert rows(path) == rows(batch)
        return {r[2] for r in rows(path)}

    assert run() == {"articles/a.md", "b.txt", "touched.md"} and counts == [{"embedded": 5, "removed": 0, "kept": 0}]
    (root / "b.txt").write_text("B, changed")
    (root / "c.md").write_text("C")
    os.utime(root / "touched.md", (1, 1))
    assert run() == {"articles/a.md", "b.txt", "c.md", "touched.md"} and counts[1:] == [{"embedded": 2, "removed": 0, "kept": 4}]
    (root / "articles/a.md").unlink()
    (root / "c.md").write_bytes(b"\xff\xfe")
    assert run() == {"b.txt", "touched.md"} and counts[2:] == [{"embedded": 0, "removed": 4, "kept": 2}]
    (root / "c.md").write_text("C again")
    assert run() == {"b.txt", "c.md", "touched.md"}
