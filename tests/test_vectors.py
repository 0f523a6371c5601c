"""Incremental changes of a namespace of vectors."""

import pytest
from pyspark.sql import functions as F

from estimora.operators import embedding
from estimora.sources import vectors

SCHEMA = "doc_id string, chunk_no int, text string, source string, category string, filename string"


def rows_of(texts):
    return [(s, k, t, s, "General", s) for s, parts in texts.items() for k, t in enumerate(parts)]


def test_upsert(spark, tmp_path):
    path, seen = str(tmp_path / "v"), []

    def embed(rows):
        seen.append(rows.count())
        return embedding.hashed(rows)

    def held():
        found = vectors.current(spark, path)
        assert found.filter("size(embedding) <> 384").count() == 0
        return {(r["source"], r["chunk_no"], r["text"]) for r in found.collect()}

    def put(texts, sources=None):
        given = None if sources is None else spark.createDataFrame([(s,) for s in sources], "source string")
        return vectors.upsert(spark.createDataFrame(rows_of(texts), SCHEMA), path, embed, sources=given)

    first = {f"s{k}": [f"text {k} {j}" for j in range(3)] for k in range(40)}
    assert put(first) == {"embedded": 120, "removed": 0, "kept": 0} and held() == {r[3:4] + r[1:3] for r in rows_of(first)}
    assert put(first) == {"embedded": 0, "removed": 0, "kept": 120}  # the second run embeds nothing
    assert vectors.version(spark, path)[0] == 1 and seen == [120]
    before = vectors.current(spark, path)
    # one source changes a chunk and loses one, one comes, others stay as they are not named
    assert put({"s1": ["text 1 0", "new"], "t": ["only"]}, ["s1", "t"]) == {"embedded": 2, "removed": 1, "kept": 118}
    after = {**first, "s1": ["text 1 0", "new"], "t": ["only"]}
    assert held() == {r[3:4] + r[1:3] for r in rows_of(after)}
    assert before.count() == 120 and before.filter("text = 'new'").count() == 0  # a reader keeps its version
    number, buckets = vectors.version(spark, path)
    assert number == 2 and len(set(buckets.values())) == 2  # buckets without a change weren't written again
    assert put({}, ["s2"])["removed"] == 3 and held() == {r[3:4] + r[1:3] for r in rows_of({k: v for k, v in after.items() if k != "s2"})}
    assert put({"z": ["last"]}) == {"embedded": 1, "removed": 117, "kept": 0}
    assert held() == {("z", 0, "last")} and vectors.vacuum(spark, path) > 0 and held() == {("z", 0, "last")}
    assert put({})["removed"] == 1 and held() == set()


def test_vectors_are_made_where_their_rows_are_written(spark, tmp_path):
    """Rows with vectors aren't shuffled: those that are new are dealt before, those that stay are filtered where they lie."""
    path, plans = str(tmp_path / "v"), []

    def embed(rows):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return embedding.hashed(rows)

    texts = {f"s{k}": ["a", "b"] for k in range(200)}
    put = lambda t: vectors.upsert(spark.createDataFrame(rows_of(t) + rows_of(t)[:3], SCHEMA), path, embed)  # noqa: E731  ids that come twice
    assert put(texts) == {"embedded": 400, "removed": 0, "kept": 0}
    assert put({**{f"s{k}": ["a", "c"] for k in range(150)}, **{f"s{k}": ["a"] for k in range(150, 200)}}) == {"embedded": 150, "removed": 50, "kept": 200}
    assert all(p.startswith("RepartitionByExpression") for p in plans) and len(plans) == 2
    found = vectors.current(spark, path).groupBy("text").count().collect()
    assert dict(map(tuple, found)) == {"a": 200, "c": 150}


def test_a_run_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    rows = lambda t: spark.createDataFrame(rows_of({"a": [t]}), SCHEMA)
    vectors.upsert(rows("one"), path, embedding.hashed)

    def broken(found):
        return found.withColumn("embedding", F.array(F.raise_error(F.lit("no model")).cast("float")))

    with pytest.raises(Exception, match="no model"):
        vectors.upsert(rows("two"), path, broken)
    assert [r["text"] for r in vectors.current(spark, path).collect()] == ["one"]
    # another writer is first
    real = vectors.version
    stale = real(spark, path)
    vectors.upsert(rows("two"), path, embedding.hashed)
    monkeypatch.setattr(vectors, "version", lambda *a: stale)
    with pytest.raises(RuntimeError, match="another run"):
        vectors.upsert(rows("three"), path, embedding.hashed)
    monkeypatch.setattr(vectors, "version", real)
    assert [r["text"] for r in vectors.current(spark, path).collect()] == ["two"]
    # a version that is only begun doesn't count, and the next run goes on behind it
    (tmp_path / "v/namespace=knowledge-base/version-0000000003").write_text('{"1": "data-')
    assert [r["text"] for r in vectors.current(spark, path).collect()] == ["two"]
    vectors.upsert(rows("four"), path, embedding.hashed)
    assert vectors.version(spark, path)[0] == 4 and [r["text"] for r in vectors.current(spark, path).collect()] == ["four"]
