"""Pruned searches against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from estimora.operators import cells, lexical, retrieval


def clustered(n, dims, groups, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * spread


def test_cells_by_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "FILE_ROWS", 70)
    for spread, most_share in ((0.05, 0.2), (5.0, 1.0)):  # clustered, and hardly so
        x = clustered(3000, 16, 40, 1, spread)
        rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, x[7].tolist()), (None, x[3].tolist()), (5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0])]
        vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(60, 16, 40, 1, spread))] + [(100, x[7].tolist()), (101, None), (102, [0.0] * 16), (103, [1.0]), (None, x[0].tolist())], "query_id long, query array<double>")
        index = cells.build(vectors)
        hits, visits = cells.search(index, queries, 5)
        want = retrieval.top_k(queries.filter("query_id IS NOT NULL AND query_id <> 103"), vectors, 5)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in hits.collect()}
        assert got == {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in want.collect()} and len(got) == 61 * 5
        assert [got[100, k][0] for k in (1, 2)] == [7, 5000]
        compared = visits.agg(F.sum("n")).first()[0]
        assert compared <= most_share * 61 * 3001 and visits.count() == visits.distinct().count()
    empty, _ = cells.search(cells.build(vectors.limit(0)), queries, 5)
    assert empty.count() == 0 == cells.search(index, queries.limit(0), 5)[0].count()
    assert cells.search(index, queries.limit(3), 4000)[0].count() == 3 * 3001  # k beyond the table


def by_force(docs, queries, k):
    terms = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    held = {d: Counter(terms(t)) for d, t in docs if d is not None}
    held = {d: c for d, c in held.items() if c}
    df = Counter(t for c in held.values() for t in c)
    mean = sum(sum(c.values()) for c in held.values()) / len(held)
    out = {}
    for q, text in queries:
        scores = []
        for d, c in held.items():
            found = [t for t in set(terms(text)) if t in c]
            score = sum(round(1e6 * math.log((len(held) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))) for t in found)
            if found:
                scores.append((-score, d))
        for rank, (s, d) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (d, -s)
    return out


def test_lexical_by_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    docs = [(k, " ".join(words[min(399, x - 1)] for x in rng.zipf(1.2, rng.integers(1, 60)))) for k in range(700)] + [(900, None), (901, "..."), (None, "w1"), (902, "Ünï w1-w2_W3"), (903, "same same"), (904, "same same")]
    queries = [(1, "w1 w2 w399"), (2, "w350 W7"), (3, None), (4, "nothing known"), (5, "ünï w5"), (6, "same"), (7, " ".join(words[:60]))] + [(k, " ".join(words[x] for x in rng.integers(0, 400, 5))) for k in range(10, 40)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    index = lexical.build(table)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for k in (1, 5, 2000):
        found = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in lexical.search(index, asked, k).collect()}
        assert found == by_force(docs, queries, k)
    wanted = lexical.wanted_terms(index, asked)
    every = spark.read.parquet(index.maxima).join(wanted, "term").select("query_id", "block").distinct().count()
    assert lexical.open_blocks(index, wanted, 1).count() < 0.85 * every  # words are dealt at random
    assert lexical.search(lexical.build(table.limit(0)), asked, 3).count() == 0 == lexical.search(index, asked.limit(0), 3).count()


def test_lexical_for_stated_queries(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(words[min(299, x - 1)] for x in rng.zipf(1.2, rng.integers(1, 60)))) for k in range(600)] + [(900, None), (901, "..."), (None, "w1"), (902, "Ünï w1-w2_W3"), (903, "same same"), (904, "same same"), (7, "w250 w1"), (7, "w2")]
    queries = [(1, "w1 w2 w299"), (2, "w250 W7"), (3, None), (4, "nothing known"), (5, "ünï w5"), (6, "same"), (8, " ".join(words[:60]))] + [(k, " ".join(words[x] for x in rng.integers(0, 300, 5))) for k in range(10, 40)]
    merged = {}
    for d, t in docs:  # rows with one id are one document
        merged[d] = f"{merged[d]} {t}" if d in merged else t
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    for most, cells in ((lexical.HELD_BYTES, lexical.CELLS), (2000, 3000)):  # at once, and in many parts
        monkeypatch.setattr(lexical, "HELD_BYTES", most)
        monkeypatch.setattr(lexical, "CELLS", cells)
        for k in (1, 5, 2000):
            found = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in lexical.top_k(table, asked, k).collect()}
            assert found == by_force(merged.items(), queries, k)
    assert lexical.top_k(table.limit(0), asked, 3).count() == 0 == lexical.top_k(table, asked.limit(0), 3).count()


def test_pairs_of_query_and_posting_do_not_move(spark, tmp_path):
    n, k = 20_000, 5
    spark.createDataFrame([(q, ["every", f"w{q}"]) for q in range(20)], "query_id long, terms array<string>").write.parquet(str(tmp_path / "asked"))
    terms = sorted(["every", *(f"w{q}" for q in range(20))])
    spark.createDataFrame([(t,) for t in terms], "term string").write.parquet(str(tmp_path / "terms"))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "length": pa.array([5 + x % 1000 for x in range(n)], pa.int64()), "terms": pa.array([[0, 0]] * n, pa.list_(pa.int32()))})
    for idf in (1.0, 0.0):  # a term with an impact of 0 is found all the same
        spark.createDataFrame([(t, idf) for t in range(21)], "number int, idf double").write.parquet(str(tmp_path / f"known{idf}"))
        moved = sum(x.num_rows for x in lexical._scored(iter([batch]), *(str(tmp_path / x) for x in ("terms", f"known{idf}", "asked")), 500.0, k, 4_000_000, 40_000))
        assert 20 * k <= moved <= 20 * k * 20  # of 400,000 pairs


def test_large_batches_are_cut():
    batch = pa.RecordBatch.from_pydict({"x": pa.array(range(100_000), pa.int64())})
    tables = list(retrieval.held(iter([batch, batch.slice(0, 10), batch.slice(0, 0)]), 80_000))
    assert sum(t.num_rows for t in tables) == 100_010 and max(t.nbytes for t in tables) <= 2 * 80_000
    assert [x for t in tables for x in t.column("x").to_pylist()] == [*range(100_000), *range(10)]
