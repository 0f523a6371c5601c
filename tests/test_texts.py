"""Validation, text columns, chunks, files, retrieval, reports, feedback and streams."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from estimora.functions.text import safe_name, section, without_front_matter
from estimora.operators import ask, chunking, embedding, feedback, generation, prompts, report, retrieval, validation
from estimora.plans import catalog
from estimora.sources import corpus
from estimora.streaming import ingest

VALIDATION = [
    ("timeline", "", False, validation.EMPTY), ("timeline", "   ", False, validation.EMPTY), ("project_name", "My Cool Project", True, "My_Cool_Project"), ("project_name", "my/project:test", True, "myprojecttest"),
    ("project_name", "???", False, validation.BAD_NAME), ("project_name", "A" * 60, True, "A" * 50), ("project_description", "web app", False, validation.TOO_SHORT), ("project_description", "A web app.", True, "A web app."),
    ("team_qa_size", "3", True, "3"), ("team_qa_size", "no dedicated QA", True, "no dedicated QA"), ("team_qa_size", "three", True, "three"), ("team_qa_size", "yes definitely", False, validation.NO_NUMBER),
    ("timeline", "test<>{}", True, "test"), ("timeline", "x" * 501, False, validation.TOO_LONG), ("timeline", "<   >", True, "   "), ("team_qa_size", "someone", True, "someone"),
    ("timeline", "<>", False, validation.NOTHING_LEFT), ("tech_stack", "x", False, validation.DEFAULT_SHORT), ("project_name", "é", False, validation.SHORT_NAME), ("timeline", None, False, validation.EMPTY),
]


def test_validation(spark):
    rows = spark.createDataFrame([(k, *v) for k, v in enumerate(VALIDATION)], "i int, key string, answer string, ok boolean, expected string")
    for r in validation.validated(rows).collect():
        assert (r["valid"], r["cleaned"] if r["valid"] else r["error"]) == (r["ok"], r["expected"]), r


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, body", [("---\na: 1\n---\n\nBody", "Body"), ("---\nno end", "---\nno end"), ("Body --- x", "Body --- x"), ("------\nBody", "Body"), ("", "")])
def test_front_matter(spark, text, body):
    assert one(spark, without_front_matter(F.col("t")), t=text) == body


def test_names_and_sections(spark):
    assert one(spark, safe_name(F.col("t")), t="Prøjéct A/B: v1.0-x") == "Prøjéct_A_B__v1.0-x"
    text = "EXECUTIVE_SUMMARY: One.\nTwo\nASSUMPTIONS: - a\nRECOMMENDATIONS:\n- r "
    assert [one(spark, section(F.col("t"), s), t=text) for s in ("EXECUTIVE_SUMMARY", "ASSUMPTIONS", "RECOMMENDATIONS", "OTHER")] == ["One.", "- a", "- r", ""]
    # any line that opens with a word of three letters or more and white space is a heading, so the first ends at "Two"
    assert one(spark, section(F.col("t"), "ASSUMPTIONS"), t="ASSUMPTIONS:\n- a b\n- c\nIt is so.\n\nRECOMMENDATIONS: x") == "- a b\n- c\nIt is so."


def split_by_force(text, size=1000, overlap=200, separators=chunking.SEPARATORS):
    """Pieces by the first separator that is there, each behind its separator, and chunks as runs of pieces."""

    def cut(t, rest):
        k = next((k for k, s in enumerate(rest) if s in t), None)
        if k is None:
            return [t]
        at = [0, *(m.start() for m in re.finditer(re.escape(rest[k]), t)), len(t)]
        return [q for a, b in zip(at, at[1:]) if b > a for q in (cut(t[a:b], rest[k + 1 :]) if b - a > size else [t[a:b]])]

    found = cut(text, separators) if text else []
    runs, first = [], 0
    for k in range(len(found)):
        held = sum(map(len, found[first:k]))
        if first < k and held + len(found[k]) > size:
            runs.append((first, k))
            while first < k and (sum(map(len, found[first:k])) > overlap or sum(map(len, found[first : k + 1])) > size):
                first += 1
    runs.append((first, len(found)))
    return [c for c in ("".join(found[a:b]).strip() for a, b in runs) if c]


def test_chunks_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r["doc_id"], r["chunk_no"]): r["chunk"] for r in chunking.chunked(docs).collect()}
    assert found == {(r["doc_id"], k): c for r in docs.collect() for k, c in enumerate(split_by_force(r["text"]))}


@pytest.mark.parametrize("text", ["", "a" * 2500, "".join(f"w{k} " for k in range(900)), "# T\n\n" + "\n\n".join("para %d " % k * 40 for k in range(30)), "x\n## H\n" + "y " * 700 + "\n---z"])
def test_recursive_chunks(text):
    chunks = chunking.recursive_chunks(text)
    assert chunks == split_by_force(text)
    assert all(len(c) <= 1000 or " " not in c for c in chunks)
    squeezed, at = "".join(text.split()), 0
    for c in chunks:  # in order, and nothing is left out
        s = "".join(c.split())
        found = squeezed.find(s)
        assert 0 <= found <= at
        at = max(at, found + len(s))
    assert at == len(squeezed)


def test_fixed_windows(spark):
    rows = spark.createDataFrame([(1, "x" * 1000), (2, "y" * 1001), (3, ""), (4, None), (5, "z")], "doc_id long, text string")
    found = {(r["doc_id"], r["chunk_no"]): len(r["chunk"]) for r in chunking.fixed_windows(rows).collect()}
    assert found == {(1, 0): 1000, (2, 0): 1000, (2, 1): 201, (5, 0): 1}


def test_files_and_vectors(spark, tmp_path):
    root = tmp_path / "kb"
    for name, text in (("standards/a.md", "# A"), ("articles/x/b.TXT", "B"), ("other/c.md", "C"), ("other/d.html", "<p>"), ("other/.e.md", "E"), ("other/f.pdf", "%PDF")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "other/bad.txt").write_bytes(b"\xff\xfe\xff")
    (root / "other/link.md").symlink_to(root / "standards/a.md")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/h.md").write_text("H")
    (root / "linked").symlink_to(tmp_path / "out")
    docs, skipped = corpus.documents(spark, str(root))
    assert {(r["source"], r["category"], r["text"]) for r in docs.collect()} == {("standards/a.md", "Standard", "# A"), ("articles/x/b.TXT", "Article", "B"), ("other/c.md", "General", "C")}
    assert {r["filename"] for r in skipped.collect()} == {"f.pdf", "bad.txt"}
    pages, _ = corpus.documents(spark, str(root), lambda content: ["page 1", "page 2"])
    assert pages.filter("filename = 'f.pdf'").count() == 2
    chunks = chunking.chunked(docs.withColumn("doc_id", F.monotonically_increasing_id())).withColumnRenamed("chunk", "text")
    vectors = corpus.vector_table(embedding.hashed(chunks)).withColumns({"category": F.lit("General"), "source": F.lit("s"), "filename": F.lit("f")})
    for _ in range(2):  # again replaces
        corpus.write_vectors(vectors, str(tmp_path / "v"))
    assert corpus.read_vectors(spark, str(tmp_path / "v")).count() == 3
    for name in ("other", "a/b"):
        with pytest.raises(ValueError):
            corpus.read_vectors(spark, str(tmp_path / "v"), name)
    corpus.write_vectors(vectors.limit(1), str(tmp_path / "v"), "a/b")
    assert corpus.read_vectors(spark, str(tmp_path / "v"), "a/b").count() == 1
    found = sorted(ask.sanity_check(vectors, "b").collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in found] == [1, 2, 3] and found[0]["score"] == pytest.approx(1) and not ask.sanity_check(vectors.limit(0)).count()
    corpus.write_vectors(vectors.limit(0), str(tmp_path / "v"))
    with pytest.raises(ValueError):
        corpus.read_vectors(spark, str(tmp_path / "v"))
    assert corpus.read_vectors(spark, str(tmp_path / "v"), "a/b").count() == 1
    assert corpus.upserted(vectors.select("id"), lambda: lambda rows: None).agg(F.sum("n")).first()[0] == 3


def test_retrieval(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).round(1).tolist()
    rows = [(k, v) for k, v in enumerate(x)] + [(60, x[0]), (61, None), (62, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k(vectors.filter("vec_id IN (0, 7)").selectExpr("vec_id AS query_id", "embedding AS query"), vectors, 3).collect()}
    assert found[0, 1] == 0 and found[0, 2] == 60 and found[7, 1] == 7 and len(found) == 6
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan")] * 8), (3, [None] * 8), (4, [0.0] * 8), (5, None), (6, [])], "query_id long, query array<float>")
    assert not retrieval.top_k(odd, vectors, 3).count() and not retrieval.top_k(odd.limit(0), vectors, 3).count() and not retrieval.top_k(odd, vectors.limit(0), 3).count()


@pytest.mark.parametrize("shape, k", [((5, 30), 4), ((3, 2), 4), ((0, 5), 2), ((4, 0), 2), ((6, 9), 9)])
def test_best(shape, k):
    scores = np.random.default_rng(4).integers(0, 4, shape).astype(float)
    expected = [(i, j) for i in range(shape[0]) for j in sorted(range(shape[1]), key=lambda j: (-scores[i, j], j))[:k]]
    assert list(zip(*map(np.ndarray.tolist, retrieval.best(scores, k)))) == expected


def test_top_k_by_force(spark, monkeypatch):
    """In blocks of every size."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 6)).round(0)
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    unit = [v / np.linalg.norm(v) if v.any() else None for v in x]
    for block, held, scores in ((1024, 32_000_000, 4_000_000), (7, 500, 100)):
        for name, value in (("BLOCK_QUERIES", block), ("HELD_BYTES", held), ("SCORES_AT_ONCE", scores)):
            monkeypatch.setattr(retrieval, name, value)
        found = retrieval.top_k(vectors.selectExpr("vec_id AS query_id", "embedding AS query"), vectors, 3).collect()
        assert len(found) == 3 * sum(u is not None for u in unit)
        for r in found:
            scores = sorted((round(-unit[r["query_id"]] @ u, 9) for u in unit if u is not None))
            assert round(-r["score"], 9) == scores[r["rank"] - 1]


def test_lexical_vectors(spark):
    """Hashed words by an own murmur3, and the nearest documents by brute force."""

    def bucket(word):
        data, h, mask = word.encode(), 42, 0xFFFFFFFF
        turn = lambda v, n: ((v << n) | (v >> (32 - n))) & mask
        whole = len(data) // 4 * 4
        for a in range(0, whole, 4):
            h = (turn(h ^ turn(int.from_bytes(data[a : a + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
        left = turn(int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        h ^= left
        h ^= len(data)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> shift)) * factor & mask
        h ^= h >> 16
        return (h - (1 << 32) if h >> 31 else h) % 384

    def vector(text):
        v = np.zeros(384)
        for word in re.split(r"[ \t\n\x0b\f\r]", text.lower()):
            v[bucket(word)] += 1
        return v / np.linalg.norm(v)

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: vector(r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    items = {r["item_id"]: vector(r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    for r in catalog.QUERIES["lexical_topk"](spark, d).filter("query_id % 7 = 0").collect():
        scores = sorted((items[r["query_id"]] @ v for v in docs.values()), reverse=True)
        assert r["score"] == pytest.approx(items[r["query_id"]] @ docs[r["vec_id"]], abs=2e-6) and r["score"] == pytest.approx(scores[r["rank"] - 1], abs=2e-6)
    hits = spark.createDataFrame([(1, 2, "t2", None, None), (1, 1, "t1", "Standard", "a.md")], "query_id long, rank int, text string, category string, filename string")
    r = retrieval.context(hits).first()
    assert r["context"] == "[Source 1 — Standard: a.md]\nt1\n\n---\n\n[Source 2 — General: Unknown]\nt2"
    assert r["sources"] == ["[General] Unknown", "[Standard] a.md"]


def test_generation_falls_back(spark):
    def broken():
        def parts(prompt):
            yield "begun"
            raise RuntimeError("down")

        return parts

    rows = spark.createDataFrame([("hi",)], "p string")
    assert generation.generated(rows, "p", [broken, lambda: lambda p: iter(["Fallback ", "", "chunks."])]).first()["reply"] == "Fallback chunks."
    r = generation.generated(rows, "p", [broken]).first()
    assert r["reply"] is None and r["reply_error"] == "RuntimeError: down"
    assert generation.generated(rows, "p", [lambda: lambda p: None]).first()["reply"] == ""


def test_blank_strategy_is_an_error(spark):
    """A provider that says nothing leaves the estimate, and an error for the strategy."""
    from estimora.plans.generation import documents_of
    from estimora.sources.projects import projects

    docs = spark.createDataFrame([(1, "risk based testing", "c", "s")], "vec_id long, text string, category string, filename string")
    found = {r["document_type"]: r for r in documents_of(projects(spark, "/root/testdata/sf0.001").limit(1), docs, [lambda: lambda p: " \n"]).collect()}
    assert len(found) == 4 and found["test_strategy"]["body"] == "" and found["test_strategy"]["error"].startswith("empty test strategy for Project")
    assert found["effort_estimation"]["body"].startswith("# Effort") and found["effort_estimation"]["error"] is None


def test_document_files(spark, tmp_path):
    rows = spark.createDataFrame([("a.md", "A"), ("b.md", "B é"), ("b.md", "B"), ("c.md", None), (None, "x")], "file_name string, body string")
    for body in ("old", "new"):
        report.write_documents(rows.selectExpr("file_name", f"concat(body, ' {body}') AS body"), str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"a.md": "A new", "b.md": "B é new"}


def test_documents(spark):
    at = F.to_timestamp(F.lit("2026-02-23 12:00:00"))
    assert one(spark, report.file_name("test_strategy", F.lit("Sample Project"), at)) == "test_strategy_Sample_Project_20260223_120000.md"
    doc = one(spark, report.with_front_matter(F.lit("Body"), F.lit("P"), at, "plan"))
    assert doc.startswith("---\ngenerated_by:") and "document_type: plan" in doc and doc.endswith("---\n\nBody")
    rows = spark.createDataFrame([("a",), (None,), ("bad",)], "body string")

    def render(text):
        if text == "bad":
            raise ValueError
        return b"%PDF" + text.encode()

    assert [bytes(r["pdf"]) if r["pdf"] else None for r in report.pdf(rows, render).collect()] == [b"%PDFa", None, None]


def test_feedback(spark):
    rows = spark.createDataFrame([("1", "yes", None, "---\nx\n---\n\nB"), ("2", "partially", " ", "B"), ("3", "no", "n", "B")], "strategy_id string, feedback string, notes string, body string")
    assert {r["strategy_id"]: r["body"] for r in feedback.accepted(rows).collect()} == {"1": "---\nfeedback: yes\nnotes: \n---\n\nB", "2": "---\nfeedback: partially\nnotes:  \n---\n\nB"}
    assert [r["strategy_id"] for r in feedback.accepted(rows, True).collect()] == ["1"]


def test_messages(spark):
    assert [m["role"] for m in one(spark, prompts.messages(F.lit("u"), F.lit("s")))] == ["system", "user"]
    assert [m["role"] for m in one(spark, prompts.messages(F.lit("u"), F.lit("")))] == ["user"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 300), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    got = []
    q = ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in"), "doc_id long, text string"), lambda df, n: got.extend(df.select("id").collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(r["id"] for r in got) == ["chunk_1_0", "chunk_1_1"]


def test_fetched_contexts_take_the_place_of_retrieval(spark):
    """Contexts that are given are used as they are: nothing is retrieved, prompts and sources show them."""
    from estimora.plans.generation import contexts, documents_of
    from estimora.sources.projects import projects

    some = projects(spark, "/root/testdata/sf0.001").limit(2)
    at = F.to_timestamp(F.lit("2026-02-23 12:00:00"))
    given = some.select("project_id", *(F.lit(f"the {k} context").alias(f"{k}_context") for k in ("risk", "strategy", "plan")), *(F.array(F.lit(f"[General] {k}.md")).alias(f"{k}_sources") for k in ("risk", "strategy", "plan")))
    rows = documents_of(some, providers=[lambda: lambda p: f"told {p}"], fetched=given, at=at).collect()
    assert len(rows) == 8
    for r in rows:
        assert r["file_name"].startswith(f"{r['document_type']}_Project_") and r["file_name"].endswith("_20260223_120000.md") and r["error"] is None
        kind = {"risk_register": "risk", "test_strategy": "strategy", "test_plan": "plan"}.get(r["document_type"])
        assert r["sources"] == ([f"[General] {kind}.md"] if kind else []) and (not kind or f"the {kind} context" in r["body"])
    chunks = spark.createDataFrame([(k, f"risk based testing chunk {k}", "Standard", f"{k}.md") for k in range(9)], "vec_id long, text string, category string, filename string")
    found = contexts(some, chunks, 3).collect()
    assert all(r["risk_context"].count("[Source ") == 3 and len(r["risk_sources"]) == 3 for r in found)
    same = documents_of(some, chunks, at=at).select("project_id", "document_type", "body").collect()
    assert sorted(same) == sorted(documents_of(some, fetched=contexts(some, chunks), at=at).select("project_id", "document_type", "body").collect())


def test_projects_of_one_file_are_dealt_to_tasks_and_contexts_joined_late(spark):
    from estimora.plans.generation import documents_of
    from estimora.sources.projects import projects

    some = projects(spark, "/root/testdata/sf0.001")
    assert some.rdd.getNumPartitions() == 1
    chunks = spark.createDataFrame([(k, f"risk based testing chunk {k}", "Standard", f"{k}.md") for k in range(9)], "vec_id long, text string, category string, filename string")
    made = documents_of(some, chunks)
    tasks = {r["t"] for r in made.select(F.spark_partition_id().alias("t")).distinct().collect()}
    assert len(tasks) >= 4 and made.count() == 4 * some.count()
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "pivot" not in plan and plan.count("Aggregate") == 0  # no project's contexts are grouped anew


def test_accepted_documents_are_found_by_the_next_ingest(spark, tmp_path):
    from estimora.sources import document_files, vectors
    from estimora.streaming import watch

    root = tmp_path / "kb"
    (root / "standards").mkdir(parents=True)
    (root / "standards/a.md").write_text("A standard")
    rows = spark.createDataFrame([("s1", "s1.md", "yes", None, "---\nx: y\n---\n\nGood strategy"), ("s2", "s2.md", "no", "n", "Bad"), ("s3", "s3.md", "partially", "more detail", "Fair"), ("s4", "s4.md", "partially", " ", "No note")], "strategy_id string, file_name string, feedback string, notes string, body string")
    feedback.kept(rows, str(root), notes_needed=True)
    docs = {r["source"]: (r["category"], r["text"]) for r in document_files.read_documents(spark, str(root))[0].collect()}
    assert docs == {"standards/a.md": ("Standard", "A standard"), "generated_strategies/s1.md": ("General", "---\nfeedback: yes\nnotes: \n---\n\nGood strategy"), "generated_strategies/s3.md": ("General", "---\nfeedback: partially\nnotes: more detail\n---\n\nFair")}
    watch.ingested(spark, str(root), str(tmp_path / "v"))
    feedback.kept(rows.filter("strategy_id = 's1'").withColumn("body", F.lit("Better")), str(root))
    assert watch.ingested(spark, str(root), str(tmp_path / "v")) == {"embedded": 1, "removed": 0, "kept": 2}
    assert vectors.current(spark, str(tmp_path / "v")).filter("text LIKE '%Better'").count() == 1
