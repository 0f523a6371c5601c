"""Windows of benchmark items at the ends of documents."""

from estimora.llm import decontaminate


def test_opening_words_at_the_end(spark):
    item = "alpha beta gamma " + " ".join(f"word{chr(97 + k)}" for k in range(14)) + " alpha beta gamma"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some words first " + item), (2, "another one"), (3, item)], "doc_id long, text string").coalesce(1)
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 7, 0), (3, 7, 0)}


def test_many_parts_of_a_benchmark(spark, monkeypatch):
    """The same rows, however the benchmark and the texts are cut."""
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    rows = lambda: sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    whole = rows()
    assert whole
    for name, value in (("ITEMS_AT_ONCE", 7), ("HELD_BYTES", 3000)):
        monkeypatch.setattr(decontaminate, name, value)
        assert rows() == whole
