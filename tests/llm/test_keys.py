"""Keys of the pipeline's stages where hashes clash."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from estimora.llm import jaccard


def test_clashing_keys_are_told_apart(spark, monkeypatch):
    real, texts = F.xxhash64, [f"text {k % 40}" for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # all rows clash at first, then go by both hashes
    monkeypatch.setattr(corpus_pipeline.F, "xxhash64", lambda *c: F.lit(7).cast("long") if len(c) == 1 else real(*c))
    found = corpus_pipeline.keyed_by(docs, "row_key", "text").collect()
    keys = {r["row_key"]: r["text"] for r in found}
    assert len(found) == 120 and len(keys) == 40 and set(keys.values()) == set(texts)
    assert found[0].asDict().keys() == {"doc_id", "text", "row_key"}


def test_rows_without_an_id_have_no_class(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text), (4, text), (2, text), (None, "of its own and of no other one")], "doc_id long, text string")
    found = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.classes(docs).collect()), key=str)
    assert found == sorted([(None, None, 3), (None, None, 4), (2, 2, 3), (4, 2, 3)], key=str)


def test_stages_on_very_long_texts(spark):
    """Masking and encoding read a text to its end."""
    long = "word and another " * 60_000
    docs = spark.createDataFrame([(1, f"{long} 10.20.30.40 mail a.b@c.org", "en", "s", 5), (2, "x" * 200_000 + " 10.20.30.40", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.personal_data(spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1] == f"{long} [IP] mail [EMAIL]" and texts[2].endswith("x [IP]")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.token_ids(spark, docs, "").collect()}
    assert found == {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
