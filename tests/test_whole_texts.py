"""Queries on texts read them to the end."""

import re

import pytest

from estimora.plans import catalog

FILL = "word é/b " * 40
TEXTS = [(0, FILL + "CRITICAL | high x Risk Level: High | Medium critical"), (1, FILL * 100 + "risk level: medium"), (2, "short"), (89, FILL + "critical " * 9)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def levels(i, text):
    low = f"| R01 | risk | {('High', 'Medium', 'Critical', 'Low')[i % 4]} | Medium | Risk Level: High |\n{text}".lower()
    return low.count("critical"), low.count("| high") + low.count("risk level: high"), low.count("| medium") + low.count("risk level: medium")


def test_levels_are_counted_to_the_end(spark, tables):
    found = {r["doc_id"]: tuple(r)[1:] for r in catalog.QUERIES["risk_level_counts"](spark, tables).collect()}
    assert found == {i: levels(i, t) for i, t in TEXTS} and found[0] == (2, 4, 2)


def test_buffer_of_the_whole_register(spark, tables):
    found = {r["doc_id"]: r["buffer"] for r in catalog.QUERIES["risk_buffer"](spark, tables).collect()}
    days = {i: sum(n * d for n, d in zip(levels(i, t), (5, 3, 1), strict=True)) for i, t in TEXTS}
    assert found == pytest.approx({i: min(days[i], i % 90 * 0.35) for i in days}, abs=0.051) and found[89] > 31


def test_names_of_whole_texts(spark, tables):
    found = {r["doc_id"]: r["name"] for r in catalog.QUERIES["safe_source"](spark, tables).collect()}
    assert found == {i: re.sub(r"[^\w\-.]", "_", t) for i, t in TEXTS}
