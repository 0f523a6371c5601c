"""Every query of the engine against its SQL twin on the smallest tables."""

import duckdb
import pytest

from estimora.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if v is None or v != v else round(float(v), 5) + 0.0 if hasattr(v, "__float__") else str(v)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, D).toPandas()
    if name in catalog.ORACLES:
        expected = con.execute(catalog.ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)


def test_four_documents(spark):
    found = catalog.QUERIES["generate_all"](spark, D).filter("project_id <= 5").toPandas()
    assert found.groupby("project_id")["document_type"].nunique().eq(4).all() and found["body"].str.len().gt(0).all()
