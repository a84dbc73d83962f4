"""Every registered query against its SQL twin in DuckDB."""

import duckdb
import pytest

from meterflow.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame, names):
    out = []
    for r in frame[names].astype(object).where(frame[names].notna(), None).values.tolist():
        out.append(repr([round(float(x), 6) + 0.0 if isinstance(x, float) else str(x) for x in r]))
    return sorted(out)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf_dir, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    for frame in (ours, theirs):
        for c in frame.columns:
            if frame[c].dtype.kind == "M":
                frame[c] = frame[c].astype("datetime64[us]").astype(str)
    names = sorted(ours.columns)
    assert rows(ours, names) == rows(theirs, names)


def test_all_features_has_153_columns(spark, sf_dir):
    out = registry.QUERIES["all_features"](spark, sf_dir)
    assert len(out.columns) - 1 == 153  # and the region


def test_attention_rows(spark, sf_dir):
    assert registry.QUERIES["ring_attention_block"](spark, sf_dir).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
