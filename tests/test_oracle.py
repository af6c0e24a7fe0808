"""Every query with reference SQL gives the same rows in DuckDB."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
# These train models; their parts are tested in test_models.py.
SLOW = {"iforest_scores", "iforest_report", "classify_events", "classifier_report", "attribution_top4", "score_all"}
# The text operators have tests of their own.
SLOW |= {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "item") else str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(
        (tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_reference_sql(spark, duck, sf_dir, name):
    ours = rows_of(QUERIES[name](spark, sf_dir).toPandas())
    theirs = rows_of(duck.execute(ORACLES[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert set(entry_module.entry(spark).columns) == {"user_id", "rule", "severity", "n"}
