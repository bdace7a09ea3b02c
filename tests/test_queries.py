"""Every query that has SQL agrees with DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from sunloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)):
        return round(float(value), 6) + 0.0
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in order) for r in rows], key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, small, name):
    made = QUERIES[name](spark, small)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    wanted = con.sql(ORACLES[name])
    assert sorted(made.columns) == sorted(wanted.columns)
    got = rows_of(made.columns, [tuple(r) for r in made.collect()])
    want = rows_of(wanted.columns, wanted.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_pixels_are_dealt_before_they_are_summed(spark, small, monkeypatch):
    from sunloom.plans import relations

    whole = relations.relation(spark, small, "pixels").collect()
    monkeypatch.setitem(relations.DEALT, "pixels", ("lineitem", relations.FRAME, 500))
    made = relations.relation(spark, small, "pixels")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("HashAggregate")
    assert {tuple(r)[:4] for r in made.collect()} == {tuple(r)[:4] for r in whole}
