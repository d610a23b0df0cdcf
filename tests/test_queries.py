"""Every query of the catalogue against its SQL; those without SQL against a stable schema."""

import pytest

from barlake.plans.catalogue import flagship, oracle_sql, queries
from tests.compare import diff

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, sf_dir, name):
    assert diff(queries()[name](spark, sf_dir), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    assert df.count() > 0


def test_flagship(spark, sf_dir):
    df = flagship(spark, sf_dir)
    assert df.count() > 0 and {"sma_10", "l_close", "label"} <= set(df.columns)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 100


@pytest.mark.parametrize("name", ["volume_profile_a_100w_100b_D41", "volume_profile_a_50w_100b_D41", "volume_profile_a_D41", "volume_profile_a_100w_50b_D41", "volume_profile_a_50w_50b_D41", "volume_profile_b_D42"])
def test_profile_bins_that_tie(spark, tmp_path, name):
    """Large volumes over wide bars: many bins hold the same, and the last bits of their sums decide which is the fullest."""
    import duckdb

    duckdb.sql(f"""COPY (SELECT 3 * h + t AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(h // 4 AS INTEGER)) + to_minutes(CAST(t AS INTEGER)) AS ts, h AS user_id, 'view' AS event_type,
      [h * 7919 % 400 / 100, 50 + h * 31 % 17, 90 + h * 104729 % 4000 / 100][t + 1] AS value, '{{"k": ' || (20000 + h * 15485863 % 70001) || '}}' AS props FROM range(1000) a(h), range(3) b(t))
      TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert diff(queries()[name](spark, str(tmp_path)), con, SQL[name]) == ""
