"""Queries against their SQL on values at the ends of the doubles."""

import duckdb
import pytest

from terrafold.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def both(spark, folder, name, change):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE ({change}) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    con.sql(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    plain = lambda rows: sorted((str(tuple(r)) for r in rows))
    got = QUERIES[name](spark, str(folder))
    return plain(got.collect()), plain(con.sql(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall())


@pytest.mark.parametrize("value", ["0.0", "0.5", "CASE WHEN event_id = 7 THEN 0 ELSE value + 1 END", "CASE WHEN event_id = 7 THEN NULL ELSE value + 1 END", "value - 3"])
def test_log_mode(spark, tmp_path, value):
    """A value of 0, one value alone, no value, values below 0."""
    got, want = both(spark, tmp_path, "log_mode", f"({value})::DOUBLE AS value")
    assert got == want


def test_tails_of_many_looks(spark, tmp_path):
    """Ratios that hardly vary give looks whose law is beyond the doubles."""
    got, want = both(spark, tmp_path, "tail_histogram", "user_id + 1000003 AS user_id")
    assert got == want


def test_rule_onset_without_looks(spark, tmp_path):
    """All of the step table counts where the data have none of its looks."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (5 AS l_quantity) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.sql(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    got = tuple(QUERIES["rule_onset"](spark, str(tmp_path)).first())
    assert got == con.sql(SQL["rule_onset"]).fetchall()[0] and None not in got[:2] and got[2] == 0
