"""The registered queries agree with their SQL on the smallest tables."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
QUICK = ["reconcile_counts", "status_board", "nearest_date_match", "structure_report", "page_ranges", "bound_rows", "locate_evidence"]


def test_every_statement_has_its_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="benchmark tables absent")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    from oracle.check import connect, rows_of

    df = queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = connect(SF).execute(oracle_sql()[name])
    assert got == rows_of([d[0] for d in res.description], res.fetchall())
