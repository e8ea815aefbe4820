"""Every query with a DuckDB twin agrees with it on the smallest tables (sf0.001).

The driver's gate runs the same comparison at sf0.01; running it here on the
smallest scale also exercises tiny-data edge cases (few users, sparse windows).
"""

import duckdb
import pytest

from tests.conftest import SMOKE
from tools.check_oracle import rows_of
from trafficlens.sources.tables import TABLES


def _names():
    import __spark_entry__ as ent
    return sorted(ent.oracle_sql())


def _rows_only():
    import __spark_entry__ as ent
    twins = ent.oracle_sql()
    return sorted(n for n in ent.queries() if n.startswith("q_") and n not in twins)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("name", _names())
def test_query_matches_duckdb(spark, con, name):
    import __spark_entry__ as ent
    sdf = ent.queries()[name](spark, SMOKE)
    scols, srec = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = con.execute(ent.oracle_sql()[name])
    dcols, drec = [d[0] for d in res.description], res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srec) == len(drec)
    assert rows_of(scols, srec) == rows_of(dcols, drec)


def _unchecked():
    from trafficlens.queries.results import CHECKED_BY
    return [n for n in _rows_only() if n not in CHECKED_BY]


def test_checks_are_registered_with_a_twin():
    import __spark_entry__ as ent
    from trafficlens.queries.results import CHECKED_BY
    assert set(CHECKED_BY) <= set(_rows_only()) and set(CHECKED_BY.values()) <= set(ent.oracle_sql())


@pytest.mark.parametrize("name", _unchecked())
def test_query_without_a_twin_runs(spark, name):
    import __spark_entry__ as ent
    ent.queries()[name](spark, SMOKE).write.format("noop").mode("overwrite").save()


#: Whole flows over operators that each have a checked query of their own.
FLOWS = {"q_flow_http_user_report", "q_flow_login_window_forest"}


def test_queries_without_a_twin_have_a_checked_partner():
    """What a learner finds has no twin; then another query of the same operator has one."""
    import __spark_entry__ as ent
    checked = {n.split("_")[1] for n in ent.oracle_sql()}
    assert [n for n in _rows_only() if n.split("_")[1] not in checked and n not in FLOWS] == []


def test_readme_counts_the_queries():
    import __spark_entry__ as ent
    from pathlib import Path
    text = (Path(ent.__file__).parent / "README.md").read_text()
    core = [n for n in ent.queries() if n.startswith("q_")]
    assert f"({len(core)} queries)" in text and f"{len(core) - len(_rows_only())} of them have a DuckDB twin" in text
