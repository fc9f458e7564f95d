"""Every registered query with a SQL check must give the same rows."""

import pytest
from check import compare, connect

from fleetlife.workload import all_entries

SF = "/root/testdata/sf0.001"
ENTRIES = all_entries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql is not None])
def test_same_rows(spark, con, name):
    assert compare(ENTRIES[name].run(spark, SF), con, ENTRIES[name].sql) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_inventory_is_covered():
    covered = {c for e in ENTRIES.values() for c in e.covers}
    want = (
        [f"A{i}" for i in range(1, 22) if i not in (2, 19)] + [f"B{i}" for i in range(1, 23)]
        + [f"C{i}" for i in range(1, 8)] + [f"D{i}" for i in range(1, 13)] + [f"E{i}" for i in range(1, 19)]
        + [f"F{i}" for i in range(1, 24)] + ["G1", "G2", "G3", "G4", "G5", "S1", "S2"])
    assert sorted(set(want) - covered) == []
