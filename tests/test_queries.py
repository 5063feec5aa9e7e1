"""Every engine query against its SQL, and the driver's contract."""

import os
import subprocess
import sys

import pytest

from tests import parity
from tracewright.operators import incremental
from tracewright.plans import queries as Q
from tracewright.plans import sql

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_tables = pytest.mark.skipif(not os.path.isdir(parity.SMALL), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return parity.connect()


@needs_tables
@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    parity.check(spark, con, Q.queries()[name], sql.oracle_sql()[name])


@needs_tables
def test_early_cutoff_on_tables(spark):
    got = Q.i4_early_cutoff(spark, parity.SMALL).collect()
    hits = {r.label: r.hit for r in got}
    assert not hits["//g3/p10:n10"] and not hits["//g6/p20:n20"]  # changed, with another output
    assert not hits["//g1/p15:n15"] and hits["//g5/p47:n47"]  # changed with the same output; 47 needs 15 and 23, whose outputs stayed


@needs_tables
@pytest.mark.parametrize("few", [0, incremental.FEW])
def test_plans_join_full_tables_once(spark, monkeypatch, few):
    """Levels of many targets are shuffled, levels of few are broadcast: the same plan; contents and products are joined
    before the levels."""
    seen, prepared = [], incremental._prepared
    monkeypatch.setattr(incremental, "FEW", few)
    monkeypatch.setattr(incremental, "_prepared", lambda *tables: seen.append(1) or prepared(*tables))
    got = {r.label: r.hit for r in Q.i4_early_cutoff(spark, parity.SMALL).collect()}
    assert len(seen) == 2 and len(got) == 197 and got["//g5/p47:n47"] and not got["//g3/p10:n10"]


@needs_tables
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    code = "import sys; sys.modules['tracewright.llm'] = None; import __spark_entry__ as e; assert 'a1_stats_recent' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)


def test_nothing_else_imports_them():
    found = []
    for folder, _, names in os.walk(os.path.join(HERE, "tracewright")):
        if os.path.basename(folder) != "llm":
            found += [n for n in names if n.endswith(".py") and "tracewright.llm" in open(os.path.join(folder, n)).read()]
    assert found == []
