"""The driver contract: every oracle has a query, the registry loads without a session,
and the flagship query runs on sf0.001."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_oracle_keys_are_queries():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert len(q) > 250
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())


def test_registry_imports_without_spark():
    code = "import __spark_entry__ as e; print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.strip().splitlines()[-1]) > 200


def test_entry_runs(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["c_custkey", "c_name", "total_orders", "total_spent", "last_order_date"]
    assert df.count() > 0
