import os
import subprocess
import sys
from pathlib import Path

import pytest

from compare import same
from logweir.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_registers_without_a_session():
    """Queries and SQL are there before any session is; what needs one is built when a query runs."""
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.severity for r in e.entry(spark).collect()} == {"Error", "Warning", "Info", "Debug", "Unknown"}
