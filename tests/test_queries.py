"""Every registered query against its SQL form on the smallest tables, and the driver contract."""

import importlib.util
import os
import pathlib

import pytest

from gradewise.plans import all_queries

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def load(path, name):
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def checker():
    return load(ROOT / "tools" / "check_oracle.py", "check_oracle")


@pytest.fixture(scope="module")
def db(checker):
    return checker.connect(FOLDER)


@pytest.mark.parametrize("name", list(all_queries.QUERIES))
def test_query_matches_sql(spark, checker, db, name):
    good, note = checker.compare(spark, db, name, FOLDER)
    assert good, note


def test_driver_contract(spark):
    entry = load(ROOT / "__spark_entry__.py", "spark_entry")
    # queries of installed extensions may come on top, and not all of them have SQL
    assert set(all_queries.QUERIES) == set(all_queries.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    frame = entry.entry(spark)
    assert frame.count() > 0 and "mean_accuracy" in frame.columns
