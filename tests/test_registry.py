"""The driver's contract, and a cross-section of queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, sql_engine
from sparkcurate.plans.oracle import ORACLES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "near_dup_edges", "orbit_hash", "label_audit", "annotation_labels", "class_root",
    "dataset_alerts", "balanced_resample", "roc_auc", "fit_temperature", "early_stop", "decide",
    "field_test", "image_groups",
]


@pytest.fixture(scope="module")
def engine():
    return sql_engine(FOLDER)


def test_contract(spark):
    names = set(entry.queries())
    assert set(ORACLES) <= names and len(names) >= 98
    df = entry.entry(spark)
    assert df.columns == ["metric", "before", "after", "change"] and df.count() == 12


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, engine, name):
    ok, note = compare(spark, engine, FOLDER, name)
    assert ok, note
