import pytest

from llm_rows import EDGES, SCHEMA


@pytest.fixture(scope="session")
def edges(spark):
    rows = [(*r, len(r[1] or ""), *range(10)) for r in EDGES]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
