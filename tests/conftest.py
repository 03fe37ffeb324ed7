import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from frondlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g", name="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one_value(spark):
    """Evaluate one expression."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="session")
def catalog(spark):
    from pyspark.sql import functions as F

    from frondlake.sources.catalog import derive_catalog

    rows = spark.createDataFrame(
        [(1, "Corn", "Common Rust"), (2, "Corn", "Healthy"), (3, "Lemon", "Curl Virus")],
        "n int, crop string, disease string",
    )
    return derive_catalog(rows, F.col("n"), F.col("crop"), F.col("disease"))
