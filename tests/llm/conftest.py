import pytest
from nasty_rows import CLASHING, NASTY



@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like those that operators make."""
    return spark.createDataFrame([(*r, 0.5, "s", 1, "i", "k", 2, 3, 4, 5, 6) for r in NASTY], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
