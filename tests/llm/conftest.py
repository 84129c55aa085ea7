import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from helpers import as_table, no_documents, odd_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    return as_table(spark, odd_documents(spark), tmp_path_factory.mktemp("odd") / "documents.parquet")


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    return as_table(spark, no_documents(spark), tmp_path_factory.mktemp("none") / "documents.parquet")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
