import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_support import SF  # noqa: E402


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
