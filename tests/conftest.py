from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from lanternfish.session import build


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return build("local[4]", "4g", 4)
