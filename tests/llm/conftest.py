from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@pytest.fixture
def cluttered(spark: SparkSession):
    """Adds columns whose names an operator might use itself."""

    def add(df: DataFrame) -> DataFrame:
        taken = {c.lower() for c in df.columns}
        names = ["value", "form", "key", "c", "code", "s", "words", "shown", "class", "canonical", "n", "row", "line", "term", "tf", "score", "rank", "source", "tokens", "field"]
        return df.withColumns({x: F.lit(1) for x in names if x not in taken})

    return add
