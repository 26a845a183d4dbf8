import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from samples import DOCS  # noqa: E402


@pytest.fixture
def documents(spark):
    def build(data, extra=False):
        df = spark.createDataFrame(data, DOCS)
        if extra:
            # names that operators use inside
            for name in ("id", "h", "size", "key", "band", "start", "__id", "__hash", "keep", "slice", "run", "copy"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return build
