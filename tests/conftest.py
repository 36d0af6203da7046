import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from proofsheet import get_spark
    s = get_spark(app="proofsheet-tests", cpus=4, shuffle_partitions=8)
    yield s


SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema, mapping=None):
    """Inline frame + source rows (row 1 is the header) + profiles."""
    from proofsheet.operators.positions import with_row_index
    from proofsheet.operators.profile import infer_columns
    df = with_row_index(spark.createDataFrame(rows, schema).coalesce(1), "__source_row", 2)
    return df, infer_columns(df, mapping or {})
