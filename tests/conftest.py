import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from wideprep.session import local_session

    s = local_session(2, shuffle_partitions=4, app="wideprep-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """The sample table with its dense ordinal, as the pipeline stores it."""
    from sample_table import SAMPLE_HEADER, SAMPLE_ROWS
    from wideprep.operators.ordinal import with_ordinal

    rows = [[i] + r for i, r in enumerate(SAMPLE_ROWS)]
    df = spark.createDataFrame(rows, "_pos int, " + ", ".join(f"{h} string" for h in SAMPLE_HEADER))
    return with_ordinal(df, ["_pos"]).drop("_pos")
