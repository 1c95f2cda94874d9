import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from speechmill.session import build_session

    return build_session("tests", 8, {"spark.sql.shuffle.partitions": "4"})


def words_frame(spark, words, rec="r", project="p"):
    """Rows from (word, start_s, end_s) triples."""
    rows = [(rec, project, i, w, round(s * 1000), round(e * 1000), 1.0) for i, (w, s, e) in enumerate(words)]
    return spark.createDataFrame(
        rows, "recording_id string, project_slug string, ordinal bigint, word string, start_ms bigint, end_ms bigint, prob double")


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())
