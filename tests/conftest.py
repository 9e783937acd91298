import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    folder = tmp_path_factory.mktemp("shared")
    spark = session("tests", 8, **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.shuffle.partitions": "4"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
