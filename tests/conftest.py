import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from oracle_check import session
    s = session("tests")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one_row(spark):
    """Evaluate columns on a single row given as name -> SQL literal."""
    def evaluate(literals, *columns):
        df = spark.sql("SELECT " + ", ".join(f"{v} AS {k}" for k, v in literals.items()))
        return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0]
    return evaluate
