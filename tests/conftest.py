import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from groundshift.session import build_session

    s = build_session("tests", master="local[4]", spark__sql__shuffle__partitions="4",
                      **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="groundshift-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from contract.fixtures import Tables

    return Tables(spark, SF)
