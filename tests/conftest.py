import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lanewise.session import session

    local = tempfile.mkdtemp(prefix="spark-")
    s = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.local.dir": local,
            "spark.checkpoint.dir": f"{local}/shared",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"
