import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    with tempfile.TemporaryDirectory() as d:
        s = session("local[4]", 4, **{"spark.checkpoint.dir": d, "spark.sql.warehouse.dir": d + "/warehouse", "spark.driver.memory": "4g"})
        yield s
        s.stop()
