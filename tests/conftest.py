import os
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from postmill.session import build_session

    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return build_session("local[4]", shuffle_partitions=4, extra={
        "spark.checkpoint.dir": f"file://{scratch}/checkpoints", "spark.local.dir": f"{scratch}/local",
        "spark.sql.warehouse.dir": f"{scratch}/warehouse", "spark.driver.memory": "4g",
    })
