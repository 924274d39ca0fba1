import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from parcelrisk.session import build_session
    work = tempfile.mkdtemp(prefix="parcelrisk-test-", dir="/tmp")
    s = build_session("local[4]", app="parcelrisk-tests", shuffle_partitions=8, extra={
        "spark.sql.warehouse.dir": f"{work}/warehouse",
        "spark.driver.extraJavaOptions": f"-Dderby.system.home={work}/derby",
    })
    if not s.sparkContext.getCheckpointDir():      # a configured shared folder wins
        s.sparkContext.setCheckpointDir(f"{work}/ckpt")
    yield s
    s.stop()
