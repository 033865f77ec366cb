import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from curatio.session import get_session
    wh = tempfile.mkdtemp(prefix="curatio-wh-", dir="/tmp")
    s = get_session("local[4]", app="curatio-tests", shuffle_partitions=4,
                    extra_conf={"spark.sql.warehouse.dir": wh})
    yield s
    s.stop()
