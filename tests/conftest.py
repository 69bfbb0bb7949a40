import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from pagemill.session import checkpoint_dir, get_session
    s = get_session("local[*]", **{"spark.sql.shuffle.partitions": "8",
                                   "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="pagemill-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
