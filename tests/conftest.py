import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from blocklens.session import get_session
    s = get_session("local[4]", app_name="blocklens-tests", shuffle_partitions=4)
    yield s


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
