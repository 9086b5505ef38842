import os

import pytest

os.environ.setdefault("TZ", "UTC")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from gridloom.session import get_spark

    s = get_spark("tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    return s
