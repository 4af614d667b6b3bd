from __future__ import annotations

import pytest

from weftline.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session(cpus=4, shuffle_partitions=4, app="tests")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
