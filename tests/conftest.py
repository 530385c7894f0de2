import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strandlens.session import session

    spark = session(cores=4, shuffle_partitions=4, app="tests")
    yield spark
    spark.stop()
