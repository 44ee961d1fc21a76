import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from talkgrid.session import local, ship

    spark = ship(local(4, 4))
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints/tests")
    yield spark
