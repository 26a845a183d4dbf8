import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from reelgate.session import local_session

    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from oracle import connect
    from samples_dir import SAMPLE

    return connect(SAMPLE)


@pytest.fixture
def tiny_chunks(spark):
    """Make every group large and every chunk short, so that the distributed ways run."""
    spark.conf.set("reelgate.groupRows", "5")
    spark.conf.set("reelgate.chunkFrames", "16")
    yield
    spark.conf.unset("reelgate.groupRows")
    spark.conf.unset("reelgate.chunkFrames")
