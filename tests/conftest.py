import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from outcomelens.session import get_session

    return get_session("4", 4)


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """Writes frames as <folder>/<name>.parquet and returns the folder."""

    def save(**frames):
        folder = tmp_path_factory.mktemp("tables")
        for name, frame in frames.items():
            frame.write.parquet(f"{folder}/{name}.parquet")
        return str(folder)

    return save
