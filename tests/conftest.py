import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from veilspark.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    def make(*rows):
        return spark.createDataFrame(
            [(i, path, text) for i, (path, text) in enumerate(rows)], "doc_id long, path string, text string"
        ).repartition(4)

    return make
