import pytest

from tests.sparktest import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session()


@pytest.fixture
def frame(spark):
    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)
    return make
