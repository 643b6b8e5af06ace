import pytest

from checks.run import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
