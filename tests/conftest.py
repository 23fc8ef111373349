import pytest

from sparkloom.session import build


@pytest.fixture(scope="session")
def spark():
    return build("local[4]", spark_sql_shuffle_partitions="8", spark_driver_memory="6g")
