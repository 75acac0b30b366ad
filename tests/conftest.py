import pytest

from talewarp.session import local_session, ship


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return ship(session)
