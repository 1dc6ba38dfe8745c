import datetime as dt
import logging

import pytest

from lateline.session import get_session

logging.getLogger("DataFrameQueryContextLogger").disabled = True


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("tests", "local[*]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def utc():
    return lambda text: dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)
