import tempfile

import pytest

from verdance.session import local_spark


@pytest.fixture(scope="session")
def spark():
    session = local_spark(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
