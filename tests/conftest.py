import pytest

from apexframe.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(
        4, 4,
        **{
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        },
    )
    yield s
    s.stop()


@pytest.fixture(scope="session")
def x(spark):
    from apexframe.plans.registry import Inputs

    return Inputs(spark, FOLDER)
