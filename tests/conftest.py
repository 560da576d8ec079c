import pytest
from pyspark.sql import SparkSession

from cuemill.streaming import state


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
