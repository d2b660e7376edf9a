import pytest
from pyspark.sql import SparkSession

from quillspan.plans.session import configured


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = configured(SparkSession.builder.master("local[4]")).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    session = builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
