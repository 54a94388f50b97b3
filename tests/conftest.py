import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    where = tempfile.mkdtemp(prefix="spark-")
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", where).config("spark.checkpoint.dir", f"file://{where}/shared").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
