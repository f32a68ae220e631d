import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vellumine.session import session

    shared = tmp_path_factory.mktemp("checkpoint")
    made = session("local[4]", 4, spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{tmp_path_factory.mktemp('warehouse')}", spark__driver__memory="4g")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def rows(spark):
    """Make a DataFrame from tuples and a schema string, dealt over three partitions."""

    def make(data, schema):
        return spark.createDataFrame(data, schema).repartition(3) if data else spark.createDataFrame([], schema)

    return make
