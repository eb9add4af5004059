import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the functions of the tests from here
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.path.dirname(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tesserae.session import session

    shared = tmp_path_factory.mktemp("shared")
    made = session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=f"file://{shared}/warehouse",
        spark__driver__memory="3g",
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
