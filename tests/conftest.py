import os
import sys
import tempfile

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(_HERE))
# Python workers import test-module functions (callbacks) by name
os.environ["PYTHONPATH"] = os.pathsep.join([_HERE, os.path.dirname(_HERE), os.environ.get("PYTHONPATH", "")])

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from helixframe.session import get_session
    ckpt = tempfile.mkdtemp(prefix="helix-test-ckpt-")
    s = get_session("local[4]", shuffle_partitions=8,
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture
def tmp_dir():
    return tempfile.mkdtemp(prefix="helix-test-")
