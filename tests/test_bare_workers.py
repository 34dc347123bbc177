"""Workers that cannot import the package: only the driver's process knows where it lies."""

import os
import subprocess
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF001 = "/root/testdata/sf0.001"
SCRIPT = """
import sys, tempfile
sys.path.insert(0, {root!r})
from helixframe.session import get_session
import __spark_entry__ as entry
spark = get_session("local[2]", 4, extra={{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="helix-bare-"),
                                          "spark.driver.memory": "2g"}})
for key in {keys!r}:
    print(key, len(entry.queries()[key](spark, {sf!r}).collect()))
"""


@pytest.mark.parametrize("keys", [["tok_10", "ml_03"], ["ml_04", "ml_05"],
                                  ["src_02", "src_03", "src_04", "snk_02", "snk_05", "udf_04"]])
def test_queries_run(keys):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, keys=keys, sf=SF001)], env=env,
                         cwd=tempfile.mkdtemp(prefix="helix-bare-"), capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-3000:]
    assert [line.split()[0] for line in got.stdout.splitlines() if line.split()[0] in keys] == keys
