"""The neighbour index runs where the workers have no copy of this package."""
import os
import subprocess
import sys

from tests.conftest import ROOT, SF_SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from gatewatch.session import build_session, shared_dir
spark = build_session("local[2]", 4)
shared_dir(spark)
for name in ("local_outlier_factor", "isolation_forest"):
    assert E.queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, sf=SF_SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True,
                          timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
