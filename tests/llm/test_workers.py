"""The operators run where the workers have no copy of this package."""
import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT, SF_SMALL

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as E
from gatewatch.session import build_session, shared_dir
spark = build_session("local[2]", 4)
shared_dir(spark)
def lost(batches):
    try:
        import gatewatch
        raise SystemExit("the worker has the package")
    except ModuleNotFoundError:
        yield from batches
assert spark.range(1).mapInArrow(lost, "id long").count() == 1
for name in {names!r}:
    assert E.queries()[name](spark, {sf!r}).count() > 0, name
print("all ran")
"""


@pytest.mark.parametrize("names", [("op3_mixing", "op7_toxicity", "op8_decontaminate", "op11_token_files", "op13_lexical_search"), ("pipeline",)])
def test_from_another_folder(tmp_path, names):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, names=names, sf=SF_SMALL)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
