"""Workers need no copy of the package: a session started in another folder runs the queries."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from lumifield import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
                      spark__checkpoint__dir={shared!r})
print("rows", contract.entry(spark).count(), contract.queries()["g03_components"](spark, contract.SMALL).count())
"""


def test_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "rows" in run.stdout, run.stderr[-2000:]
    assert all(int(n) > 0 for n in run.stdout.split("rows")[1].split())
