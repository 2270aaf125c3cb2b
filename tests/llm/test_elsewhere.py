"""The operators' functions and models travel with their code: workers without this package run every query."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as contract
from lumifield import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
                      spark__checkpoint__dir={shared!r})
known = contract.queries()
for name in sorted(n for n in known if n[:2] == "op" or n == "pipeline"):
    print("rows", name, known[name](spark, contract.SMALL).count())
"""


def test_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=1200)
    assert run.stdout.count("rows ") == 14, run.stderr[-2000:]
