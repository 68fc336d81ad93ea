"""The entry module imports when PySpark is loaded from its zip, as some clusters do."""

import glob
import os
import subprocess
import sys

import pyspark
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_with_pyspark_from_zip():
    zips = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "*.zip"))
    if not any(z.endswith("pyspark.zip") for z in zips):
        pytest.skip("this PySpark ships no zip")
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([*zips, ROOT])}
    code = "import pyspark, __spark_entry__ as e; assert 'pyspark.zip' in pyspark.__file__; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) >= 80
