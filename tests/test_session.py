import os
import subprocess
import sys

from conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import glob, os, sys
import __spark_entry__ as E
from larkspur.session import get_spark, release, shared_base
spark = get_spark(master="local[2]", shuffle_partitions=2)
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
n = [len(E.queries()[q](spark, sys.argv[1]).collect()) for q in ("latency_summary", "knn_exact")]
base = shared_base(spark)
assert base == shared_base(spark) and os.path.isdir(base)
mine = os.path.join(base, "larkspur-" + spark.sparkContext.applicationId)
os.makedirs(mine, exist_ok=True)
release(spark)
assert not os.path.exists(mine)
print("rows", *n)
"""


def test_queries_run_without_a_configured_shared_folder(tmp_path):
    """Neither spark-defaults nor the session names a checkpoint folder."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT, "SPARK_LOCAL_DIRS": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", SCRIPT, SF], env=env, cwd=tmp_path, capture_output=True, text=True,
                         timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert all(int(n) > 0 for n in out.stdout.split("rows")[1].split())
