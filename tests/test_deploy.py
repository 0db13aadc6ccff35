"""The package reaches Python workers wherever the driver was started."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

RUN = """
import sys
sys.path.insert(0, {repo!r})
from raremetrics.plans import catalog
from raremetrics.session import build_session
spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.driver.memory": "2g"}})
rows = catalog.QUERIES["zip_index"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows), all(r.converged is not None for r in rows))
"""


def test_models_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout and out.stdout.split()[-1] == "True", out.stderr[-2000:]


def test_cluster_without_shared_folder_is_refused():
    from raremetrics import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        _raremetrics_shipped = True

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Spark:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())


PLAIN = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", 2).getOrCreate()
print("ROWS", len(__spark_entry__.queries()["chisq_pvalue"](spark, "/root/testdata/sf0.001").collect()))
"""


def test_plain_session_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PLAIN.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout and int(out.stdout.split()[-1]) > 0, out.stderr[-2000:]
