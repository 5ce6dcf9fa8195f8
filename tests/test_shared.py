import os
import subprocess
import sys

import pytest

from motifloom.sources import shared

RUN = """
import sys
from pyspark.sql import SparkSession
from motifloom.sources.shared import shared_path, stored
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("PATH", shared_path(spark, "x"))
print("ROWS", stored(spark.range(3), "x").count())
"""


def test_folder_is_qualified_and_removed_at_the_end(tmp_path):
    out = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], capture_output=True, text=True, timeout=120, env=os.environ, cwd=os.getcwd())
    assert f"PATH file:{tmp_path}/motifloom/local-" in out.stdout and "ROWS 3" in out.stdout, out.stderr[-2000:]
    assert os.listdir(tmp_path / "motifloom") == []


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        shared.shared_folder(type("Session", (), {"sparkContext": Context()})())
