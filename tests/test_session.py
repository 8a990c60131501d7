"""A session made by somebody else, with the package on no path but the driver's."""

import os
import subprocess
import sys
import textwrap

import pytest

from quadtide.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_plain_session_in_another_folder(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    program = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {str(shared)!r}).config(
            "spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as entry
        assert entry.entry(spark).count() >= 0
        for name in ("H5_one_or_more", "A10_write_and_read_statements", "J13_sampled_comparison"):
            assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        spark.stop()
    """)
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert any(shared.iterdir())


class _Session:
    """As much of a session as the shared folder looks at."""

    def __init__(self, master, folder=None):
        self.master, self.dir, self.conf, self.sparkContext = master, None, {"spark.checkpoint.dir": folder} if folder else {}, self

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_dir(_Session(master))
    assert shared_dir(_Session(master, "hdfs:///scratch")) == "hdfs:///scratch"


def test_a_local_master_has_a_folder_of_its_own():
    assert os.path.isdir(shared_dir(_Session("local[2]")))
