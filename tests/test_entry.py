import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quadrille import storage

REPO = Path(__file__).parents[1]
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries()), "text operators"
assert e.oracle_sql().keys() <= e.queries().keys()
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
assert e.queries()["bgp_star"](spark, "/root/testdata/sf0.001").count() == 150
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_without_the_text_operators(tmp_path, with_pipeline):
    """The engine starts and answers where the subpackage of text operators is gone."""
    shutil.copytree(REPO / "quadrille", tmp_path / "quadrille", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py")[: 1 + with_pipeline]:
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path)
    code = CODE if not with_pipeline else CODE.split("from pyspark")[0] + "e.oracle_sql()"
    ran = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path), "JAVA_HOME": __import__("os").environ.get("JAVA_HOME", "")}, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]


def test_intermediates_can_be_discarded(spark):
    storage.discard(spark)
    df = storage.written(spark.range(5), "five")
    folder = Path(storage.shared_dir(spark))
    assert df.count() == 5 and list(folder.glob("five-*"))
    rounds = storage.Rounds(spark, "rounds")
    rounds.add(spark.range(3))
    assert storage.discard(spark) == 2 and not list(folder.glob("five-*")) and not list(folder.glob("rounds-*"))


class _Cluster:
    """Stands for a session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"
        applicationId = "a"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(_Cluster)
