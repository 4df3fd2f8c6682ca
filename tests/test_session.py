"""Intermediate tables, the shared folder, and the entry without the llm subpackage's packages."""

import subprocess
import sys

import pytest

from lavra import session
from tests.conftest import ROOT


class _Cluster:
    """Stands for a session of a cluster whose shared folder isn't named."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(_Cluster)


def test_unstage_deletes_one_table(spark):
    a, b = session.staged(spark.range(3), "a"), session.staged(spark.range(4), "b")
    session.unstage(a, spark.range(1))
    assert a._lv_path not in session._STAGED and b.count() == 4
    with pytest.raises(Exception):
        spark.read.parquet(a._lv_path).count()


@pytest.mark.parametrize("module", ["regex", "xxhash", "lavra.llm"])
def test_core_queries_load_without_what_llm_needs(module):
    code = f"import sys; sys.modules[{module!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'p1_found' in q, len(e.oracle_sql()) > 0)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["True", "True"]
