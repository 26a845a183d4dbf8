import os
import subprocess
import sys

from reelgate.session import pinned, release, scratch, shared_dir


def test_stored_steps_are_freed(spark):
    release(spark)

    def stored():
        names = os.listdir(shared_dir(spark).removeprefix("file://"))
        return {n for n in names if n.startswith("pinned-")}

    kept = pinned(spark.range(3))
    before = stored()
    with scratch(spark):
        assert pinned(spark.range(5)).count() == 5
        assert len(stored() - before) == 1
    assert stored() == before and kept.count() == 3
    assert release(spark) == 1 and release(spark) == 0
    assert len(stored()) == len(before) - 1


def test_a_session_without_a_shared_folder(tmp_path):
    """A fresh clone: no machine defaults name a folder, and steps are stored all the same."""
    code = """
from reelgate.session import local_session, pinned, release, shared_dir
spark = local_session(1, "plain")
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert pinned(spark.range(3)).count() == 3 and shared_dir(spark) == shared_dir(spark)
assert release(spark) == 1
print("stored and freed")
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=root, capture_output=True, text=True, timeout=300)
    assert "stored and freed" in done.stdout, done.stderr[-2000:]
