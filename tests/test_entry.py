import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def test_entry_without_the_training_subpackage(tmp_path):
    import shutil

    shutil.copytree(REPO / "foliolake", tmp_path / "foliolake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and not any(n.startswith('op') for n in q); assert set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["lang"] for r in rows} == {"de", "en", "es", "fr"}
