import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(root):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout
    return [line.split() for line in out.splitlines()]


def test_sql_is_for_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_library_stands_without_the_corpus_part(tmp_path):
    for name in ("__spark_entry__.py", "quillspark"):
        of = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        of(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "quillspark" / "llm", ignore_errors=True)
    queries, sql = listed(tmp_path)
    assert len(queries) > 50 and set(sql) <= set(queries) and not any(q.startswith("op") and q[2:3].isdigit() or q == "pipeline" for q in queries)
    if (ROOT / "corpus_pipeline.py").exists():  # also where only the folder is gone
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        assert listed(tmp_path) == [queries, sql]
