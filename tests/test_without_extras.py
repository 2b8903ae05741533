"""The engine works without the optional subpackage and without the pipeline."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_points_without_extras(tmp_path):
    shutil.copytree(os.path.join(REPO, "epochgrid"), tmp_path / "epochgrid", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 60 and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_extras():
    for folder, _, files in os.walk(os.path.join(REPO, "epochgrid")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    text = source.read()
                assert "from ..llm" not in text and "epochgrid.llm" not in text and "from .llm" not in text, f
