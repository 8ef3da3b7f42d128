"""The driver contract, with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "raretide", "jobs"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "raretide" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'reweighted_ler' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); print(len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_outside_imports_the_subpackage():
    for top in ("raretide", "jobs"):
        for folder, _, files in os.walk(os.path.join(ROOT, top)):
            if os.path.basename(folder) != "llm":
                for f in files:
                    if f.endswith(".py"):
                        with open(os.path.join(folder, f)) as text:
                            body = text.read()
                        assert "raretide.llm" not in body and "corpus_pipeline" not in body, f
