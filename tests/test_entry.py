"""The library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, any(k.startswith('op') and k[2].isdigit() for k in q))"


def _asked(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_queries_without_the_subpackage(tmp_path):
    for name, gone in (("both", ("llm",)), ("all", ("llm", "corpus_pipeline.py"))):
        copy = tmp_path / name
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
        n, _, pipeline, llm = _asked(copy)
        assert int(n) > 100 and pipeline == "False" and llm == "False"


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "stopwise")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
