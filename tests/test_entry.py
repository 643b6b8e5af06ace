"""The contract module must import in any layout, without a session or Spark's jars."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import glob, pyspark, pyspark.core.context as context

def no_jvm(*a, **k):
    raise RuntimeError("a session was started")

context.SparkContext._ensure_initialized = no_jvm
pyspark.__file__ = "/nowhere/pyspark/__init__.py"
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()), set(e.oracle_sql()) - set(e.queries())
print(len(e.queries()))
"""


def test_entry_imports_without_a_session(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_HOME": "/nowhere"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) >= 40


@pytest.mark.parametrize("absent", ["tokenizers", "tiktoken", "public_tokenizers", "belegwerk.llm", "corpus_pipeline"])
def test_entry_without_optional_packages(absent):
    code = f"import sys; sys.modules[{absent!r}] = None\nimport __spark_entry__ as e\nprint(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=ROOT)
    assert done.returncode == 0, done.stderr
    names = done.stdout.split()
    assert "hybrid_fusion" in names and not any(n.startswith("op") for n in names)


def test_entry_does_not_hide_other_errors():
    code = "import sys; sys.modules['numpy'] = None\nimport __spark_entry__"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, cwd=ROOT).returncode != 0
