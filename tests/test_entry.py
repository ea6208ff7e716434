"""The driver contract without the text subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "standardize" in q and "standardize" in o
assert set(o) <= set(q)
print(sum(k == "pipeline" or k.startswith("op") for k in q))
"""


def _numbered(folder) -> int:
    env = {**os.environ, "PYTHONPATH": str(folder)}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return int(out.stdout)


def _copy(tmp_path, *, llm: bool, pipeline: bool):
    skipped = shutil.ignore_patterns("__pycache__", *([] if llm else ["llm"]))
    shutil.copytree(os.path.join(ROOT, "quorum"), tmp_path / "quorum", ignore=skipped)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    return tmp_path


def test_entry_works_without_the_text_subpackage(tmp_path):
    assert _numbered(_copy(tmp_path, llm=False, pipeline=False)) == 0


def test_a_pipeline_left_behind_is_not_registered(tmp_path):
    assert _numbered(_copy(tmp_path, llm=False, pipeline=True)) == 0
