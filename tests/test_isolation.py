"""The library works without its corpus package, and without the pipeline that stands on it."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(s) <= set(q))"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_parts(tmp_path, left_out):
    for part in ("revdiff", "oracle"):
        shutil.copytree(ROOT / part, tmp_path / "repo" / part, ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for part in {"__spark_entry__.py", "corpus_pipeline.py"} - set(left_out):
        if (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / "repo")
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    total, corpus, ok = done.stdout.split()
    assert int(total) > 100 and ok == "True"
    assert (corpus == "0") == (not (tmp_path / "repo/revdiff/llm").exists())
