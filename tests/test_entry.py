"""The entry works in a copy of the repository without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
LIST_KEYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), len(o), sum(k.startswith('op') or k == 'pipeline' for k in q))"


def keys_in(folder):
    done = subprocess.run([sys.executable, "-c", LIST_KEYS], cwd=folder, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    return [int(x) for x in done.stdout.split()[-3:]]


def copy_to(folder, pipeline):
    skipped = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "veilspark", folder / "veilspark", ignore=skipped)
    shutil.copy(ROOT / "__spark_entry__.py", folder)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", folder)
    return folder


def test_entry_without_the_subpackage(tmp_path):
    queries, oracles, dealt = keys_in(copy_to(tmp_path, pipeline=False))
    assert queries > 240 and oracles > 230 and dealt == 0


def test_entry_with_a_pipeline_left_behind(tmp_path):
    queries, oracles, dealt = keys_in(copy_to(tmp_path, pipeline=True))
    assert queries > 240 and oracles > 230 and dealt == 0
