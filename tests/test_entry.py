import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_queries_are_listed_without_the_llm_folder(tmp_path, with_pipeline):
    shutil.copytree(REPO / "tidepanel", tmp_path / "tidepanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        if (REPO / name).exists():
            shutil.copy(REPO / name, tmp_path / name)
    out = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    count, pipeline, known = out.stdout.split()
    assert int(count) > 100 and pipeline == "False" and known == "True"
