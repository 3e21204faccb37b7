"""The library without its optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

from tallystone.plans import registry

CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_load_without_the_subpackage(tmp_path, pipeline):
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    assert not (tmp_path / "copy" / "tallystone" / "llm").exists()
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"], said.stderr


def test_other_failures_are_raised(tmp_path):
    keep = shutil.ignore_patterns("llm", "__pycache__", ".git", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)
    (tmp_path / "copy" / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert "no_such_module" in said.stderr
