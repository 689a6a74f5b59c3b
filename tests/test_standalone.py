"""The engine works without its optional corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_part(tmp_path):
    shutil.copytree(f"{ROOT}/normgraph", tmp_path / "normgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
    count, pipeline, named = said.stdout.split()
    assert int(count) >= 80 and pipeline == "False" and named == "True"


def test_nothing_imports_the_optional_part():
    for folder, _, files in os.walk(f"{ROOT}/normgraph"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}", encoding="utf-8") as source:
                        assert "normgraph.llm" not in source.read(), f


def test_a_broken_dependency_is_not_hidden(tmp_path):
    """Only a missing subpackage may be passed over."""
    shutil.copytree(f"{ROOT}/normgraph", tmp_path / "normgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "normgraph" / "llm").mkdir()
    (tmp_path / "normgraph" / "llm" / "__init__.py").write_text("import a_module_that_is_not_there\n")
    (tmp_path / "corpus_pipeline.py").write_text("import normgraph.llm\n")
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode != 0 and "a_module_that_is_not_there" in said.stderr
