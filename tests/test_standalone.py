"""The library without its optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LEFT = "import __spark_entry__ as e; q = e.queries(); assert 'roots' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
#: Imports every test module that is left, as collecting them would.
TESTS = "import glob, importlib; [importlib.import_module(f[:-3].replace('/', '.')) for f in sorted(glob.glob('tests/**/*.py', recursive=True))]"


def _sources(gone):
    """Python files of the repository but those that go, without what a run may have left beside them."""
    for top, folders, files in os.walk(ROOT):
        folders[:] = [f for f in folders if f not in gone and not f.startswith(".") and f != "__pycache__"]
        for f in files:
            if f.endswith(".py") and f not in gone:
                yield os.path.relpath(os.path.join(top, f), ROOT)


def _run(code, at):
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYTEST_")}
    env["PYTHONPATH"] = os.pathsep.join([str(at), *[p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]])
    done = subprocess.run([sys.executable, "-c", code], cwd=at, timeout=240, env=env, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True)
    assert done.returncode == 0, f"{code}\n{done.stdout}"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_the_rest_stands_alone(tmp_path, gone):
    to = tmp_path / "repo"
    for f in _sources(gone):
        (to / f).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(os.path.join(ROOT, f), to / f)
    _run(LEFT, to)
    _run(TESTS, to)


def test_nothing_else_imports_it():
    for top, _, files in os.walk(os.path.join(ROOT, "partloom")):
        if os.path.basename(top) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(top, f)) as source:
                    assert "partloom.llm" not in source.read(), f
