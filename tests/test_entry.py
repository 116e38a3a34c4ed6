"""The register where the training-data folders are taken away."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from statspine.plans import load

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def copied(to, *without):
    """The repository's code without some of its paths."""
    skip = {os.path.join(ROOT, w) for w in without}

    def ignored(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or os.path.join(folder, n) in skip]

    return shutil.copytree(ROOT, to, ignore=ignored)


def listed(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [line.split() for line in out.stdout.splitlines()]


def test_register_without_the_folders(tmp_path):
    rest = sorted(load().QUERIES)
    llm, tests = os.path.join("statspine", "llm"), os.path.join("tests", "llm")
    assert listed(copied(tmp_path / "a", llm, tests)) == [rest, sorted(load().SQL)]
    assert listed(copied(tmp_path / "b", llm, tests, "corpus_pipeline.py"))[0] == rest


def test_other_faults_show(tmp_path):
    llm = os.path.join("statspine", "llm")
    folder = copied(tmp_path / "c", llm)
    (folder / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    code = "import __spark_entry__ as e; e.queries()"
    # without the operators the pipeline is not listed, but its own faults are no reason to be silent
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module_at_all" in out.stderr
