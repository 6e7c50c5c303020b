"""The entry file without the training-data package."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = ("import json, __spark_entry__ as e; q = e.queries(); "
       "print(json.dumps([len(q), len([k for k in q if k[:2] == 'op' and k[2].isdigit()]), 'pipeline' in q, len(e.oracle_sql())]))")


def _copied(to: Path, *without: str) -> Path:
    left_out = {ROOT / w for w in (".git", *without)}
    shutil.copytree(ROOT, to, ignore=lambda at, names: [n for n in names if Path(at, n) in left_out or n == "__pycache__"])
    return to


def _said(tree: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", SAY], cwd=tree, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("without", [
    ("groundshift/llm", "tests/llm", "corpus_pipeline.py"), ("groundshift/llm", "tests/llm"), ("corpus_pipeline.py",),
])
def test_the_rest_stays(tmp_path, without):
    done = _said(_copied(tmp_path / "tree", *without))
    assert done.returncode == 0, done.stderr
    n, dealt, pipeline, with_sql = json.loads(done.stdout)
    assert n - dealt - pipeline >= 141 and with_sql >= 140
    assert not pipeline and bool(dealt) == ("groundshift/llm" not in without)


def test_an_emptied_package_counts_as_absent(tmp_path):
    tree = _copied(tmp_path / "tree", "groundshift/llm")
    (tree / "groundshift/llm").mkdir()
    assert _said(tree).returncode == 0


def test_other_import_errors_are_not_hidden(tmp_path):
    if not (ROOT / "groundshift/llm").exists():
        pytest.skip("needs the package")
    tree = _copied(tmp_path / "tree")
    (tree / "groundshift/llm/common.py").write_text("import no_such_module_at_all\n")
    done = _said(tree)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
