import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and '_' in n and n[2].isdigit() for n in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


def copy(tmp_path, llm: bool):
    shutil.copytree(f"{REPO}/driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("__pycache__", *([] if llm else ["llm"])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{REPO}/{name}"):
            shutil.copy(f"{REPO}/{name}", tmp_path)
    return tmp_path


def told(path):
    return subprocess.run([sys.executable, "-B", "-c", CODE], cwd=path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(path)})


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "only caches", "the pipeline", "the pipeline and an empty folder"])
def test_without_the_optional_part(tmp_path, left):
    path = copy(tmp_path, llm=False)
    if "pipeline" not in left and (path / "corpus_pipeline.py").exists():
        os.remove(path / "corpus_pipeline.py")
    if "folder" in left or "caches" in left:
        os.makedirs(path / "driftline/llm/__pycache__" if "caches" in left else path / "driftline/llm")
    said = told(path)
    assert said.returncode == 0 and said.stdout.split()[1:] == ["False", "False", "True"], said.stderr


def test_other_errors_are_not_swallowed(tmp_path):
    if not os.path.isdir(f"{REPO}/driftline/llm"):
        pytest.skip("the optional part isn't there")
    path = copy(tmp_path, llm=True)
    (path / "driftline/llm/mixing.py").write_text("import nowhere_to_be_found\n")
    assert "nowhere_to_be_found" in told(path).stderr
