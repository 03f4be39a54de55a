import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_training_data_parts(tmp_path):
    for name in ("gridloom", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        source = os.path.join(REPO, name)
        copy = shutil.copytree if os.path.isdir(source) else shutil.copy
        if os.path.isdir(source):
            copy(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
    os.remove(tmp_path / "corpus_pipeline.py")
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)


def test_a_broken_operator_is_not_taken_for_a_removed_one(tmp_path):
    for name in ("gridloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(REPO, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path / name)
    (tmp_path / "gridloom" / "llm" / "search.py").write_text("import no_such_module\n") if (tmp_path / "gridloom" / "llm").is_dir() else None
    if (tmp_path / "gridloom" / "llm").is_dir():
        done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
        assert done.returncode and b"no_such_module" in done.stderr
