import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_parts(tmp_path):
    """Both folders and the pipeline deleted: the entry point has the other queries, and nothing left names what is gone."""
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(HERE, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    left = [p for p in (tmp_path / "copy" / "larkspar").rglob("*.py") if "larkspar.llm" in p.read_text()]
    assert not left


def test_the_optional_parts_are_there():
    import __spark_entry__ as e

    if (HERE / "larkspar" / "llm").exists():
        assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in e.queries()}
