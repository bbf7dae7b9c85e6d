import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 110


def test_works_without_the_optional_part(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still imports."""
    import shutil

    shutil.copytree(ROOT / "lexmill", tmp_path / "lexmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, found = out.stdout.split()
    assert int(n) > 100 and found == "False"
