"""The driver's contract, with and without the subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "kept" in df.columns


def test_import_without_the_subpackage(tmp_path):
    """What is left after the llm folders and the pipeline are deleted still imports."""
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for p in (ROOT / "corpusloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q and e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}, timeout=120)
