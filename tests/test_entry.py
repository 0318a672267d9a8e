import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessel import oracle, queries

from .compare import compare

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(oracle.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(oracle.ORACLE_SQL))
def test_same_as_sql(spark, name):
    compare(spark, queries.QUERIES[name], oracle.ORACLE_SQL[name])


@pytest.mark.parametrize("also", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_part(tmp_path, also):
    """A copy of the repository without its two folders, and without the pipeline too, registers the other queries."""
    for f in ROOT.glob("*.py"):
        if f.name not in also:
            (tmp_path / f.name).write_text(f.read_text())
    for f in (ROOT / "tessel").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            target = tmp_path / f.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(f.read_text())
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False", "False", str(len(oracle.ORACLE_SQL))], out.stderr


@pytest.mark.parametrize("blocked", ["public_tokenizers", "numpy.linalg._no_such_part", "corpus_pipeline"])
def test_the_rest_works_if_the_training_data_part_cannot_be_imported(blocked):
    """A dependency of the training-data part is missing: the other queries are there, and so are its own if only the pipeline fails."""
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; q = e.queries(); print(len([n for n in q if not n.startswith('op') and n != 'pipeline']), 'pipeline' in q, len(e.oracle_sql()) >= {len(oracle.ORACLE_SQL)})"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), str(blocked.startswith("numpy")), "True"], out.stderr
