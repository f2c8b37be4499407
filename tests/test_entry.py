"""The driver's contract holds without the corpus operators and without what they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("blocked", ["zstandard", "xxhash", "corpus_pipeline", "rasterloom.llm"])
def test_other_queries_are_there_when_something_is_missing(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 60 and said[1:] == ["[]", "True"]
