"""The entry without the text operators, or without a library that these need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers", "aerolattice.llm", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), 'frame_speeds' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, sql, pipeline, core = out.stdout.split()
    assert int(n) >= 100 and int(sql) >= 99 and core == "True" and pipeline == "False"
