"""The entry module without the text operators, or without what they need."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parents[1]
_LOOK = "import sys; sys.modules['{}'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"


def names(missing):
    said = subprocess.run([sys.executable, "-c", _LOOK.format(missing)], cwd=REPO, capture_output=True, text=True, check=True)
    return said.stdout.split()


def test_core_queries_stand_alone():
    import kindling.queries as core

    want = [str(len(core.queries())), str(len(core.oracle_sql())), "False"]
    assert names("kindling.llm") == want
    assert names("xxhash") == want
