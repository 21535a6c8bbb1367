"""The driver's contract: everything imports without a session, and every oracle has its query."""

import subprocess
import sys

from tests.conftest import ROOT


def run(code):
    return subprocess.run([sys.executable, "-W", "error", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_entry_imports_without_a_session_or_a_warning():
    done = run("import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q))")
    assert done.returncode == 0 and int(done.stdout) > 200, done.stderr


def test_other_queries_do_without_a_missing_package():
    code = "import sys; sys.modules['terravia.llm'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q; print(len(q))"
    done = run(code)
    assert done.returncode == 0 and int(done.stdout) > 180, done.stderr
