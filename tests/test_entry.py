"""The entry's guard: a missing library of the training-data operators costs only their queries."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.partition(".")[0] == sys.argv[1]:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(k.startswith("op") for k in e.queries()))
"""


def counts(hidden):
    out = subprocess.run([sys.executable, "-c", HIDE, hidden], cwd=HERE, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_missing_library():
    from shardwell import catalog

    assert counts("xxhash") == counts("corpus_pipeline") == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE)), "False"]
