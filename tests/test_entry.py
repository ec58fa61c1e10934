import subprocess
import sys

import pytest

HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
import bindings
kept = set(entry.queries())
print(set(bindings.QUERIES) <= kept, sorted(kept - set(bindings.QUERIES) - {{"pipeline"}}), set(bindings.SQL) <= set(entry.oracle_sql()))
"""


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash", "zstandard", "casefuse.llm"])
def test_other_queries_stay_where_training_data_packages_are_missing(missing):
    out = subprocess.run([sys.executable, "-c", HIDDEN.format(missing)], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == ["True", "[]", "True"]


def test_a_missing_package_of_the_library_itself_is_no_excuse():
    out = subprocess.run([sys.executable, "-c", HIDDEN.format("casefuse.operators.replies")], capture_output=True,
                         text=True)
    assert out.returncode != 0 and "replies" in out.stderr
