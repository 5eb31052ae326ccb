"""The entry registers the library's own queries also where the optional part cannot be imported."""

import subprocess
import sys

import pytest

HIDE = """
import sys, warnings
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(*entry.queries())
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "groundsieve.llm", "corpus_pipeline", "none"])
def test_without_the_optional_part(name):
    out = subprocess.run([sys.executable, "-c", HIDE.format(name=name)], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "bm25_topk" in out.stdout.split()
