"""The driver's contract holds with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()))"


def names(code):
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    return out.stdout


@pytest.mark.parametrize("blocked", ["public_tokenizers", "canopy.llm", "canopy.llm.bpe", "corpus_pipeline"])
def test_core_queries_survive_a_missing_module(blocked):
    out = names(f"import sys; sys.modules[{blocked!r}] = None; {SHOW}")
    assert "'QRY01'" in out and "'pipeline'" not in out
    if blocked != "corpus_pipeline":
        assert "op2_" not in out


def test_every_oracle_belongs_to_a_query():
    assert names("import __spark_entry__ as e; print(set(e.oracle_sql()) <= set(e.queries()))").strip() == "True"
