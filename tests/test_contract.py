"""The driver's contract on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
CHECKED = ["derive_sequences", "header_truncate", "kmer_counts", "lsh_bands", "novelty_promoted", "reduction_report"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).columns == ["ord", "header", "mbucket", "n_kmers"]


@pytest.mark.parametrize("name", CHECKED)
def test_same_values_as_sql(spark, name):
    said, _, _ = check(spark, name, contract.queries()[name], contract.oracle_sql()[name], SF, connect(SF))
    assert said == ""


def test_works_without_the_training_data_subpackage():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("seqthin.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as contract
names = set(contract.queries())
assert "novelty_promoted" in names and "pipeline" not in names
assert set(contract.oracle_sql()) <= names
"""
    root = os.path.dirname(os.path.abspath(contract.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
