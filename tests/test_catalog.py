import subprocess
import sys
from pathlib import Path

import pytest
from duck import assert_same
from kinlink.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_equals_duckdb(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.SQL:
        assert_same(df, catalog.SQL[name], SF)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_without_the_llm_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(('kinlink.llm', 'corpus_pipeline')):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'link_int32' in names and 'pipeline' not in names and not any(n.startswith('op') for n in names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
