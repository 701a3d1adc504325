import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_subpackage():
    code = "import casework.plans.registry, sys; assert not [m for m in sys.modules if m.startswith('casework.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.HERE)
