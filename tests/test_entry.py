"""The driver's contract: names match, and the core stands without the optional subpackage."""

import __spark_entry__ as entry
from codestrata import catalog


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import codestrata.catalog, codestrata.sources.archives, codestrata.streaming.jobs, sys; assert not [m for m in sys.modules if m.startswith('codestrata.llm')]"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
