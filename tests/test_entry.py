"""The entry module works, and works without the training-data package."""

import subprocess
import sys
from pathlib import Path

from helpers import DATA, ROOT


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["status", "n", "revenue"] and df.count() > 0
    assert DATA


def test_import_without_the_package(tmp_path):
    for name in ("__spark_entry__.py", "loomwork"):
        (tmp_path / name).symlink_to(Path(ROOT) / name)
    code = (
        "import sys, importlib.util as u; f = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('loomwork.llm', 'corpus_pipeline') else f(n, *a)\n"
        "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
