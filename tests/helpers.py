"""What tests share: where the tables are, and comparing rows with SQL."""

import math
import os
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """A value that compares alike whichever engine made it."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def same_rows(df, con, sql):
    """Whether a DataFrame and a query agree on columns and rows, in any order."""
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    theirs = [tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()]
    ours = [tuple(plain(x) for x in r) for r in df.select(*columns).collect()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
