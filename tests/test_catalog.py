import glob
import math
import os

import duckdb
import pytest

from redactry.plans import catalog


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    have = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in catalog.ORACLES and (not name.startswith("detect_") or name == "detect_seeded"):  # places are compared with Python's in test_detect
        cur = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert have == sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    else:
        assert df.columns


def test_the_rest_does_not_need_the_text_package():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    users = subprocess.run(["grep", "-rlE", r"(from|import) redactry\.llm", "redactry", "--include=*.py"], cwd=root, capture_output=True, text=True).stdout.split()
    assert all(u.startswith("redactry/llm/") for u in users), sys.version
