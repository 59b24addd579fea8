"""Every registered query with an oracle agrees with DuckDB at the smallest scale."""

import decimal
import math
import os

import duckdb
import pytest

from rasterloom import registry

registry.load()
SF = "/root/testdata/sf0.001"
#: Whole families of small queries, and some of each of the others; the driver compares all of them.
FAMILIES = (
    "col", "num", "flt", "clr", "ord", "sta", "ctr", "src", "snk", "set", "mod", "pts1_", "pts17", "pts2", "pix10", "pix14", "pix5_g", "pix7", "grp11", "cmp2",
    "cmp5", "cmp8_merge", "cmpr1_", "cmpr9", "job1",
)


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if n.startswith(FAMILIES)])
def test_query_matches_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    rel = con.execute(registry.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall()), key=repr)
    assert got == want


def test_queries_load_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
