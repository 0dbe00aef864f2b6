"""Every registered library query runs, and agrees with its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from listenlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    assert got
    if name in catalog.oracle_sql():
        rel = con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in rel.fetchall())


def test_profile_takes_all_records_and_tags(spark, con, monkeypatch):
    from listenlake.plans import analyze as plan

    seen, whole = [], plan.analyze
    monkeypatch.setattr(plan, "analyze", lambda inputs, **params: seen.append(inputs) or whole(inputs, **params))
    catalog.queries()["profile_summary"](spark, SF)
    for df, name, key in ((seen[0].records, "embeddings", "vec_id"), (seen[0].tags, "documents", "doc_id")):
        want = con.execute(f"select printf('t%03d', {key}) from {name}").fetchall()
        assert sorted(r["track_id"] for r in df.collect()) == sorted(r[0] for r in want)


def test_scene_topics_takes_all_documents_and_the_whole_grid(spark, con):
    got = catalog.queries()["scene_topics"](spark, SF).collect()
    docs = {str(r[0]) for r in con.execute("select distinct l_orderkey from lineitem join part on p_partkey = l_partkey").fetchall()}
    assert {r["k"] for r in got} == {3, 5, 8, 13}
    assert {r["name"] for r in got if r["part"] == "doc" and r["k"] == 13} == docs
