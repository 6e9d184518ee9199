"""Every query outside the corpus operators against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from millrace.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(v) for v in row) for row in df.select([f"`{c}`" for c in columns]).collect())
    result = db.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


#: Titles and texts whose upper case is no plain one, letters beyond the BMP, and small letters that become A to Z.
ODD_HITS = ["Einerß als", "Großß.bk STUSS.bk", "ß.bk aß.bk und", "ﬁn oﬀ.bk now", "ŉab ǰab ẖab zu", "xyΐ ὐab de", "xy𐀀zw 𝐀ab cd𠮷ef la", "xyͅzw os", "ıbm ſap", "kıſ.bK ab", "update ſet ptt.bk", "abcdefghi.bk", "é.bk naïve ÀB et", "Straße 1a a1 a_b", ""]


@pytest.mark.parametrize("name", ["JOIN10_hits_to_candidate", "JOIN11_hits_to_candidate_v2"])
def test_odd_letters_of_hits_equal_sql(spark, tmp_path, name):
    pages = [(i, f"u{i}", f"<title>{x}</title><p>") for i, x in enumerate(ODD_HITS)]
    pages += [(i + 20, f"u{i}", f"<title>{x.upper()}</title><p>{x}") for i, x in enumerate(ODD_HITS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["query"], r["candidate"]) for r in QUERIES[name](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(c.execute(f"SELECT query, candidate FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
