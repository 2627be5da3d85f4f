"""Queries of operators 11 and 13 against their SQL."""

import duckdb
import pytest

from bazaarlens.llm import queries as Q


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_lexical_search"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    df = Q.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    want = sorted((str([r[names.index(c)] for c in df.columns]) for r in rel.fetchall()))
    assert sorted(str(list(r)) for r in df.collect()) == want and want
