"""The registered SQL of this subpackage against its queries on the small tables."""

from collections import Counter

import duckdb
import pytest

from tessella.llm import queries

SF = "/root/testdata/sf0.001"


def _normal(rows):
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert _normal(frame.select(*columns).collect()) == _normal(want) and want
